"""One query for each operator, with production parameters, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ready, table
from . import chat_format, decontaminate, html_extract, langid, mixing, ngram_join, oracle, quality_rules, rule_ensemble, sharding, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Target weights of the sources; all others weigh 1.
WEIGHTS = {"src0": 0.5, "src1": 2.0, "src2": 2.0}
BUDGET = 0.8


def query(name: str, sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(ready(spark), sf_dir)
        if sql:
            ORACLE[name] = sql
        return f

    return keep


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op2_sharding", f"SELECT doc_id, slot, CAST(shard AS INT) AS shard, 2 AS map_version FROM ({oracle.shards('documents')})")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard", "map_version")


@query("op3_warc_bundles")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.bundles(table(spark, sf_dir, "pages"))


@query("op4_decontamination", oracle.passages("documents"))
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_ngram_jaccard_join", oracle.links("documents"))
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_documents(table(spark, sf_dir, "documents"))


@query("op6_html_extraction")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op7_quality_rules", oracle.rules("documents"))
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "char_distance", "word_distance", "verdict")


@query("op8_source_mixing", oracle.mixture("documents", WEIGHTS, BUDGET))
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), WEIGHTS, budget_fraction=BUDGET)


@query("op9_chat_formatting", oracle.CHATS)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
