"""Cleans, deduplicates, decontaminates, mixes and shards the documents; each stage is one operator.

Every stage takes all that its predecessor kept. Those that filter keep the columns of the documents
as they are; the last adds the slot, the shard and the version of the slot map. Nulls, repeated rows,
ties and clashing names are treated as each operator states.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import decontaminate, mixing, ngram_join, oracle, quality_rules, sharding
from quillstone.llm.queries import BUDGET, WEIGHTS
from quillstone.session import ready, remove, shared_folder, table

SLOT_MAP = "spark.quillstone.slotMap"


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose histograms diverge from their language's go."""
    ready(spark)
    return quality_rules.drop_rejected(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id."""
    ready(spark)
    return ngram_join.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a test item go."""
    return decontaminate.drop_contaminated(docs, table(ready(spark), sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights, up to the budget."""
    ready(spark)
    return mixing.take_mixture(docs, WEIGHTS, budget_fraction=BUDGET)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its slot and shard, by the map kept in the folder of the setting ``SLOT_MAP``, or else by a new one."""
    ready(spark)
    return sharding.shard_documents(docs, folder=spark.conf.get(SLOT_MAP, None))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mixed),
    ("sharding", sharded),
]

ORACLE_SQL = f"""
WITH s1 AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM ({oracle.rules("documents")}) WHERE verdict = 'keep')),
s2 AS (SELECT * FROM s1 WHERE doc_id NOT IN (SELECT doc_id FROM ({oracle.groups("s1")}) WHERE doc_id <> group_id)),
s3 AS (SELECT * FROM s2 WHERE doc_id NOT IN (SELECT doc_id FROM ({oracle.passages("s2")}))),
s4 AS (SELECT * FROM s3 WHERE doc_id IN (SELECT doc_id FROM ({oracle.mixture("s3", WEIGHTS, BUDGET)})))
SELECT s4.*, s5.slot, CAST(s5.shard AS INT) AS shard, 2 AS map_version FROM s4 JOIN ({oracle.shards("s4")}) s5 ON s4.doc_id = s5.doc_id
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written to the shared folder, and the next one reads that.

    A folder goes when its successor is written; the last one stays, since the result is read from it.
    """
    docs = table(ready(spark), sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
    return docs
