"""The registered queries and the pipeline over the small tables, against SQL where there is one."""

import os
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry
import corpus_pipeline
from quillstone.llm.queries import ORACLE, QUERIES
from sql_twin import compare, duck


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf, name):
    compare(QUERIES[name](spark, sf), duck(sf), ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_every_row_has_a_result(spark, sf, name):
    got = QUERIES[name](spark, sf)
    if name.startswith("op3"):
        assert got.selectExpr("sum(n_records)").first()[0] == spark.read.parquet(f"{sf}/pages.parquet").count()
    else:
        table = "pages" if name.startswith("op6") else "documents"
        assert got.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_pipeline(spark, sf):
    assert len(corpus_pipeline.STAGES) == 5 and "pipeline" in entry.queries()
    compare(corpus_pipeline.run(spark, sf), duck(sf), corpus_pipeline.ORACLE_SQL)


def test_stages_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []


def test_near_duplicates_at_the_threshold_go(spark, sf):
    """Pairs of 26 and 40 word pairs that share 26: the similarity is the threshold. The later text of each goes."""
    rows = []
    for k in range(300):
        both = [f"p{k}w{i}" for i in range(27)]
        rows += [(2 * k, " ".join(both)), (2 * k + 1, " ".join([*both, *(f"q{k}w{i}" for i in range(14))]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()) == [2 * k for k in range(300)]


def test_near_duplicates_shuffle_no_signature_of_one_text(spark, sf):
    """All texts stay, which have nothing in common; less than they are long is shuffled (before: 1.8 times that)."""
    docs = spark.createDataFrame([(k, " ".join(f"{k}a{i * 7919}" for i in range(60))) for k in range(2000)], "doc_id bigint, text string").repartition(4).localCheckpoint()
    chars = docs.selectExpr("sum(length(text))").first()[0]
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    assert corpus_pipeline.near_duplicates(spark, docs, sf).count() == 2000
    assert written() - before < chars


def test_stages_of_odd_rows(spark):
    """Nulls in any column, repeated rows and clashing names pass every stage; each keeps a part of its input with its columns."""
    text = " ".join(f"w{k * 7 % 50}" for k in range(90))
    rows = [(k % 9, [None, "", "one", text, f"{text} tail", text.upper()][k % 6], [None, "en", "xx"][k % 3], [None, "src0", "s"][k % 3], None) for k in range(40)]
    rows += [(None, None, None, None, None), (None, text, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clash = ("verdict", "_gone", "slot", "shard", "map_version", "key", "finish", "node")
    docs = docs.select("*", *(F.lit(f"own {c}").alias(c) for c in clash))
    columns = docs.columns
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    for name, stage in corpus_pipeline.STAGES:
        before = Counter(map(tuple, docs.select(*columns[:5]).collect()))
        docs = spark.createDataFrame((out := stage(spark, docs, sf)).collect(), out.schema)
        after = Counter(map(tuple, docs.select(*columns[:5]).collect()))
        assert not after - before and after, name
        assert docs.columns == columns or name == "sharding" and set(docs.columns) == set(columns)
        assert {r["_gone"] for r in docs.select("_gone").collect()} == {"own _gone"}
    assert {r["map_version"] for r in docs.collect()} == {2}
