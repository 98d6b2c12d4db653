"""I* ingestion and window queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import artifacts, turns
from ..operators import store
from ..plans import ingest
from .registry import query
from .sql import sql


@query("i01_s27_ingest", sql("SELECT source_id, CASE WHEN nth = 1 AND NOT known THEN 'INGESTED' ELSE 'DEDUPLICATED' END AS outcome FROM (SELECT source_id, row_number() OVER (PARTITION BY content_hash ORDER BY source_id) AS nth, content_hash IN (SELECT content_hash FROM artifacts WHERE source_id % 17 = 0) AS known FROM artifacts)", "artifacts"))
def i01(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = artifacts(spark, sf_dir)
    return store.unclaimed(a, a.where("source_id % 17 = 0")).select("source_id", "outcome")


@query("i06_process_once", sql("SELECT source_id FROM artifacts WHERE content_hash NOT IN (SELECT content_hash FROM artifacts WHERE source_id % 5 = 0)", "artifacts"))
def i06(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = artifacts(spark, sf_dir)
    return a.join(a.where("source_id % 5 = 0").select("content_hash").distinct(), "content_hash", "left_anti").select("source_id")


@query("i10_stamped", sql("SELECT source_id, CASE WHEN source_id % 2 = 0 THEN locator_kind ELSE 'content' END AS kind, CASE WHEN source_id % 2 = 0 THEN locator_key ELSE 'content:' || content_hash END AS key, content_hash FROM artifacts", "artifacts"))
def i10(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("source_id") % 2 == 0
    rows = artifacts(spark, sf_dir).withColumn("locator_kind", F.when(even, F.col("locator_kind"))).withColumn("locator_key", F.when(even, F.col("locator_key")))
    return ingest.stamped(rows).select("source_id", "provenance.*")


_ITEMS = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, upper(substr(role, 1, 1)) || substr(role, 2) || ' (' || role || '): ' || text AS line FROM conversations"


def _windows(size: int, overlap: int, trigger: int) -> str:
    step = size - overlap
    return f"SELECT conv_id, CAST(min(i) AS INT) AS start, CAST(max(i) + 1 AS INT) AS \"end\", string_agg(line, chr(10) || chr(10) ORDER BY i) AS text FROM items JOIN (SELECT unnest(range(100)) AS w) ON i >= w * {step} AND i < w * {step} + {size} AND w <= greatest(0, ceil((n - {size}) / {step}.0)) WHERE n >= {trigger} GROUP BY conv_id, w"


@query("i02_i04_windows", sql("SELECT conv_id, start, \"end\", sha256(text) AS content_hash FROM w", items=_ITEMS, w=_windows(4, 1, 2)))
def i04(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ingest.windows(turns(spark, sf_dir), "conv_id", "turn", ingest.formatted(F.col("role"), F.col("text")), 4, 1, 2)
    return w.select("conv_id", "start", "end", "content_hash")


@query("i03_flushed_windows", sql("SELECT conv_id, start, \"end\" FROM w", items=_ITEMS, w=_windows(20, 2, 0)))
def i03(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ingest.windows(turns(spark, sf_dir), "conv_id", "turn", F.col("text"), 20, 2, 4, flush=True)
    return w.select("conv_id", "start", "end")


@query("i05_unseen_windows", sql("SELECT conv_id, start, sha256(text) AS content_hash FROM w WHERE sha256(text) NOT IN (SELECT sha256(text) FROM w WHERE conv_id % 3 = 0) QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY start, conv_id) = 1", items=_ITEMS, w=_windows(4, 1, 2)))
def i05(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ingest.windows(turns(spark, sf_dir), "conv_id", "turn", ingest.formatted(F.col("role"), F.col("text")), 4, 1, 2)
    return ingest.unseen(w, w.where("conv_id % 3 = 0"), ["content_hash"]).select("conv_id", "start", "content_hash")


@query("s29_conversation_slices", sql("SELECT conv_id, string_agg(line, chr(10) || chr(10) ORDER BY i) AS text FROM items WHERE i BETWEEN 1 AND 2 GROUP BY conv_id", items=_ITEMS))
def s29(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.conversations import slice_text

    return slice_text(turns(spark, sf_dir), 1, 3)


@query("i09_extracted_statements", sql(r"SELECT source_id, CAST(place - 1 AS INT) AS place, sha256(source_id || '#' || (place - 1) || '#' || statement) AS id FROM (SELECT source_id, unnest(s) AS statement, generate_subscripts(s, 1) AS place FROM (SELECT source_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM artifacts))", "artifacts"))
def i09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.extract(artifacts(spark, sf_dir)).select("source_id", "place", "id")


@query("s30_chunked_files", sql("SELECT source_id, CAST(nth AS INT) AS nth, CAST(nth * 900 AS INT) AS start, substr(text, nth * 900 + 1, 1000) AS chunk, sha256(substr(text, nth * 900 + 1, 1000)) AS content_hash FROM (SELECT source_id, text, unnest(range(greatest(1, CAST(ceil((length(text) - 100) / 900) AS BIGINT)))) AS nth FROM artifacts)", "artifacts"))
def s30(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.chunks import chunk

    return chunk(artifacts(spark, sf_dir).select("source_id", "text"), 1000, 100)


@query("s13_reembed")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..fixtures import propositions
    from ..sources.embedding import embed

    return embed(propositions(spark, sf_dir).select("id", "text"))


@query("t12_t13_compressed_contexts")
def t12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.compress import compressed

    a = artifacts(spark, sf_dir)
    return a.select("source_id", compressed(F.col("text"), F.try_element_at(F.split("text", " "), F.lit(2))).alias("context"))


@query("s32_object_graph", sql("SELECT 's' || node AS id, CAST(max(h) AS INT) AS level, CAST((SELECT count(*) FROM supplier WHERE s_suppkey > 0 AND s_suppkey // 2 = node) AS INT) AS n_children FROM up GROUP BY node", recursive=True, up="SELECT s_suppkey AS node, 0 AS h FROM supplier UNION SELECT node // 2, h + 1 FROM up WHERE node > 0"))
def s32(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.object_graph import build
    from ..session import table

    s = table(spark, sf_dir, "supplier")
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    nodes = s.select(name(F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"))
    links = s.where("s_suppkey > 0").select(name(F.floor(F.col("s_suppkey") / 2)).alias("source"), F.lit("leads").alias("field"), name(F.col("s_suppkey")).alias("target"))
    return build(nodes, links).select("id", "level", F.size("children").alias("n_children"))
