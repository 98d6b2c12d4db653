"""R* retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import AS_OF, propositions, provenance, vectors
from ..functions.scoring import effective_confidence
from ..operators import graph
from ..operators.query import query as run
from ..operators.store import with_provenance
from ..plans import retrieval
from .graphs import _bfs
from .registry import query
from .sql import sql


def _vector(spark: SparkSession, sf_dir: str, name: str) -> list[float]:
    return vectors(spark, sf_dir).where(F.col("id") == name).first()["embedding"]


_Q = "(SELECT embedding FROM vectors WHERE id = 'vec-11')"


@query("r02_vector_mode", sql(f"SELECT id, round(list_cosine_similarity(embedding, {_Q}), 6) AS score FROM vectors WHERE context_id = 'lab-4' AND list_cosine_similarity(embedding, {_Q}) >= 0.0100007 ORDER BY score DESC, id LIMIT 15", "vectors"))
def r02(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, _ = retrieval.by_vector(vectors(spark, sf_dir), _vector(spark, sf_dir, "vec-11"), "lab-4", 15, 0.0100007)
    return hits.select("id", F.round("score", 6).alias("score"))


@query("r03_entity_mode", sql("SELECT id FROM props WHERE context_id = 'ctx-5' AND id IN (SELECT proposition_id FROM mentions WHERE resolved_id = 'type-view') ORDER BY id LIMIT 12", "props", "mentions"))
def r03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.by_entity(propositions(spark, sf_dir), "ctx-5", "type-view", 12).select("id")


_WALK = {"own": "SELECT a, b, p FROM edges JOIN props0 ON id = p WHERE context_id = 'ctx-3'", **_bfs("own", "user-13", 2)}
_MET = "SELECT e.p AS id, CAST(min(x.d) AS INT) AS distance FROM dist x JOIN own e ON e.b = x.node JOIN dist y ON y.node = e.a AND y.d = x.d - 1 WHERE x.d > 0 GROUP BY e.p"


@query("r04_graph_walk_mode", sql(f"{_MET} ORDER BY distance, id LIMIT 40", "edges", recursive=True, **_WALK))
def r04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.by_walk(propositions(spark, sf_dir), "ctx-3", "user-13", 2, 40)


@query("r05_temporal_mode", sql("SELECT id FROM props WHERE context_id = 'ctx-8' AND touched BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00' ORDER BY touched DESC, id LIMIT 30", "props"))
def r05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.by_time(propositions(spark, sf_dir), "ctx-8", "2024-01-05 00:00:00", "2024-01-25 00:00:00", 30).select("id")


_HITS = "SELECT id, importance AS score FROM props WHERE context_id = 'ctx-3' AND importance >= 0.9"


@query("r06_u02_o08_hybrid_mode", sql(f"SELECT id, CAST(tier AS INT) AS tier, round(score, 6) AS score FROM (SELECT id, 0 AS tier, score FROM hits UNION ALL SELECT id, 1, 0.0 FROM ({_MET}) WHERE id NOT IN (SELECT id FROM hits)) ORDER BY tier, score DESC, id LIMIT 60", "edges", "props", recursive=True, hits=_HITS, **_WALK))
def r06(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propositions(spark, sf_dir)
    hits = p.where("context_id = 'ctx-3' AND importance >= 0.9").select("id", F.col("importance").alias("score"))
    return retrieval.hybrid(hits, retrieval.by_walk(p, "ctx-3", "user-13", 2, 100), 60).select("id", "tier", F.round("score", 6).alias("score"))


_BASE = "SELECT * FROM props WHERE context_id = 'ctx-6' AND status = 'ACTIVE' AND eff >= 0.5"
_KEYS = "len(list_filter(['purchase', 'error', 'user 1'], lambda w: contains(lower(text), w)))"


@query("r07_w04_memory_search", sql("SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM near WHERE rank <= 10 UNION ALL SELECT * FROM keyed WHERE rank <= 10 UNION ALL SELECT * FROM related) WHERE id NOT IN (SELECT id FROM props WHERE pinned) GROUP BY id ORDER BY score DESC, id LIMIT 10", "props", "mentions", base=_BASE, near="SELECT id, row_number() OVER (ORDER BY importance DESC, id) AS rank FROM base WHERE importance > 0.85", pool="SELECT id, eff, " + _KEYS + " AS hits FROM base ORDER BY eff DESC, id LIMIT 100", keyed="SELECT id, row_number() OVER (ORDER BY hits DESC, eff DESC, id) AS rank FROM pool WHERE hits > 0", seq="SELECT id, rank AS r FROM near WHERE rank <= 10 UNION ALL SELECT id, rank + 10 FROM keyed WHERE rank <= 10", seeds="SELECT resolved_id FROM seq JOIN mentions ON proposition_id = id WHERE resolved_id IS NOT NULL GROUP BY resolved_id ORDER BY min((r, pos)), resolved_id LIMIT 4", related="SELECT id, row_number() OVER (ORDER BY eff DESC, id) AS rank FROM (SELECT DISTINCT id, eff FROM base JOIN mentions ON proposition_id = id WHERE resolved_id IN (SELECT resolved_id FROM seeds) ORDER BY eff DESC, id LIMIT 30) WHERE (SELECT count(DISTINCT id) FROM seq WHERE id NOT IN (SELECT id FROM props WHERE pinned)) < 10"))
def r07(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propositions(spark, sf_dir)
    hits = p.where("context_id = 'ctx-6' AND importance > 0.85").select("id", F.row_number().over(Window.partitionBy("context_id").orderBy(F.desc("importance"), "id")).alias("rank"))
    out = retrieval.memory_search(p, "ctx-6", hits, ["purchase", "error", "user 1"], AS_OF, 10, eager=p.where("pinned").select("id"))
    return out.select("id", F.round("score", 9).alias("score"))


@query("r08_list_all", sql("SELECT id, round(eff, 6) AS effective FROM props WHERE context_id = 'ctx-6' AND status = 'ACTIVE' AND eff >= 0.5 ORDER BY eff DESC, id LIMIT 50", "props"))
def r08(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = retrieval.base_query("ctx-6", AS_OF, order_by="effective_confidence", limit=50)
    return run(propositions(spark, sf_dir), spec).select("id", F.round(effective_confidence(AS_OF), 6).alias("effective"))


@query("r09_base_query", sql("SELECT id FROM props WHERE context_id = 'ctx-6' AND status = 'ACTIVE' AND eff >= 0.5 AND importance >= 0.3", "props"))
def r09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(propositions(spark, sf_dir), retrieval.base_query("ctx-6", AS_OF, min_importance=0.3)).select("id")


@query("r10_recall", sql("SELECT id, round(0.4 * len(list_intersect(['click', 'user'], string_split(text, ' '))) / 2.0::DOUBLE + 0.3 * exp(-(epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(content_revised)) / 1000000.0::DOUBLE / 86400.0::DOUBLE) + 0.3 * confidence, 6) AS relevance FROM props WHERE context_id = 'ctx-2' AND status = 'ACTIVE' ORDER BY relevance DESC, id LIMIT 10", "props"))
def r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.recall(propositions(spark, sf_dir), "ctx-2", ["click", "user"], AS_OF).select("id", F.round("relevance", 6).alias("relevance"))


@query("r12_decorated_hits", sql("SELECT id, coalesce(sources, '') AS sources, people FROM (SELECT id FROM props WHERE context_id = 'ctx-2') p LEFT JOIN (SELECT proposition_id, string_agg(substr(display, 1, 80), '; ' ORDER BY pos) AS sources FROM provenance WHERE pos < 2 GROUP BY 1) s ON s.proposition_id = id JOIN (SELECT proposition_id, string_agg(substr(span, 1, 40), ', ' ORDER BY pos) AS people FROM mentions WHERE pos < 4 GROUP BY 1) m ON m.proposition_id = id", "props", "provenance", "mentions"))
def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_provenance(propositions(spark, sf_dir).where("context_id = 'ctx-2'"), provenance(spark, sf_dir))
    short = lambda c, f, most, size, sep: F.array_join(F.transform(F.slice(c, 1, most), lambda x: F.substring(x[f], 1, size)), sep)
    return rows.select("id", short(F.col("provenance"), "display", 2, 80, "; ").alias("sources"), short(F.col("mentions"), "span", 4, 40, ", ").alias("people"))
