"""Retrieval modes: vector, entity, graph walk, temporal and hybrid, rank fusion and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scoring import effective_confidence, last_touched, moment, recall_relevance
from ..operators import graph
from ..operators.query import QuerySpec, query
from ..operators.vectors import top_k
from ..session import checkpoint

FUSION = 60
BASE_CONFIDENCE = 0.5


def clamp(k: int = 10, depth: int = 1, threshold: float = 0.0) -> tuple[int, int, float]:
    return min(max(k, 1), 100), min(max(depth, 1), graph.MAX_DEPTH), min(max(threshold, 0.0), 1.0)


def by_vector(vectors: DataFrame | None, query_vector: list[float] | None, context_id: str, k: int, threshold: float) -> tuple[DataFrame | None, bool]:
    """The hits (id, score), or none for a blank query; and whether the store can search vectors at all."""
    if vectors is None:
        return None, False
    k, _, threshold = clamp(k, threshold=threshold)
    if not query_vector:
        return vectors.select("id", F.lit(0.0).alias("score")).limit(0), True
    return top_k(vectors, query_vector, k, threshold, F.col("context_id") == context_id), True


def by_entity(props: DataFrame, context_id: str, entity_id: str, k: int) -> DataFrame:
    return query(props, QuerySpec(context_id=context_id, entity_id=entity_id, limit=clamp(k)[0]))


def by_walk(props: DataFrame, context_id: str, entity_id: str, depth: int, k: int) -> DataFrame:
    """(id, distance) of propositions met on a walk inside the context, nearest first."""
    k, depth, _ = clamp(k, depth)
    edges = graph.co_mentions(props.where(F.col("context_id") == context_id))
    met = graph.neighborhood(edges, entity_id, depth).select("distance", F.explode("via").alias("id")).groupBy("id").agg(F.min("distance").alias("distance"))
    return met.orderBy("distance", "id").limit(k)


def by_time(props: DataFrame, context_id: str, after: str, before: str, k: int) -> DataFrame:
    """Rows touched in a span, the latest first; the context filters before the limit."""
    rows = props.where((F.col("context_id") == context_id) & last_touched().between(moment(after), moment(before)))
    return rows.orderBy(last_touched().desc(), "id").limit(clamp(k)[0])


def hybrid(hits: DataFrame, walked: DataFrame, k: int) -> DataFrame:
    """(id, tier, score) of vector hits (tier 0) and walked rows (tier 1); a row of both counts as a hit."""
    both = hits.select("id", F.lit(0).alias("tier"), "score").unionByName(walked.select("id", F.lit(1).alias("tier"), F.lit(0.0).alias("score")))
    best = both.groupBy("id").agg(F.min(F.struct("tier", (-F.col("score")).alias("s"))).alias("b"))
    return best.select("id", "b.tier", (-F.col("b.s")).alias("score")).orderBy("tier", F.desc("score"), "id").limit(clamp(k)[0])


def fuse(ranked: list[DataFrame], k: int) -> DataFrame:
    """(id, score) by reciprocal rank over lists (id, rank), ranks from 1."""
    out = None
    for r in ranked:
        part = r.select("id", (F.lit(1.0) / (F.lit(FUSION) + F.col("rank"))).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def _ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """(id, rank) from 1 in that order, of rows that a limit keeps few."""
    return rows.select("id", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def keyword_ranks(props: DataFrame, words: list[str], as_of: str, k: int, pool: int = 10) -> DataFrame:
    """(id, rank) of the k rows with the most keywords, of the ``pool`` times k rows of the greatest effective confidence, which breaks ties, too."""
    best = query(props, QuerySpec(order_by="effective_confidence", as_of=as_of, limit=pool * k))
    hits = best.select("id", text.keyword_hits(F.array(*[F.lit(w) for w in words]).cast("array<string>"), F.col("text")).alias("_hits"), effective_confidence(as_of).alias("_eff"))
    order = (F.desc("_hits"), F.desc("_eff"), F.asc("id"))
    return _ranked(hits.where("_hits > 0").orderBy(*order).limit(k), *order)


def base_query(context_id: str, as_of: str, **narrow: object) -> QuerySpec:
    return QuerySpec(context_id=context_id, statuses=("ACTIVE",), min_effective_confidence=BASE_CONFIDENCE, as_of=as_of).with_(**narrow)


def memory_search(props: DataFrame, context_id: str, hits: DataFrame, words: list[str], as_of: str, k: int, eager: DataFrame | None = None, seeds: int = 4) -> DataFrame:
    """(id, score): the first k vector hits (id, rank), k keyword hits and, where those give fewer than k, 3k rows about the first hits' entities, fused; without eager ids."""
    rows = query(props, base_query(context_id, as_of))
    near = hits.join(rows.select("id"), "id", "left_semi").withColumnRenamed("rank", "_rank").orderBy("_rank", "id").limit(k)
    keyword = checkpoint(keyword_ranks(rows, words, as_of, k))
    lists = [checkpoint(_ranked(near, "_rank", "id")), keyword]
    fresh = lists[0].select("id").unionByName(keyword.select("id")).distinct()
    if eager is not None:
        fresh = fresh.join(eager.select("id"), "id", "left_anti")
    if fresh.count() < k:  # of 2k rows at most
        first = rows.join(F.broadcast(lists[0].unionByName(keyword.withColumn("rank", F.col("rank") + k))), "id").select("rank", F.posexplode("mentions").alias("pos", "m")).where("m.resolved_id IS NOT NULL")
        ids = [r[0] for r in first.groupBy("m.resolved_id").agg(F.min(F.struct("rank", "pos")).alias("at")).orderBy("at", "resolved_id").limit(seeds).collect()]
        if ids:
            about = query(rows, QuerySpec(any_entities=tuple(ids), order_by="effective_confidence", as_of=as_of, limit=3 * k))
            lists.append(_ranked(about, effective_confidence(as_of).desc(), "id"))
    if eager is not None:
        lists = [x.join(eager.select("id"), "id", "left_anti") for x in lists]
    return fuse(lists, k)


def recall(props: DataFrame, context_id: str, words: list[str], as_of: str, k: int = 10) -> DataFrame:
    """(id, relevance) of active rows by overlap, recency and confidence."""
    rows = query(props, QuerySpec(context_id=context_id, statuses=("ACTIVE",)))
    return rows.select("id", recall_relevance(words, as_of).alias("relevance")).orderBy(F.desc("relevance"), "id").limit(k)
