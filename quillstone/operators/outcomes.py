"""What follows from revision, extraction and resolution: rows to persist, labels and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import last_touched
from ..schema import EDGE_HAS_ENTITY
from .revise import contradicted, merged, reinforced

ACTIONS = ("NEW", "MERGED", "REINFORCED", "CONTRADICTED", "GENERALIZED")
KINDS = ("NEW", "UPDATED", "REFERENCE")


def to_persist(results: DataFrame, new: DataFrame, existing: DataFrame, grounding: Column | None = None) -> DataFrame:
    """The rows that results (id, action, match_id) persist: a new row, the row it merges with or reinforces, or, of a contradiction, both.

    Several results may change one existing row; the one of the greatest confidence stands (ties: the smallest
    new id). ``grounding`` (ids) is added to what the new text gave, never to a contradicted original.
    """
    more = (lambda c: F.array_distinct(F.concat(c, grounding))) if grounding is not None else (lambda c: c)
    fresh = new.join(results.where("action IN ('NEW', 'CONTRADICTED', 'GENERALIZED')").select("id"), "id", "left_semi").withColumn("grounding", more(F.col("grounding")))
    own = new.select(F.col("id").alias("_new"), F.col("confidence").alias("_c"), F.col("grounding").alias("_g"))
    old = results.where("action IN ('MERGED', 'REINFORCED', 'CONTRADICTED')").select(F.col("id").alias("_new"), "action", F.col("match_id").alias("id"))
    rows = old.join(own, "_new").join(existing, "id")
    by = {"MERGED": merged(F.col("confidence"), F.col("decay"), F.col("_c")), "REINFORCED": reinforced(F.col("confidence"), F.col("decay"), F.col("_c")), "CONTRADICTED": contradicted(F.col("confidence"), F.col("decay"), F.col("pinned"))}
    pick = lambda k, default: reduce(lambda out, a: F.when(F.col("action") == a, by[a][k]).otherwise(out), by, default)
    against = (F.col("action") == "CONTRADICTED") & ~F.col("pinned")
    change = F.struct(
        (-pick(0, F.col("confidence"))).alias("_order"),
        "_new",
        pick(0, F.col("confidence")).alias("confidence"),
        pick(1, F.col("decay")).alias("decay"),
        F.when(against, "CONTRADICTED").otherwise(F.col("status")).alias("status"),
        F.when(F.col("action") == "CONTRADICTED", F.col("reinforce_count")).otherwise(F.col("reinforce_count") + 1).alias("reinforce_count"),
        F.when(F.col("action") == "CONTRADICTED", F.col("grounding")).otherwise(more(F.array_distinct(F.concat("grounding", "_g")))).alias("grounding"),
    )
    best = rows.select("id", change.alias("_change")).groupBy("id").agg(F.min("_change").alias("_change"))
    changed = ("confidence", "decay", "status", "reinforce_count", "grounding")
    revised = existing.join(best, "id").select(*[F.col(f"_change.{c}").cast(existing.schema[c].dataType).alias(c) if c in changed else F.col(c) for c in existing.columns])
    return fresh.unionByName(revised, allowMissingColumns=True)


def extraction_counts(results: DataFrame) -> DataFrame:
    """One row: the results of each action, and all."""
    return results.agg(*[F.count_if(F.col("action") == a).alias(a.lower()) for a in ACTIONS], F.count_if(F.col("action").isin(*ACTIONS)).alias("total"))


def action_label(action: Column) -> Column:
    return F.when(action == "NEW", "CREATED").otherwise(action)


def full_rows(props: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """The row that is given out: without the clocks and the counters, with what revision did to it (null if it was not revised)."""
    if results is None:
        rows = props.withColumn("action", F.lit(None).cast("string"))
    else:
        rows = props.join(results.select("id", action_label(F.col("action")).alias("action")), "id", "left")
    return rows.select("id", "context_id", "text", "mentions", "confidence", "decay", "reasoning", "grounding", "provenance", "created", last_touched().alias("revised"), "last_accessed", "status", "action")


def chunk_entities(found: DataFrame) -> DataFrame:
    """(id, kind, chunk_id, name, labels) from (chunk_id, place, id, kind, name, labels): an entity of several chunks once for each kind, as its first chunk has it."""
    return found.groupBy("id", "kind").agg(F.min(F.struct("place", "chunk_id", "name", "labels")).alias("b")).select("id", "kind", "b.chunk_id", "b.name", "b.labels")


def entity_counts(entities: DataFrame) -> DataFrame:
    """One row: new, updated and reference-only entities, and all."""
    return entities.agg(*[F.count_if(F.col("kind") == k).alias(k.lower()) for k in KINDS], F.count_if(F.col("kind").isin(*KINDS)).alias("total"))


def entity_edges(found: DataFrame) -> DataFrame:
    """(source, type, target): each chunk with the entities to persist that were found in it, once; reference-only ones have no edge."""
    return found.where("kind IN ('NEW', 'UPDATED')").select(F.col("chunk_id").alias("source"), F.lit(EDGE_HAS_ENTITY).alias("type"), F.col("id").alias("target")).distinct()


def agreed_edges(found: DataFrame, least: int = 2) -> DataFrame:
    """(source_id, target_id, type, n): edges that enough analyzers found."""
    return found.groupBy("source_id", "target_id", "type").agg(F.count_distinct("analyzer").alias("n")).where(F.col("n") >= least)


def batch_completed(projected: DataFrame) -> DataFrame:
    """The event at the end of a projection, one row: (succeeded, skipped, failed, total)."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    return projected.agg(n("PROJECTED").alias("succeeded"), n("SKIPPED").alias("skipped"), n("FAILED").alias("failed"), F.count("*").alias("total"))


def reason_summary(projected: DataFrame) -> DataFrame:
    """One row, ``summary``: how many were projected, and how many not for each reason, the commonest first."""
    counts = projected.groupBy("outcome", "reason").agg(F.count("*").alias("n"))
    own = F.sort_array(F.collect_list(F.when(F.col("outcome") != "PROJECTED", F.struct((-F.col("n")).alias("o"), F.coalesce("reason", F.lit("unknown")).alias("reason"), F.col("n")))))
    text = F.array_join(F.transform(own, lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["reason"])), "; ")
    done = F.coalesce(F.sum(F.when(F.col("outcome") == "PROJECTED", F.col("n"))), F.lit(0))
    return counts.agg(F.concat(done.cast("string"), F.lit(" projected; "), text).alias("summary"))
