"""Decay sweeps, mark-and-sweep collection, and the cascade into projection records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import effective_confidence, utility
from ..schema import STRENGTH
from .store import mark_stale

RETIRE, REVIVE = 0.1, 0.2


def next_status(as_of: str, retire: float = RETIRE, revive: float = REVIVE) -> Column:
    """With hysteresis: an active row of little utility goes stale, a stale one of more comes back; pinned rows stay."""
    u = utility(as_of)
    return F.when(F.col("pinned"), F.col("status")).when((F.col("status") == "ACTIVE") & (u < retire), "STALE").when((F.col("status") == "STALE") & (u > revive), "ACTIVE").otherwise(F.col("status"))


def decay_sweep(props: DataFrame, as_of: str, targets: tuple[str, ...] = ("ACTIVE",), prune_below: float | None = None) -> DataFrame:
    """The targeted rows with ``new_status`` and ``sweep``: REVIVED, TRANSITIONED, PRUNED or SKIPPED."""
    rows = props.where(F.col("status").isin(*targets)).withColumn("new_status", next_status(as_of))
    changed = F.col("new_status") != F.col("status")
    prune = F.lit(False) if prune_below is None else ~F.col("pinned") & (utility(as_of) < prune_below)
    return rows.withColumn("sweep", F.when(prune, "PRUNED").when(changed & (F.col("new_status") == "ACTIVE"), "REVIVED").when(changed, "TRANSITIONED").otherwise("SKIPPED"))


def decay_marks(props: DataFrame, as_of: str, retire_below: float = RETIRE) -> DataFrame:
    """(proposition_id, reason, survivor_id, strategy) of rows that have faded."""
    gone = props.where(~F.col("pinned") & (effective_confidence(as_of) < retire_below))
    return gone.select(F.col("id").alias("proposition_id"), F.lit("stale").alias("reason"), F.lit(None).cast("string").alias("survivor_id"), F.lit("decay").alias("strategy"))


def duplicate_marks(scored: DataFrame, components: DataFrame) -> DataFrame:
    """Of each component (node, root) all but the survivor: the greatest of (effective, reinforce_count, id)."""
    rows = scored.join(components, scored["id"] == components["node"]).select("id", "root", F.struct("effective", "reinforce_count", "id").alias("fit"))
    best = rows.groupBy("root").agg(F.max("fit").alias("best"))
    losers = rows.join(best, "root").where(F.col("id") != F.col("best.id"))
    return losers.select(F.col("id").alias("proposition_id"), F.lit("duplicate").alias("reason"), F.col("best.id").alias("survivor_id"), F.lit("duplicate").alias("strategy"))


def collect(props: DataFrame, marks: DataFrame, target: str = "STALE", hard_delete: bool = False, dry_run: bool = False) -> DataFrame:
    """(id, outcome, reasons, new_status) of each marked row; pinned rows, and those already there, are skipped."""
    reasons = marks.groupBy(F.col("proposition_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))
    rows = props.select("id", "status", "pinned").join(reasons, "id")
    skip = F.col("pinned") | (F.col("status") == target)
    done = "HARD_DELETED" if hard_delete else "TRANSITIONED"
    outcome = F.when(skip, "SKIPPED").otherwise("MARKED" if dry_run else done)
    return rows.select("id", outcome.alias("outcome"), "reasons", F.when(outcome == "TRANSITIONED", target).otherwise(F.col("status")).alias("new_status"))


def apply_collection(props: DataFrame, collected: DataFrame) -> DataFrame:
    """The rows after a collection."""
    out = props.join(collected.select("id", "outcome", "new_status"), "id", "left").where("outcome IS NULL OR outcome <> 'HARD_DELETED'")
    return out.withColumn("status", F.coalesce("new_status", "status")).drop("outcome", "new_status")


def stale_cascade(records: DataFrame, changes: DataFrame) -> DataFrame:
    """Projection records of rows that became SUPERSEDED, CONTRADICTED or STALE."""
    return mark_stale(records, changes.where(F.col("new_status").isin("SUPERSEDED", "CONTRADICTED", "STALE")))


def strongest(saves: DataFrame) -> DataFrame:
    """One row an id: that of the strongest status."""
    strength = F.create_map(*[F.lit(x) for pair in STRENGTH.items() for x in pair])
    w = Window.partitionBy("id").orderBy(F.desc(strength[F.col("status")]), *[c for c in saves.columns if c not in ("id", "status")])
    return saves.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
