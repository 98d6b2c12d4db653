"""Maintenance cycles over one snapshot of the store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import effective_confidence, moment
from ..operators import consolidate, lifecycle
from ..operators.lifecycle import strongest
from ..session import checkpoint

LEAST_NEW = 10


@dataclass
class Cycle:
    saves: DataFrame
    report: DataFrame
    failed: dict[str, str] = field(default_factory=dict)


def due(active: DataFrame, last_count: DataFrame | None = None, least: int = LEAST_NEW) -> DataFrame:
    """(context_id, n) of contexts with enough new active rows since their last cycle (context_id, n)."""
    now = active.where("status = 'ACTIVE'").groupBy("context_id").agg(F.count("*").alias("n"))
    if last_count is None:
        return now.where(F.col("n") >= least)
    before = last_count.select("context_id", F.col("n").alias("_n"))
    return now.join(before, "context_id", "left").where(F.col("n") - F.coalesce("_n", F.lit(0)) >= least).select("context_id", "n")


def dream(props: DataFrame, passes: dict[str, Callable[[DataFrame], DataFrame]]) -> Cycle:
    """Runs every pass over the same active rows; what they save, (id, status), is brought to one row an id by the strongest status.

    A pass that fails is reported and leaves the others alone.
    """
    snapshot = props.where("status = 'ACTIVE'")
    parts, failed = None, {}
    for name, run in passes.items():
        try:
            part = checkpoint(run(snapshot).select("id", "status"))
        except Exception as e:  # noqa: BLE001 - isolation of passes is the contract
            failed[name] = str(e)
            continue
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = snapshot.select("id", "status").limit(0)
    saves = strongest(parts)
    known = snapshot.select("id").withColumn("_known", F.lit(True))
    counted = saves.join(known, "id", "left").agg(F.count_if(F.col("_known") & (F.col("status") != "ACTIVE")).alias("transitioned"), F.count_if(F.col("_known").isNull()).alias("created"))
    return Cycle(saves, snapshot.agg(F.count("*").alias("examined")).crossJoin(counted), failed)


@dataclass
class Maintenance:
    """The rows after a cycle, and what each stage did; None for a stage that wasn't asked for."""

    rows: DataFrame
    consolidated: DataFrame | None = None
    abstractions: DataFrame | None = None
    superseded: DataFrame | None = None
    retired: DataFrame | None = None
    collected: DataFrame | None = None


def _saved(props: DataFrame, session: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows with promoted session rows, and reinforced or merged ones' confidence; of several changes to a row a merge stands, then the greatest confidence."""
    promoted = session.join(kept.where("action = 'PROMOTED'").select("id"), "id", "left_semi").withColumn("status", F.lit("ACTIVE"))
    changed = kept.where("action IN ('REINFORCED', 'MERGED')").groupBy(F.col("match_id").alias("id")).agg(F.min(F.struct("action", (-F.col("confidence")).alias("c"))).alias("_b"))
    after = props.join(promoted.select("id"), "id", "left_anti").join(changed, "id", "left").withColumn("confidence", F.coalesce(-F.col("_b.c"), "confidence")).drop("_b")
    return after.unionByName(promoted, allowMissingColumns=True)


def maintain(props: DataFrame, as_of: str, session: DataFrame | None = None, abstract: Callable[[Column], Column] | None = None, least: int = 3, retire_below: float | None = None, decay_k: float = 2.0, collect: bool = False) -> Maintenance:
    """Consolidates a session into the active rows, abstracts groups of level 0, retires faded rows for good (pinned ones, too), and collects.

    Each stage is left out unless asked for, and works on what the one before left. Sources of an abstraction are SUPERSEDED.
    """
    active = lambda rows: rows.where("status = 'ACTIVE'")
    out = Maintenance(props)
    if session is not None:
        out.consolidated = checkpoint(consolidate.consolidate(session, active(out.rows)))
        out.rows = checkpoint(_saved(out.rows, session, out.consolidated))
    if abstract is not None:
        ground = active(out.rows).where("level = 0")
        out.abstractions = checkpoint(consolidate.abstractions(ground, least, abstract))
        out.superseded = checkpoint(consolidate.entity_groups(ground, least).select(F.explode("members").alias("id")).distinct())
        now = moment(as_of)
        fresh = out.abstractions.select("id", "text", "context_id", "level", "decay", "confidence", F.lit("ACTIVE").alias("status"), F.lit(False).alias("pinned"), now.alias("created"), now.alias("content_revised"), now.alias("metadata_revised"))
        gone = out.superseded.withColumn("_gone", F.lit(True))
        rows = out.rows.join(gone, "id", "left").withColumn("status", F.when(F.col("_gone"), "SUPERSEDED").otherwise(F.col("status"))).drop("_gone")
        out.rows = checkpoint(rows.unionByName(fresh, allowMissingColumns=True))
    if retire_below is not None:
        out.retired = checkpoint(active(out.rows).where(effective_confidence(as_of, decay_k) < retire_below).select("id"))
        out.rows = out.rows.join(out.retired, "id", "left_anti")
    if collect:
        out.collected = checkpoint(lifecycle.collect(out.rows, lifecycle.decay_marks(active(out.rows), as_of)))
        out.rows = lifecycle.apply_collection(out.rows, out.collected)
    return out
