"""Append-only records: projections, collections, processed chunks, domain events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find(records: DataFrame, **equal: object) -> DataFrame:
    """Records whose columns have the given values; all without any. ``stale=True`` stands for the STALE lifecycle."""
    if equal.pop("stale", False):
        equal["lifecycle"] = "STALE"
    out = records
    for name, value in equal.items():
        out = out.where(F.col(name) == value)
    return out


def runs(records: DataFrame) -> DataFrame:
    """(run_id, n, n_propositions) of each run."""
    return records.groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("proposition_id").alias("n_propositions"))


def processed(chunks: DataFrame, history: DataFrame) -> DataFrame:
    """The chunks with ``processed``: whether their context has their content hash in its history."""
    known = history.select("context_id", "content_hash").distinct().withColumn("_known", F.lit(True))
    return chunks.join(known, ["context_id", "content_hash"], "left").withColumn("processed", F.coalesce("_known", F.lit(False))).drop("_known")


def last_bookmarks(history: DataFrame) -> DataFrame:
    """(context_id, source_id, end_index, processed_at): the latest of each source of a context; ties by the greatest end."""
    best = history.groupBy("context_id", "source_id").agg(F.max(F.struct("processed_at", "end_index")).alias("b"))
    return best.select("context_id", "source_id", "b.end_index", "b.processed_at")


def event_stream(changes: DataFrame, at: Column) -> DataFrame:
    """(id, kind, at, detail): one domain event for each change (id, event, was, status)."""
    detail = F.when(F.col("event") == "STATUS_CHANGED", F.concat("was", F.lit("->"), "status"))
    return changes.select("id", F.col("event").alias("kind"), at.alias("at"), detail.alias("detail"))


def fan_out(events: DataFrame, listeners: dict) -> dict[str, str]:
    """Gives the events to every listener; one that fails is reported by its name and stops no other."""
    failed = {}
    for name, listen in listeners.items():
        try:
            listen(events)
        except Exception as e:  # noqa: BLE001 - isolation of listeners is the contract
            failed[name] = str(e)
    return failed
