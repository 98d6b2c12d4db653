"""Conversations as growing sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..plans.ingest import formatted


def slice_text(turns: DataFrame, start: int, end: int) -> DataFrame:
    """(conv_id, text): the turns from start up to end of each conversation, a blank line between."""
    rows = numbered(turns, "conv_id", "turn").where((F.col("_i") >= start) & (F.col("_i") < end))
    parts = F.sort_array(F.collect_list(F.struct("_i", formatted(F.col("role"), F.col("text")).alias("line"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n\n").alias("text"))
