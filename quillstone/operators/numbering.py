"""Places of rows within a group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint


def numbered(rows: DataFrame, key: str, order: str, place: str = "_i", count: str = "_n") -> DataFrame:
    """The rows with their place in their group, from 0 in ascending order (null first, ties in any order), and the group's number of rows.

    Rows are dealt into ranges of (key, order), counted, and numbered inside their range on top of the
    earlier ranges' counts, so a group of any size is spread over as many tasks as it fills ranges.
    """
    ranged = checkpoint(rows.repartitionByRange(key, order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(key, "_range").agg(F.count("*").alias("_own"))
    upto = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col(key).alias("_key"), F.col("_range").alias("_at"), F.coalesce(F.sum("_own").over(upto), F.lit(0)).alias("_before"), F.sum("_own").over(Window.partitionBy(key)).alias(count))
    inside = F.row_number().over(Window.partitionBy(key, "_range").orderBy(order)) - 1
    placed = ranged.withColumn("_inside", inside).join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")))
    return placed.withColumn(place, F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_key", "_at", "_before")
