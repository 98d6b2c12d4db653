"""Objects built bottom up: a node is ready when all that it refers to are."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: After so many levels, those that are done are written as one table.
MERGED = 8


def build(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, name, level, children) from nodes (id, name) and links (source, field, target).

    Leaves have level 0, others one more than their highest child. Links to unknown nodes are dropped;
    nodes on a cycle are never ready and left out.
    """
    known = links.join(nodes.select(F.col("id").alias("target")), "target", "left_semi").join(nodes.select(F.col("id").alias("source")), "source", "left_semi").distinct()
    known = checkpoint(known)
    done = checkpoint(nodes.select("id").join(known.select(F.col("source").alias("id")), "id", "left_anti").withColumn("level", F.lit(0)))
    for level in count(1):
        open_ = known.join(done.select(F.col("id").alias("source")), "source", "left_anti")
        waits = open_.join(done.select(F.col("id").alias("target")), "target", "left_anti").select("source").distinct()
        ready = checkpoint(open_.select("source").distinct().join(waits, "source", "left_anti").select(F.col("source").alias("id"), F.lit(level).alias("level")))
        if ready.isEmpty():
            break
        done = done.unionByName(ready)
        if level % MERGED == 0:
            done = checkpoint(done)
    children = known.groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_list(F.struct("field", "target"))).alias("children"))
    empty = F.array().cast("array<struct<field:string,target:string>>")
    return nodes.join(done, "id").join(children, "id", "left").withColumn("children", F.coalesce("children", empty))
