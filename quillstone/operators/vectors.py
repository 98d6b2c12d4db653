"""Vector search: top-k, filtered top-k, similar pairs, clusters.

Pairs are found exactly by blocked matrix products. The vectors of a context are dealt by hash into
blocks of about one size; every pair of blocks is a task that multiplies two matrices. A vector is shuffled once
for each block of its own context, so the work is the square of a context, not of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import cosine
from ..session import ready

BLOCK = 2048


def top_k(vectors: DataFrame, query_vector: list[float], k: int, threshold: float = 0.0, where: Column | None = None) -> DataFrame:
    """The k most similar rows (id, score), of those that pass ``where``, which is applied before the search."""
    rows = vectors if where is None else vectors.where(where)
    scored = rows.select("id", cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query_vector])).alias("score"))
    return scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), "id").limit(k)


def _first(a: np.ndarray, b: np.ndarray, score: np.ndarray, k: int | None) -> tuple[np.ndarray, ...]:
    """Of the pairs the k most similar of each a (ties: the smallest b), or all."""
    if k is None or not len(a):
        return a, b, score
    rows = pd.DataFrame({"a": a, "b": b, "s": score}).sort_values(["a", "s", "b"], ascending=[True, False, True]).groupby("a").head(k)
    return rows["a"].to_numpy(), rows["b"].to_numpy(), rows["s"].to_numpy()


def _products(threshold: float, k: int | None = None) -> Callable:
    def run(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups:
            m = np.stack(g["embedding"].to_numpy()).astype(np.float64)
            size = np.sqrt((m * m).sum(axis=1))
            m = np.divide(m, size[:, None], out=np.zeros_like(m), where=size[:, None] > 0)
            ids, side = g["id"].to_numpy(), g["side"].to_numpy()
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(b):
                b = a
            s = m[a] @ m[b].T
            i, j = np.nonzero(s >= threshold)
            left, right, score = ids[a[i]], ids[b[j]], s[i, j]
            ok = left < right if len(b) and b is a else left != right
            left, right, score = left[ok], right[ok], score[ok]
            swap = left > right
            left, right, score = _first(np.where(swap, right, left), np.where(swap, left, right), score, k)
            yield pd.DataFrame({"id_a": left, "id_b": right, "score": score})

    return run


def similar_pairs(vectors: DataFrame, threshold: float, block: int = BLOCK, k: int | None = None) -> DataFrame:
    """(id_a < id_b, score) of all pairs of a context with a cosine of at least the threshold. Vectors of null are left out.

    With ``k`` a pair of blocks gives only the ``k`` most similar of each ``id_a`` (ties: the smallest ``id_b``),
    among which are those of all blocks.
    """
    ready(vectors.sparkSession)
    rows = vectors.where("embedding IS NOT NULL").select("context_id", "id", "embedding")
    count = rows.groupBy("context_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = rows.join(count, "context_id").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = rows.select("context_id", "id", "embedding", "blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    tiles = spread.select("context_id", "id", "embedding", F.least("blk", "with").alias("i"), F.greatest("blk", "with").alias("j"), F.when(F.col("blk") <= F.col("with"), 0).otherwise(1).alias("side"))

    def tile(g: pd.DataFrame) -> pd.DataFrame:
        return next(_products(threshold, k)(iter([g])))

    return tiles.groupBy("context_id", "i", "j").applyInPandas(tile, "id_a string, id_b string, score double")


def clusters(vectors: DataFrame, threshold: float, k: int, block: int = BLOCK) -> DataFrame:
    """For each anchor the k most similar of the ids greater than it: (anchor_id, similar, size)."""
    ranked = similar_pairs(vectors, threshold, block, k).withColumn("rank", F.row_number().over(Window.partitionBy("id_a").orderBy(F.desc("score"), "id_b"))).where(F.col("rank") <= k)
    return ranked.groupBy(F.col("id_a").alias("anchor_id")).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id_b").alias("id"), "score"))).alias("similar")).withColumn("size", F.size("similar"))
