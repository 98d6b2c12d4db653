"""Sets of words that overlap enough, found by the rarest of their words.

Of two sets that share ``need`` words, each without its ``need - 1`` commonest words still has one of them.
How many are needed depends on both sizes, so a word is a join key together with the two classes of
size: a word that all short sets share joins none of those that must share more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes that are a class of their own; beyond them a class is a tenth wider than the last.
OWN, WIDER = 16, 1.1


def _class(n: Column) -> Column:
    return F.when(n <= OWN, n).otherwise(OWN + F.floor(F.log(n / F.lit(float(OWN))) / F.log(F.lit(WIDER)) + 1e-9)).cast("int")


def _least(c: Column) -> Column:
    """No more than the smallest size of a class."""
    return F.when(c <= OWN, c).otherwise(F.floor(OWN * F.pow(F.lit(WIDER), c - OWN) - 1e-6)).cast("double")


def meetings(a: DataFrame, b: DataFrame, key: str, words_a: str, words_b: str, ratio: float, need: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows of a with rows of b of the same key, columns of both, for every pair of sets that shares enough words; a pair may come more than once, and others may, too.

    ``need`` gives how many words sets of two sizes must share, growing with both; a set is ``ratio`` of the
    other's size at least. All other columns of a and b have different names, and each row is another.
    """
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = lambda df, c: df.where(F.size(c) > 0).select(key, F.explode(c).alias("_w"))
    counts = listed(a, words_a).unionByName(listed(b, words_b)).groupBy(key, "_w").agg(F.count("*").alias("_n"))

    def posted(df: DataFrame, c: str, own: str, other: str) -> DataFrame:
        rest = [x for x in df.columns if x not in (key, c)]
        rows = df.select(key, *rest, F.explode(c).alias("_w")).join(counts.hint("merge"), [key, "_w"])
        rows = rows.groupBy(key, *rest).agg(F.sort_array(F.collect_list(F.struct("_n", "_w")))["_w"].alias(c))
        n = F.size(c)
        rows = rows.withColumn(own, _class(n)).withColumn(other, F.explode(F.sequence(_class(F.greatest(F.lit(1), F.ceil(n * ratio - 1e-6))), _class(F.floor(n / F.lit(ratio) + 1e-6)))))
        least = F.greatest(F.lit(1.0), F.ceil(need(_least(F.col(own)), _least(F.col(other))) - 1e-6)).cast("int")
        return rows.withColumn("_w", F.explode(F.slice(c, F.lit(1), F.greatest(F.lit(0), n - least + 1))))

    keys = [key, "_w", "_ca", "_cb"]
    left, right = posted(a, words_a, "_ca", "_cb"), posted(b, words_b, "_cb", "_ca")
    return left.repartition(parts, *keys).hint("merge").join(right.repartition(parts, *keys), keys).drop("_w", "_ca", "_cb")
