"""Mixing sources to target weights by weighted fair queueing.

Within each source the documents are shuffled by the hash of their id. A document's virtual finish
time is the number of its source's tokens up to and with it, divided by the source's weight. In order
of that time each source is served in proportion to its weight until it runs out, at whatever place
the order is cut. It is cut before the first document with which the tokens would exceed the budget.

No window covers a whole source or the whole corpus: running sums are taken inside ranges of the
shuffle hash and of the finish time, on top of the sums of the earlier ranges, so a hot source is
spread over as many tasks as there are ranges. Ranges of finish times lie between quantiles, so that they
are about equally full whatever the weights; equal times are never parted.

Defined results
    null or empty text: no token; it finishes with the document before it and costs nothing.
    null source: the source ``NONE``. Sources without a weight take ``default_weight``; a weight of 0
    leaves the source out. null doc_id: shuffled by the hash of the empty string.
    ties: by shuffle hash, doc_id (null first) and tokens; rows that repeat all of these are interchangeable.
    Empty table, or a budget below the first document: no row. Extra columns are ignored by ``mixture``
    and kept by ``take_mixture``.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, ready

NONE = "(none)"
SEED = "mix"
RANGES = 4096
#: Ranges of finish times, and the accuracy of the quantiles between them.
TIME_RANGES, ACCURACY = 2048, 20_000
#: Sources up to this many have their cuts broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def _keys(docs: DataFrame) -> list[Column]:
    text, doc = docs["text"].cast("string"), docs["doc_id"].cast("bigint")
    return [
        doc.alias("doc_id"),
        F.coalesce(docs["source"].cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit("[^ \t\n\r\f]+")), F.lit(0)).cast("bigint").alias("n_tokens"),
        F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc.cast("string"), F.lit("")))).alias("key"),
    ]


def _queued(docs: DataFrame, weights: dict[str, float], default_weight: float) -> DataFrame:
    """Every document of a weighted source with its virtual finish time."""
    ready(docs.sparkSession)
    weight = F.lit(float(default_weight))
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    base = checkpoint(docs.select(*_keys(docs)).withColumn("weight", weight).where("weight > 0").withColumn("range", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")))
    sums = base.groupBy("source", "range").agg(F.sum("n_tokens").alias("own"))
    before = sums.select("source", "range", (F.sum("own").over(Window.partitionBy("source").orderBy("range")) - F.col("own")).alias("before"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    run = base.withColumn("inside", F.sum("n_tokens").over(inside)).join(before, ["source", "range"])
    return run.select("doc_id", "source", "n_tokens", "key", ((F.col("before") + F.col("inside")).cast("double") / F.col("weight")).alias("finish"))


def _cut(docs: DataFrame, weights: dict[str, float], default_weight: float, budget_tokens: int | None, budget_fraction: float) -> DataFrame:
    """The documents inside the budget, with their place in the order of finish times."""
    queued = checkpoint(_queued(docs, weights, default_weight))
    ranks = [k / TIME_RANGES for k in range(1, TIME_RANGES)]
    cuts, total = queued.agg(F.percentile_approx("finish", ranks, ACCURACY), F.sum("n_tokens")).first()
    budget = budget_tokens if budget_tokens is not None else int(budget_fraction * (total or 0))
    edges = [float("-inf"), *sorted(set(cuts or ())), float("inf")]
    timed = Bucketizer(splits=edges, inputCol="finish", outputCol="slot").transform(queued) if len(edges) > 2 else queued.withColumn("slot", F.lit(0.0))
    sums = timed.groupBy("slot").agg(F.sum("n_tokens").alias("own"), F.count("*").alias("docs"))
    upto = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)  # over TIME_RANGES rows at most
    sums = sums.select("slot", (F.sum("own").over(upto) - F.col("own")).alias("tokens_before"), (F.sum("docs").over(upto) - F.col("docs")).alias("docs_before"))
    inside = Window.partitionBy("slot").orderBy("finish", "key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = timed.withColumn("tokens", F.sum("n_tokens").over(inside)).withColumn("nth", F.count("*").over(inside)).join(sums.where(F.col("tokens_before") <= budget), "slot")
    return placed.where(F.col("tokens_before") + F.col("tokens") <= budget).select("doc_id", "source", "n_tokens", "key", "finish", (F.col("docs_before") + F.col("nth")).alias("position"))


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, budget_tokens: int | None = None, budget_fraction: float = 0.8) -> DataFrame:
    """(doc_id, source, n_tokens, finish, position) of the documents taken, range-sorted by position.

    The budget is ``budget_tokens``, or else ``budget_fraction`` of the weighted sources' tokens.
    """
    return _cut(docs, weights or {}, default_weight, budget_tokens, budget_fraction).select("doc_id", "source", "n_tokens", F.round("finish", 6).alias("finish"), "position").orderBy("position")


def take_mixture(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, budget_tokens: int | None = None, budget_fraction: float = 0.8) -> DataFrame:
    """The documents of the mixture, with all their columns.

    A source is always taken as a prefix of its shuffled order, so one cut a source decides; texts aren't shuffled.
    """
    taken = _cut(docs, weights or {}, default_weight, budget_tokens, budget_fraction)
    cuts = checkpoint(taken.groupBy("source").agg(F.max(F.struct("key", "doc_id", "n_tokens")).alias("_cut")).withColumnRenamed("source", "_source"))
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    doc, source, tokens, key = _keys(docs)
    place = F.struct(key, doc, tokens)
    return docs.join(cuts, (source == cuts["_source"]) & (place <= cuts["_cut"]), "left_semi")
