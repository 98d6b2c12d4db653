"""Revision of new propositions against those of their context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import resolved_ids, text_words
from ..functions.text import canonical
from ..session import checkpoint
from .overlap import meetings

AUTO_MERGE, SIMILAR, REINFORCE, CANDIDATES = 0.95, 0.5, 0.7, 5
#: Most words of a statement that is listed at all its subsets of words.
SHORT = 6


def merged(c: Column, d: Column, new: Column) -> tuple[Column, Column]:
    """Confidence and decay after merging an equal statement."""
    return F.least(F.lit(0.99), c + 0.3 * new), d * 0.7


def reinforced(c: Column, d: Column, new: Column) -> tuple[Column, Column]:
    return F.least(F.lit(0.95), c + 0.1 * new), d * 0.85


def contradicted(c: Column, d: Column, pinned: Column) -> tuple[Column, Column]:
    """A contradicted row fades faster; a pinned one stays as it is."""
    return F.when(pinned, c).otherwise(F.greatest(F.lit(0.05), c * 0.3)), F.when(pinned, d).otherwise(F.least(F.lit(1.0), d + 0.15))


def entity_overlap(a: Column, b: Column) -> Column:
    """Two mention lists share an entity: by id where both have one, else by span in any case."""
    same = lambda x, y: F.coalesce(x["resolved_id"] == y["resolved_id"], F.lower(x["span"]) == F.lower(y["span"]))
    return F.exists(a, lambda x: F.exists(b, lambda y: same(x, y)))


def first_of_batch(new: DataFrame) -> DataFrame:
    """The first row (by id) of each canonical text of a context."""
    w = Window.partitionBy("context_id", "_canonical").orderBy("id")
    return new.withColumn("_canonical", canonical(F.col("text"))).withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def similar(new: DataFrame, existing: DataFrame, k: int = CANDIDATES, least: float = SIMILAR) -> DataFrame:
    """(id, match_id, score): the k most similar active rows of each new row's context (ties: the smallest ids).

    The score is the cosine of the two sets of words, and positive. Statements of at most ``SHORT`` words meet
    at any words that they share, where only the ``k`` smallest ids are kept, so a word that all statements
    have costs no more than another; longer ones meet at their rare words (see ``overlap``). No match is lost.
    """
    words = F.filter(text_words(F.col("_text")), lambda w: w != "")
    side = lambda df: df.select("context_id", canonical(F.col("text")).alias("_text"), "id")
    fresh, known = side(new), side(existing.where("status = 'ACTIVE'"))
    texts = lambda df, p: df.select("context_id", "_text").distinct().withColumn(f"{p}words", F.array_sort(words)).withColumnRenamed("_text", f"{p}text").where(F.size(f"{p}words") > 0)
    nth = lambda keys, *by: F.row_number().over(Window.partitionBy("context_id", *keys).orderBy(*by))
    rows = known.withColumn("_nth", nth(["_text"], "id")).where(F.col("_nth") <= k).select("context_id", F.col("_text").alias("_btext"), F.col("id").alias("match_id"))
    a, b = checkpoint(texts(fresh, "_a")), checkpoint(texts(known, "_b"))
    n = F.size("_awords")
    score = F.size(F.array_intersect("_awords", "_bwords")) / F.sqrt((n * F.size("_bwords")).cast("double"))
    short = lambda p: F.size(f"{p}words") <= SHORT
    # Of the statements of one size with the same words of these, only the k smallest ids can be among the k most similar.
    subsets = lambda p: F.explode(F.expr(f"transform(sequence(1, shiftleft(1, size({p}words)) - 1), m -> filter({p}words, (w, i) -> (shiftright(m, i) & 1) = 1))")).alias("_key")
    keys = ["context_id", "_key", "_size"]
    lists = b.where(short("_b")).join(rows, ["context_id", "_btext"]).select("context_id", "_btext", "_bwords", "match_id", F.size("_bwords").alias("_size"), subsets("_b"))
    lists = lists.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy("match_id"))).where(F.col("_nth") <= k).drop("_nth")
    own = F.size("_key")
    square = max(least * least, 1e-6)
    most = F.least(F.lit(SHORT), F.floor(own * own / (n * F.lit(square)) + 1e-6)).cast("int")
    asked = a.where(short("_a")).select("context_id", "_atext", "_awords", subsets("_a")).where(most >= own).withColumn("_size", F.explode(F.sequence(own, most)))
    scored = asked.hint("merge").join(lists, keys).select("context_id", "_atext", "match_id", score.alias("score")).where(F.col("score") >= least).distinct()
    # Longer statements meet at their rare words.
    for x, y in ((a.where(~short("_a")), b), (a.where(short("_a")), b.where(~short("_b")))):
        if x.isEmpty() or y.isEmpty():
            continue
        met = meetings(x, y, "context_id", "_awords", "_bwords", square, lambda m, n: F.sqrt(m * n) * least)
        long = met.select("context_id", "_atext", "_btext", score.alias("score")).where(F.col("score") >= least).distinct().join(rows, ["context_id", "_btext"])
        scored = scored.unionByName(long.select("context_id", "_atext", "match_id", "score"))
    best = scored.withColumn("_nth", nth(["_atext"], F.desc("score"), "match_id")).where(F.col("_nth") <= k)
    return fresh.withColumnRenamed("_text", "_atext").join(best, ["context_id", "_atext"]).select("id", "match_id", "score")


def fast_path(new: DataFrame, existing: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """(id, action, match_id) of each row that is first of its canonical text.

    MERGED with the smallest id of equal canonical text; else, given ``similar`` (id, match_id, score),
    NEW without a candidate of at least ``SIMILAR``, MERGED at ``AUTO_MERGE``, NEW when no candidate
    shares an entity, and PENDING for a classifier otherwise.
    """
    batch = first_of_batch(new)
    known = existing.where("status = 'ACTIVE'").groupBy("context_id", canonical(F.col("text")).alias("_canonical")).agg(F.min("id").alias("equal_id"))
    out = batch.join(known, ["context_id", "_canonical"], "left")
    if similar is None:
        return out.select("id", F.when(F.col("equal_id").isNotNull(), "MERGED").otherwise("NEW").alias("action"), F.col("equal_id").alias("match_id"))
    near = similar.where(F.col("score") >= SIMILAR)
    lists = near.join(batch.select("id", F.col("mentions").alias("_own")), "id").join(existing.select(F.col("id").alias("match_id"), F.col("mentions").alias("_other")), "match_id")
    judged = lists.groupBy("id").agg(F.max(F.struct("score", F.col("match_id"))).alias("top"), F.max(entity_overlap(F.col("_own"), F.col("_other")).cast("int")).alias("shares"))
    out = out.join(judged, "id", "left")
    bare = F.size(resolved_ids(F.col("mentions"))) == 0
    action = F.when(F.col("equal_id").isNotNull(), "MERGED").when(F.col("top").isNull(), "NEW").when(F.col("top.score") >= AUTO_MERGE, "MERGED").when((F.col("shares") == 0) & ~bare, "NEW").otherwise("PENDING")
    match = F.when(F.col("equal_id").isNotNull(), F.col("equal_id")).when(action != "NEW", F.col("top.match_id"))
    return out.select("id", action.alias("action"), match.alias("match_id"))


def default_relation(score: Column) -> Column:
    """Stands in for a language model: bands of similarity."""
    return F.when(score >= 0.9, "IDENTICAL").when(score >= REINFORCE, "SIMILAR").otherwise("UNRELATED")


def classified(pairs: DataFrame, relation: Callable[[Column], Column] = default_relation) -> DataFrame:
    """(id, action, match_id) from (id, match_id, score[, relation]): identical, then contradictory, generalizing, and most similar."""
    rows = pairs if "relation" in pairs.columns else pairs.withColumn("relation", relation(F.col("score")))
    rank = F.when(F.col("relation") == "IDENTICAL", 0).when(F.col("relation") == "CONTRADICTORY", 1).when(F.col("relation") == "GENERALIZES", 2).when((F.col("relation") == "SIMILAR") & (F.col("score") >= REINFORCE), 3).otherwise(4)
    best = rows.withColumn("_rank", rank).groupBy("id").agg(F.min(F.struct("_rank", (-F.col("score")).alias("_s"), "match_id")).alias("b"))
    names = F.array(*[F.lit(x) for x in ("MERGED", "CONTRADICTED", "GENERALIZED", "REINFORCED", "NEW")])
    return best.select("id", F.element_at(names, F.col("b._rank") + 1).alias("action"), F.when(F.col("b._rank") < 4, F.col("b.match_id")).alias("match_id"))


def conflict_kind(evolving: Column, new_seen: Column, old_seen: Column) -> Column:
    """A changing fact that isn't older is the world's progress, all else a contradiction."""
    return F.when(evolving & (new_seen >= old_seen), "WORLD_PROGRESSION").otherwise("CONTRADICTION")


def seen_at() -> Column:
    return F.coalesce("temporal.observed_at", "temporal.valid_from", "content_revised")
