"""Confidence, trust, similarity and merge arithmetic.

``as_of`` is always an argument: nothing here reads the clock, so a query gives one answer.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import TIER_OF_KIND, TIERS, TRUST_OF_TIER

DAY_MICROS = 86_400_000_000


def moment(as_of: datetime | str | Column) -> Column:
    if isinstance(as_of, Column):
        return as_of
    return F.to_timestamp(F.lit(as_of)) if isinstance(as_of, str) else F.lit(as_of)


def whole_days(start: Column, end: Column) -> Column:
    """Full days from start to end, 0 when end is earlier."""
    return F.greatest(F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(DAY_MICROS)), F.lit(0))


def is_current(as_of: datetime | str | Column, temporal: str = "temporal") -> Column:
    """Whether a validity window, half open, holds at a time; a row without one is always current."""
    at, t = moment(as_of), F.col(temporal)
    gone = F.coalesce(t["invalidated_at"] <= at, F.lit(False))
    early = F.coalesce(at < t["valid_from"], F.lit(False))
    late = F.coalesce(at >= t["valid_to"], F.lit(False))
    return ~(gone | early | late)


def effective_confidence(as_of: datetime | str | Column, k: float = 2.0, temporal: str = "temporal") -> Column:
    """Confidence at a time.

    Retracted: 0. With a start of validity: 0 outside the window, undiminished in a closed one, fading
    from its start in an open one. Without: fading from the last revision of the content.
    """
    at, t = moment(as_of), F.col(temporal)
    faded = lambda since: F.col("confidence") * F.exp(-F.col("decay") * F.lit(float(k)) * whole_days(since, at))
    return (
        F.when(t["invalidated_at"] <= at, F.lit(0.0))
        .when(t["valid_from"].isNull(), faded(F.col("content_revised")))
        .when(~is_current(at, temporal), F.lit(0.0))
        .when(t["valid_to"].isNotNull(), F.col("confidence"))
        .otherwise(faded(t["valid_from"]))
    )


def utility(as_of: datetime | str | Column, k: float = 2.0, importance_weight: float = 0.5, reinforce_weight: float = 0.1) -> Column:
    return effective_confidence(as_of, k) * (1 + F.lit(importance_weight) * F.col("importance")) * (1 + F.lit(reinforce_weight) * F.log1p(F.col("reinforce_count")))


def last_touched() -> Column:
    return F.greatest("content_revised", "metadata_revised")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in double; 0 when a norm is 0. Arrays of different length are an error."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    size = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different length")).cast("double")).when(size == 0, 0.0).otherwise(dot / size)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays seen as sets; 1 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def text_words(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"\s+"))


def resolved_ids(mentions: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(mentions, lambda m: m["resolved_id"]), lambda x: x.isNotNull()))


def words_and_entities(words_a: Column, ids_a: Column, words_b: Column, ids_b: Column) -> Column:
    """0.7 of the words' overlap and 0.3 of the entities'; two rows without entities count half there, one such row 0."""
    entities = F.when((F.size(ids_a) == 0) & (F.size(ids_b) == 0), 0.5).when((F.size(ids_a) == 0) | (F.size(ids_b) == 0), 0.0).otherwise(jaccard(ids_a, ids_b))
    return F.lit(0.7) * jaccard(words_a, words_b) + F.lit(0.3) * entities


def consolidation_similarity(text_a: Column, ids_a: Column, text_b: Column, ids_b: Column) -> Column:
    return words_and_entities(text_words(text_a), ids_a, text_words(text_b), ids_b)


def recall_relevance(query_words: list[str], as_of: datetime | str | Column) -> Column:
    """0.4 of the share of query words in the text, 0.3 of recency (a day's e-folding), 0.3 of confidence."""
    words = F.array(*[F.lit(w) for w in dict.fromkeys(query_words)]) if query_words else F.array().cast("array<string>")
    overlap = F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.array_intersect(words, text_words(F.col("text")))) / F.size(words))
    age = (F.unix_micros(moment(as_of)) - F.unix_micros("content_revised")) / F.lit(1e6)
    return F.lit(0.4) * overlap + F.lit(0.3) * F.exp(-F.greatest(age, F.lit(0.0)) / F.lit(86400.0)) + F.lit(0.3) * F.col("confidence")


def capped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def tier_of_kinds(kinds: Column) -> Column:
    """Ordinal of the strongest tier among locator kinds; UNKNOWN without any."""
    ordinal = F.lit(len(TIERS) - 1)
    order = lambda k: F.coalesce(*[F.when(k == F.lit(kind), F.lit(TIERS.index(tier))) for kind, tier in TIER_OF_KIND.items()], F.lit(len(TIERS) - 1))
    return F.coalesce(F.array_min(F.transform(kinds, order)), ordinal)


def tier_name(ordinal: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TIERS]), ordinal + 1)


def trust_of_tier(tier: Column) -> Column:
    out = F.lit(0.5)
    for name, w in TRUST_OF_TIER.items():
        out = F.when(tier == name, w).otherwise(out)
    return capped(out, 0.0, 1.0)


def passes_trust(least: float, score: Column) -> Column:
    """Fails open: a score that is missing or not finite passes."""
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) != F.lit(float("inf")))
    return ~finite | (score >= F.lit(least))
