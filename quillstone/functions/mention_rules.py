"""Validation rules of mentions: each gives null for a valid mention, or the reason it isn't."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VAGUE = ("this", "that", "these", "those", "the", "an", "a")


def not_blank(span: Column) -> Column:
    return F.when(F.trim(span) == "", F.lit("blank"))


def not_vague(span: Column) -> Column:
    return F.when(F.lower(F.trim(span)).rlike(f"^(?:{'|'.join(VAGUE)})(?: |$)"), F.lit("vague reference"))


def length_between(span: Column, low: int = 0, high: int = 1 << 30) -> Column:
    n = F.length(span)
    return F.when(n < low, F.concat(F.lit("shorter than "), F.lit(low))).when(n > high, F.concat(F.lit("longer than "), F.lit(high)))


def matches(span: Column, pattern: str) -> Column:
    return F.when(~span.rlike(f"^(?:{pattern})$"), F.lit("pattern"))


def least_words(span: Column, n: int) -> Column:
    return F.when(F.size(F.filter(F.split(F.trim(span), r"\s+"), lambda w: w != "")) < n, F.concat(F.lit("fewer words than "), F.lit(n)))


def not_type_word(span: Column, words: tuple[str, ...]) -> Column:
    return F.when(F.lower(F.trim(span)).rlike(f"^(?:{'|'.join(words)})s?$"), F.lit("names a type"))


def all_of(*reasons: Column) -> Column:
    """The first reason."""
    return F.coalesce(*reasons)


def any_of(*reasons: Column) -> Column:
    """Null if one is valid, else all reasons."""
    valid = reduce(lambda a, b: a | b, [r.isNull() for r in reasons])
    return F.when(~valid, F.concat_ws("; ", *reasons))


def whole_text(span: Column, text: Column, least: int = 50) -> Column:
    return F.when((F.length(text) >= least) & (F.lower(F.trim(span)) == F.lower(F.trim(text))), F.lit("whole text"))


def composite(*reasons: Column) -> Column:
    """Whether every filter lets the mention pass; without filters all do."""
    return reduce(lambda a, b: a & b, [r.isNull() for r in reasons], F.lit(True))


def by_schema(kind: Column, span: Column, schema: dict[str, tuple[Callable[[Column], Column], ...]]) -> Column:
    """The first reason that the rules of the mention's type give, types in any case; a type without rules, or a null one, passes."""
    out = F.lit(None).cast("string")
    for name, own in schema.items():
        out = F.when(F.lower(kind) == name.lower(), all_of(F.lit(None).cast("string"), *[rule(span) for rule in own])).otherwise(out)
    return out


def counts(mentions: DataFrame, reason: Column) -> DataFrame:
    """(type, outcome, n): accepted and rejected mentions of each type."""
    return mentions.groupBy("type", F.when(reason.isNull(), "accepted").otherwise("rejected").alias("outcome")).agg(F.count("*").alias("n"))
