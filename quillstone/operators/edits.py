"""Changes to propositions, each moving the clock that its column belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import moment
from ..schema import TRUST_KEY

#: Columns whose change revises the content, or only what is known about it; any other moves no clock.
CONTENT, ABOUT = ("text", "mentions", "confidence"), ("status", "pinned", "grounding", "temporal", "provenance", "metadata")
SHARES = ("confidence", "decay", "importance")


def edited(props: DataFrame, at: str | Column, where: Column | None = None, **changes: Column) -> DataFrame:
    """The rows with new values for some columns, of those that pass ``where`` (null counts as no).

    ``content_revised`` or ``metadata_revised`` become ``at``. A share outside 0..1 fails.
    """
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    values = dict(changes)
    for name in SHARES:
        if name in values:
            v = values[name]
            values[name] = F.when(v.between(0.0, 1.0), v).otherwise(F.raise_error(F.lit(f"{name} must be between 0 and 1")).cast("double"))
    for clock, own in (("content_revised", CONTENT), ("metadata_revised", ABOUT)):
        if set(values) & set(own):
            values[clock] = moment(at)
    return props.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in props.columns], *[F.when(hit, v).alias(c) for c, v in values.items() if c not in props.columns])


def grounded_in(ids: Column) -> Column:
    """The grounding with more chunk ids, each once."""
    return F.array_distinct(F.concat("grounding", ids))


def with_entry(key: str, value: Column, column: str = "metadata") -> Column:
    """The metadata map with one entry set."""
    old = F.coalesce(F.col(column), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(old, lambda k, _: k != key), F.create_map(F.lit(key), value.cast("string")))


def with_trust(props: DataFrame, score: Column, at: str | Column) -> DataFrame:
    """A trust score kept in the metadata; moves the metadata's clock only."""
    return edited(props, at, metadata=with_entry(TRUST_KEY, score))
