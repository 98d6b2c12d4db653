"""Declarative queries over propositions: filters, order and limit as one DataFrame chain."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring

ORDERS = ("none", "effective_confidence", "created", "revised", "accessed", "reinforce_count", "importance", "utility")


@dataclass(frozen=True)
class QuerySpec:
    """Null fields don't constrain; all others must hold. An empty ``any_entities`` matches nothing, while empty ``statuses`` and ``all_entities`` match everything."""

    context_id: str | None = None
    entity_id: str | None = None
    any_entities: tuple[str, ...] | None = None
    all_entities: tuple[str, ...] | None = None
    statuses: tuple[str, ...] | None = None
    min_level: int | None = None
    max_level: int | None = None
    created_after: str | datetime | None = None
    created_before: str | datetime | None = None
    revised_after: str | datetime | None = None
    revised_before: str | datetime | None = None
    accessed_after: str | datetime | None = None
    accessed_before: str | datetime | None = None
    min_effective_confidence: float | None = None
    min_importance: float | None = None
    min_reinforce_count: int | None = None
    pinned: bool | None = None
    min_trust: float | None = None
    as_of: str | datetime | None = None
    decay_k: float = 2.0
    order_by: str = "none"
    limit: int | None = None

    def with_(self, **changes: object) -> QuerySpec:
        return replace(self, **changes)

    @staticmethod
    def for_context(context_id: str) -> QuerySpec:
        return QuerySpec(context_id=context_id)

    @staticmethod
    def about(context_id: str, entity_id: str) -> QuerySpec:
        return QuerySpec(context_id=context_id, entity_id=entity_id)

    def since(self, field: str, as_of: str, seconds: int) -> QuerySpec:
        """Created, revised or accessed within so many seconds before a time."""
        start = datetime.fromisoformat(as_of).timestamp() - seconds
        return self.with_(**{f"{field}_after": datetime.fromtimestamp(start)})


def predicate(q: QuerySpec) -> Column:
    """All filters of the spec as one conjunction; flat ones reach the scan."""
    ids = scoring.resolved_ids(F.col("mentions"))
    tests: list[Column] = []
    if q.context_id is not None:
        tests.append(F.col("context_id") == q.context_id)
    if q.statuses:
        tests.append(F.col("status").isin(*q.statuses))
    for low, high, column in ((q.min_level, q.max_level, F.col("level")), (q.created_after, q.created_before, F.col("created")), (q.revised_after, q.revised_before, scoring.last_touched()), (q.accessed_after, q.accessed_before, F.col("last_accessed"))):
        cast = (lambda x: F.lit(x)) if isinstance(low if low is not None else high, int) else scoring.moment
        if low is not None:
            tests.append(column >= cast(low))
        if high is not None:
            tests.append(column <= cast(high))
    if q.min_importance is not None:
        tests.append(F.col("importance") >= q.min_importance)
    if q.min_reinforce_count is not None:
        tests.append(F.col("reinforce_count") >= q.min_reinforce_count)
    if q.pinned is not None:
        tests.append(F.col("pinned") == q.pinned)
    if q.min_trust is not None:
        tests.append(scoring.passes_trust(q.min_trust, F.col("trust_score")))
    if q.entity_id is not None:
        tests.append(F.exists("mentions", lambda m: m["resolved_id"] == q.entity_id))
    if q.any_entities is not None:
        tests.append(F.arrays_overlap(ids, F.array(*[F.lit(x) for x in q.any_entities])) if q.any_entities else F.lit(False))
    if q.all_entities:
        tests.append(F.size(F.array_except(F.array(*[F.lit(x) for x in q.all_entities]), ids)) == 0)
    if q.min_effective_confidence is not None:
        tests.append(scoring.effective_confidence(q.as_of, q.decay_k) >= q.min_effective_confidence)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def order_key(q: QuerySpec) -> Column | None:
    return {
        "none": lambda: None,
        "effective_confidence": lambda: scoring.effective_confidence(q.as_of, q.decay_k),
        "utility": lambda: scoring.utility(q.as_of, q.decay_k),
        "created": lambda: F.col("created"),
        "revised": scoring.last_touched,
        "accessed": lambda: F.col("last_accessed"),
        "reinforce_count": lambda: F.col("reinforce_count"),
        "importance": lambda: F.col("importance"),
    }[q.order_by]()


def query(props: DataFrame, q: QuerySpec) -> DataFrame:
    """Filter, then order (greatest first, ties by id), then limit."""
    if (q.min_effective_confidence is not None or q.order_by in ("effective_confidence", "utility")) and q.as_of is None:
        raise ValueError("a query over effective confidence needs as_of")
    out = props.where(predicate(q))
    key = order_key(q)
    if key is not None:
        out = out.orderBy(key.desc_nulls_last(), "id")
    elif q.limit is not None:
        out = out.orderBy("id")
    return out if q.limit is None else out.limit(q.limit)
