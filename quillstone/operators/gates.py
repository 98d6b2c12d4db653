"""Admission gates: each is a column that is null to persist, or a decision and its reason.

Decisions: REJECT, REVIEW, SKIP_PROJECTION, DEMOTE. The first gate with one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import effective_confidence
from ..schema import TIERS


def _say(test: Column, decision: str, reason: str) -> Column:
    return F.when(test, F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason")))


def confidence(as_of: str, least: float = 0.3) -> Column:
    return _say(effective_confidence(as_of) < least, "REJECT", "confidence")


def merge_candidate(kind: Column) -> Column:
    return _say(kind.isin("MERGED", "REINFORCED"), "REVIEW", "merge candidate")


def conflict(kind: Column) -> Column:
    return _say(kind == "CONTRADICTED", "REVIEW", "conflict")


def trust(score: Column, least: float = 0.5, missing_persists: bool = True) -> Column:
    low = F.coalesce(score < least, F.lit(not missing_persists))
    return _say(low, "REVIEW", "trust")


def projection(as_of: str, least: float = 0.3) -> Column:
    return _say((effective_confidence(as_of) < least) | (F.col("status") == "CONTRADICTED"), "SKIP_PROJECTION", "not eligible")


def evidence(matched: Column, confidence_: Column, tier: Column) -> Column:
    """``matched`` is the first relation whose predicate the text contains, a row of RELATIONS, or null."""
    low = F.coalesce(confidence_ < matched["min_confidence"], F.lit(False))
    tiers = F.array(*[F.lit(t) for t in TIERS])
    weak = F.coalesce(F.array_position(tiers, tier) > F.array_position(tiers, matched["min_authority"]), F.lit(False))
    fails = matched.isNotNull() & (low | weak)
    return F.when(fails, F.struct(F.when(matched["demote_to"].isNotNull(), "DEMOTE").otherwise("REVIEW").alias("decision"), F.coalesce(F.concat(F.lit("evidence:"), matched["demote_to"]), F.lit("evidence")).alias("reason")))


def run(rows: DataFrame, gates: list[tuple[str, Column]], stop_on_reject: bool = True) -> DataFrame:
    """The rows with ``decision`` (PERSIST by default), ``gate``, ``reason`` and how many gates were ``evaluated``.

    With ``stop_on_reject`` the gates after the first rejection aren't evaluated.
    """
    named = {f"_g{k}": g for k, (_, g) in enumerate(gates)}
    out = rows.withColumns(named)
    first = F.coalesce(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c)["decision"].alias("decision"), F.col(c)["reason"].alias("reason"), F.lit(n).alias("gate"))) for (n, _), c in zip(gates, named, strict=True)])
    stop = F.coalesce(*[F.when(F.col(c)["decision"] == "REJECT", F.lit(k + 1)) for k, c in enumerate(named)], F.lit(len(gates))) if stop_on_reject else F.lit(len(gates))
    out = out.withColumn("_first", first).withColumn("evaluated", stop)
    return out.withColumns({"decision": F.coalesce("_first.decision", F.lit("PERSIST")), "gate": F.col("_first.gate"), "reason": F.col("_first.reason")}).drop("_first", *named)


def flags(decision: Column) -> dict[str, Column]:
    return {"saved": decision.isin("PERSIST", "SKIP_PROJECTION", "DEMOTE"), "reviewed": decision == "REVIEW", "projected": decision == "PERSIST", "demoted": decision == "DEMOTE"}
