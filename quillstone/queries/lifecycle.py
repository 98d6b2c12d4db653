"""L* queries: gates, revision, decay, collection, consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import AS_OF, propositions, provenance
from ..functions.scoring import effective_confidence
from ..operators import consolidate, gates, lifecycle, project, revise
from ..operators.store import with_authority
from ..plans import maintenance
from .graphs import relations
from .registry import query
from .sql import AT, sql, util

_REL = "CASE WHEN contains(text, 'purchase') THEN 0 WHEN contains(text, 'sign') THEN 1 WHEN contains(text, 'click') THEN 2 WHEN contains(text, 'view') THEN 3 END"
_EVIDENCE = "CASE WHEN rel = 0 AND (confidence < 0.5 OR tier > 1) THEN 'DEMOTE' WHEN rel = 1 AND confidence < 0.2 THEN 'REVIEW' WHEN rel = 2 AND tier > 0 THEN 'REVIEW' END"
_GATES = f"""SELECT id, CASE WHEN eff < 0.05 THEN 'REJECT' WHEN event_id % 8 = 1 THEN 'REVIEW' WHEN event_id % 8 = 2 THEN 'REVIEW' WHEN trust_score < 0.2 THEN 'REVIEW' WHEN {_EVIDENCE} IS NOT NULL THEN {_EVIDENCE} WHEN eff < 0.1 OR status = 'CONTRADICTED' THEN 'SKIP_PROJECTION' ELSE 'PERSIST' END AS decision,
  CASE WHEN eff < 0.05 THEN 'confidence' WHEN event_id % 8 = 1 THEN 'merge' WHEN event_id % 8 = 2 THEN 'conflict' WHEN trust_score < 0.2 THEN 'trust' WHEN {_EVIDENCE} IS NOT NULL THEN 'evidence' WHEN eff < 0.1 OR status = 'CONTRADICTED' THEN 'projection' END AS gate,
  CASE WHEN eff < 0.05 THEN 1 ELSE 6 END AS evaluated FROM (SELECT p.*, tier, {_REL} AS rel FROM props p JOIN tiers ON proposition_id = id)"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = project.with_relation(with_authority(propositions(spark, sf_dir), provenance(spark, sf_dir)), relations(spark))
    kind = F.when(F.col("event_id") % 8 == 1, "MERGED").when(F.col("event_id") % 8 == 2, "CONTRADICTED").otherwise("NEW")
    return gates.run(
        rows,
        [
            ("confidence", gates.confidence(AS_OF, 0.05)),
            ("merge", gates.merge_candidate(kind)),
            ("conflict", gates.conflict(kind)),
            ("trust", gates.trust(F.col("trust_score"), 0.2)),
            ("evidence", gates.evidence(F.col("relation"), F.col("confidence"), F.col("authority"))),
            ("projection", gates.projection(AS_OF, 0.1)),
        ],
    )


@query("l01_l07_gates", sql(_GATES, "props", "tiers"))
def l01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("id", "decision", "gate", "evaluated")


@query("l08_l09_gate_flags", sql("SELECT id, decision IN ('PERSIST', 'SKIP_PROJECTION', 'DEMOTE') AS saved, decision = 'REVIEW' AS reviewed, decision = 'PERSIST' AS projected, decision = 'DEMOTE' AS demoted FROM gated WHERE decision <> 'PERSIST'", "props", "tiers", gated=_GATES))
def l08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event of every decision other than to persist, with what follows from it."""
    rows = _gated(spark, sf_dir).where("decision <> 'PERSIST'")
    return rows.select("id", *[c.alias(n) for n, c in gates.flags(F.col("decision")).items()])


@query("l10_j09_revise_fast_path", sql("SELECT n.id, CASE WHEN o.first IS NULL THEN 'NEW' ELSE 'MERGED' END AS action, o.first AS match_id FROM (SELECT context_id, text, min(id) AS id FROM props WHERE event_id % 4 = 0 GROUP BY ALL) n LEFT JOIN (SELECT context_id, text, min(id) AS first FROM props WHERE event_id % 4 <> 0 AND status = 'ACTIVE' GROUP BY ALL) o USING (context_id, text)", "props"))
def l10(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propositions(spark, sf_dir)
    return revise.fast_path(p.where("event_id % 4 = 0"), p.where("event_id % 4 <> 0"))


@query("l10_j10_revise_similar")
def l10b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is new or existing, candidates by the similarity of words; a quarter of the statements is new only."""
    p = propositions(spark, sf_dir)
    fresh = "event_id % 4 = 0 OR crc32(text) % 4 = 0"
    new, old = p.where(fresh), p.where(f"NOT ({fresh})")
    return revise.fast_path(new, old, revise.similar(revise.first_of_batch(new), old))


@query("l12_classified", sql("SELECT id, ['MERGED', 'CONTRADICTED', 'GENERALIZED', 'REINFORCED', 'NEW'][rank + 1] AS action, CASE WHEN rank < 4 THEN match_id END AS match_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, score DESC, match_id) AS nth FROM (SELECT 'o' || l_orderkey AS id, 'p' || l_partkey AS match_id, l_quantity / 50 AS score, CASE l_returnflag WHEN 'A' THEN CASE WHEN l_linenumber = 1 THEN 0 ELSE 2 END WHEN 'R' THEN 1 ELSE CASE WHEN l_quantity / 50 >= 0.7 THEN 3 ELSE 4 END END AS rank FROM lineitem)) WHERE nth = 1"))
def l12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import table

    relation = F.when(F.col("l_returnflag") == "A", F.when(F.col("l_linenumber") == 1, "IDENTICAL").otherwise("GENERALIZES")).when(F.col("l_returnflag") == "R", "CONTRADICTORY").otherwise("SIMILAR")
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("match_id"), (F.col("l_quantity") / 50).alias("score"), relation.alias("relation"))
    return revise.classified(rows)


@query("l14_conflict_kinds", sql("SELECT id, CASE WHEN event_type = 'view' AND coalesce(observed_at, valid_from, content_revised) >= TIMESTAMP '2024-01-15 00:00:00' THEN 'WORLD_PROGRESSION' ELSE 'CONTRADICTION' END AS kind FROM props", "props"))
def l14(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scoring import moment

    return propositions(spark, sf_dir).select("id", revise.conflict_kind(F.col("text").endswith("view"), revise.seen_at(), moment("2024-01-15 00:00:00")).alias("kind"))


_NEXT = f"CASE WHEN pinned THEN status WHEN status = 'ACTIVE' AND {util()} < 0.1 THEN 'STALE' WHEN status = 'STALE' AND {util()} > 0.2 THEN 'ACTIVE' ELSE status END"


@query("l16_decay_policy", sql(f"SELECT id, {_NEXT} AS new_status FROM props", "props"))
def l16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propositions(spark, sf_dir).select("id", lifecycle.next_status(AS_OF).alias("new_status"))


@query("l17_decay_sweep", sql(f"SELECT id, CASE WHEN NOT pinned AND {util()} < 0.01 THEN 'PRUNED' WHEN new <> status AND new = 'ACTIVE' THEN 'REVIVED' WHEN new <> status THEN 'TRANSITIONED' ELSE 'SKIPPED' END AS sweep FROM (SELECT *, {_NEXT} AS new FROM props WHERE status IN ('ACTIVE', 'STALE'))", "props"))
def l17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.decay_sweep(propositions(spark, sf_dir), AS_OF, ("ACTIVE", "STALE"), 0.01).select("id", "sweep")


@query("l18_materialised_confidence", sql("SELECT id, round(eff, 6) AS effective_confidence, status FROM props WHERE status = 'ACTIVE'", "props"))
def l18(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propositions(spark, sf_dir).where("status = 'ACTIVE'")
    return p.withColumn("effective_confidence", F.round(effective_confidence(AS_OF), 6)).select("id", "effective_confidence", "status")


_COLLECT = "SELECT id, CASE WHEN pinned OR status = 'STALE' THEN 'SKIPPED' ELSE 'TRANSITIONED' END AS outcome, CASE WHEN eff < 0.1 AND NOT pinned THEN CASE WHEN event_id % 3 = 0 THEN 'duplicate,stale' ELSE 'stale' END ELSE 'duplicate' END AS reasons FROM props WHERE (eff < 0.1 AND NOT pinned) OR event_id % 3 = 0"


def _marks(p: DataFrame) -> DataFrame:
    dup = p.where("event_id % 3 = 0").select(F.col("id").alias("proposition_id"), F.lit("duplicate").alias("reason"), F.lit("ev-1").alias("survivor_id"), F.lit("duplicate").alias("strategy"))
    return lifecycle.decay_marks(p, AS_OF).unionByName(dup)


@query("l19_l20_l22_collect", sql(_COLLECT, "props"))
def l19(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propositions(spark, sf_dir)
    return lifecycle.collect(p, _marks(p)).select("id", "outcome", "reasons")


@query("l19_collect_dry_run", sql("SELECT outcome, count(*) AS n FROM (SELECT CASE outcome WHEN 'TRANSITIONED' THEN 'MARKED' ELSE outcome END AS outcome FROM c) GROUP BY outcome", "props", c=_COLLECT))
def l19b(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propositions(spark, sf_dir)
    return lifecycle.collect(p, _marks(p), dry_run=True).groupBy("outcome").agg(F.count("*").alias("n"))


@query("l27_state_after_collection", sql("SELECT p.id, CASE WHEN c.outcome = 'TRANSITIONED' THEN 'STALE' ELSE p.status END AS status FROM props p LEFT JOIN c USING (id)", "props", c=_COLLECT))
def l27(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propositions(spark, sf_dir)
    return lifecycle.apply_collection(p, lifecycle.collect(p, _marks(p))).select("id", "status")


@query("l24_l28_m05_consolidate")
def l24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is of the session or existing, and all are compared."""
    p = propositions(spark, sf_dir)
    session = "event_id % 4 = 0 OR crc32(text) % 4 = 0"
    out = consolidate.consolidate(p.where(session), p.where(f"NOT ({session})"))
    return out.withColumn("confidence", F.round("confidence", 6))


@query("l26_j11_contradictions", sql(f"SELECT CASE WHEN a.eff < b.eff THEN a.id ELSE b.id END AS id, CASE WHEN a.eff < b.eff THEN b.id ELSE a.id END AS other_id, CASE WHEN CASE WHEN a.eff < b.eff THEN a.pinned ELSE b.pinned END THEN 'REVIEW' ELSE 'CONTRADICTED' END AS outcome FROM (SELECT DISTINCT x.proposition_id AS i, y.proposition_id AS j FROM m x JOIN m y ON x.context_id = y.context_id AND x.resolved_id = y.resolved_id AND x.proposition_id < y.proposition_id) JOIN props a ON a.id = i JOIN props b ON b.id = j WHERE a.text <> b.text AND (a.text LIKE '%error' OR b.text LIKE '%error') AND (a.text LIKE '%purchase' OR b.text LIKE '%purchase') AND {AT} IS NOT NULL", "props", "mentions", m="SELECT * FROM mentions WHERE status = 'ACTIVE'"))
def l26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and errors of one person contradict each other here."""
    p = propositions(spark, sf_dir)
    either = lambda a, b, w: a.endswith(w) | b.endswith(w)
    test = lambda a, b: (a != b) & either(a, b, "error") & either(a, b, "purchase")
    return consolidate.resolve_contradictions(consolidate.contradiction_candidates(p, test, *consolidate.judged_by(AS_OF)), p, AS_OF, test)


@query("l29_a10_dream_loop", sql(f"SELECT (SELECT count(*) FROM props WHERE status = 'ACTIVE') AS examined, (SELECT count(*) FROM c WHERE outcome = 'TRANSITIONED') + (SELECT count(*) FROM props WHERE status = 'ACTIVE' AND NOT pinned AND {util()} < 0.1 AND id NOT IN (SELECT id FROM c WHERE outcome = 'TRANSITIONED')) AS transitioned", "props", c=_COLLECT.replace("FROM props WHERE", "FROM props WHERE status = 'ACTIVE' AND (").replace("event_id % 3 = 0 THEN 'duplicate,stale'", "event_id % 3 = 0 THEN 'duplicate,stale'") + ")"))
def l29(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propositions(spark, sf_dir)
    passes = {
        "collect": lambda rows: lifecycle.collect(rows, _marks(rows)).where("outcome = 'TRANSITIONED'").select("id", F.col("new_status").alias("status")),
        "decay": lambda rows: lifecycle.decay_sweep(rows, AS_OF).where("sweep = 'TRANSITIONED'").select("id", F.col("new_status").alias("status")),
    }
    return maintenance.dream(p, passes).report.select("examined", "transitioned")


@query("l29_due_contexts", sql("SELECT context_id, count(*) AS n FROM props WHERE status = 'ACTIVE' GROUP BY 1 HAVING count(*) - coalesce(max(CASE WHEN context_id IN ('ctx-1', 'ctx-2') THEN (SELECT count(*) FROM props q WHERE q.status = 'ACTIVE' AND q.context_id = 'ctx-1') - 5 END), 0) >= 10", "props"))
def l29b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two contexts had their last cycle at five fewer rows than one of them has now."""
    p = propositions(spark, sf_dir)
    n = maintenance.due(p, least=1).where("context_id = 'ctx-1'").select((F.col("n") - 5).alias("n"))
    last = spark.createDataFrame([("ctx-1",), ("ctx-2",)], "context_id string").crossJoin(F.broadcast(n))  # two rows
    return maintenance.due(p, last)


@query("l30_maintenance")
def l30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, with every fourth event as the session."""
    p = propositions(spark, sf_dir)
    new = "event_id % 4 = 0"
    return maintenance.maintain(p.where(f"NOT ({new})"), AS_OF, p.where(new), consolidate.join_texts, 3, 0.05, collect=True).rows.select("id", "status", "level", F.round("confidence", 6).alias("confidence"))


@query("l11_default_relations", sql("SELECT 'o' || l_orderkey AS id, arg_min('p' || l_partkey, (rank, -score, 'p' || l_partkey)) AS best, ['MERGED', 'CONTRADICTED', 'GENERALIZED', 'REINFORCED', 'NEW'][min(rank) + 1] AS action FROM (SELECT *, l_quantity / 50 AS score, CASE WHEN l_quantity / 50 >= 0.9 THEN 0 WHEN l_quantity / 50 >= 0.7 THEN 3 ELSE 4 END AS rank FROM lineitem) GROUP BY l_orderkey").replace("arg_min('p' || l_partkey, (rank, -score, 'p' || l_partkey)) AS best", "CASE WHEN min(rank) < 4 THEN arg_min('p' || l_partkey, (rank, -score, 'p' || l_partkey)) END AS match_id"))
def l11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations by bands of similarity, where no language model judges."""
    from ..session import table

    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return revise.classified(table(spark, sf_dir, "lineitem").select(name("o", "l_orderkey").alias("id"), name("p", "l_partkey").alias("match_id"), (F.col("l_quantity") / 50).alias("score")))
