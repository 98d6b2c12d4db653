"""F*, O*, W* and set queries over propositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import AS_OF, exploded_mentions, propositions
from ..functions import scoring
from ..operators.query import QuerySpec, query as run
from ..session import table
from .registry import query
from .sql import AT, effective, sql, util

ACTIVE = ("ACTIVE",)
RESOLVED = "id IN (SELECT proposition_id FROM mentions WHERE resolved_id {test})"


def _filter(name: str, spec: QuerySpec, where: str, *views: str) -> None:
    @query(name, sql(f"SELECT id, context_id, status, round(confidence, 6) AS confidence FROM props WHERE {where}", "props", *views))
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(propositions(spark, sf_dir), spec).select("id", "context_id", "status", F.round("confidence", 6).alias("confidence"))


_filter("f01_context", QuerySpec.for_context("ctx-3"), "context_id = 'ctx-3'")
_filter("f02_entity", QuerySpec(entity_id="type-purchase"), RESOLVED.format(test="= 'type-purchase'"), "mentions")
_filter("f03_any_entities", QuerySpec(any_entities=("user-5", "user-17", "type-error")), RESOLVED.format(test="IN ('user-5', 'user-17', 'type-error')"), "mentions")
_filter("f03_any_entities_empty", QuerySpec(any_entities=()), "false")
_filter("f04_all_entities", QuerySpec(all_entities=("user-5", "type-click")), RESOLVED.format(test="= 'user-5'") + " AND " + RESOLVED.format(test="= 'type-click'"), "mentions")
_filter("f05_statuses", QuerySpec(statuses=("STALE", "PROMOTED")), "status IN ('STALE', 'PROMOTED')")
_filter("f05_statuses_empty", QuerySpec(statuses=(), context_id="ctx-1"), "context_id = 'ctx-1'")
_filter("f06_levels", QuerySpec(min_level=1, max_level=1), "level BETWEEN 1 AND 1")
_filter("f07_created", QuerySpec(created_after="2024-01-05 00:00:00", created_before="2024-01-12 12:00:00"), "created BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'")
_filter("f08_revised", QuerySpec(revised_after="2024-01-10 00:00:00", revised_before="2024-01-15 00:00:00"), "touched BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'")
_filter("f09_accessed", QuerySpec(accessed_after="2024-01-20 00:00:00"), "last_accessed >= TIMESTAMP '2024-01-20 00:00:00'")
_filter("f10_effective_confidence", QuerySpec(min_effective_confidence=0.1234567, as_of=AS_OF), "eff >= 0.1234567")
_filter("f10_effective_confidence_k1", QuerySpec(min_effective_confidence=0.2234567, as_of="2024-01-20 06:00:00", decay_k=1.0), f"({effective(1.0, chr(84) + 'IMESTAMP ' + repr('2024-01-20 06:00:00'))}) >= 0.2234567")
_filter("f11_importance", QuerySpec(min_importance=0.75), "importance >= 0.75")
_filter("f12_reinforced", QuerySpec(min_reinforce_count=3), "reinforce_count >= 3")
_filter("f13_pinned", QuerySpec(pinned=True), "pinned")
_filter("f14_trust_fails_open", QuerySpec(min_trust=0.505), "trust_score IS NULL OR trust_score >= 0.505")
_filter("f15_all_filters", QuerySpec(context_id="ctx-2", statuses=("ACTIVE", "PROMOTED"), any_entities=("type-click", "type-view"), min_level=0, created_after="2024-01-03 00:00:00", min_effective_confidence=0.05, min_importance=0.2, min_trust=0.1, as_of=AS_OF), "context_id = 'ctx-2' AND status IN ('ACTIVE', 'PROMOTED') AND level >= 0 AND created >= TIMESTAMP '2024-01-03 00:00:00' AND eff >= 0.05 AND importance >= 0.2 AND (trust_score IS NULL OR trust_score >= 0.1) AND " + RESOLVED.format(test="IN ('type-click', 'type-view')"), "mentions")
_filter("f19_revised_since", QuerySpec(statuses=ACTIVE).since("revised", AS_OF, 6 * 86400), f"status = 'ACTIVE' AND touched >= {AT} - INTERVAL 6 DAY")
_filter("f20_list_filter", QuerySpec(context_id="ctx-4", statuses=ACTIVE, order_by="created", limit=25), "id IN (SELECT id FROM props WHERE context_id = 'ctx-4' AND status = 'ACTIVE' ORDER BY created DESC, id LIMIT 25)")


def _ordered(name: str, spec: QuerySpec, where: str, order: str) -> None:
    @query(name, sql(f"SELECT id, round(confidence, 6) AS confidence, row_number() OVER (ORDER BY {order}) AS place FROM props WHERE {where} QUALIFY place <= {spec.limit}", "props"))
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = run(propositions(spark, sf_dir), spec)
        key = {"effective_confidence": scoring.effective_confidence(AS_OF), "utility": scoring.utility(AS_OF), "created": F.col("created"), "revised": scoring.last_touched(), "accessed": F.col("last_accessed"), "reinforce_count": F.col("reinforce_count"), "importance": F.col("importance")}[spec.order_by]
        # The limit bounds the rows that this window sees.
        return rows.withColumn("place", F.row_number().over(Window.orderBy(key.desc_nulls_last(), "id"))).select("id", F.round("confidence", 6).alias("confidence"), "place")


_ordered("o01_by_effective_confidence", QuerySpec(context_id="ctx-0", order_by="effective_confidence", as_of=AS_OF, limit=40), "context_id = 'ctx-0'", "round(eff, 12) DESC, id")
for _o, _c in (("created", "created"), ("revised", "touched"), ("accessed", "last_accessed"), ("reinforce_count", "reinforce_count"), ("importance", "importance")):
    _ordered(f"o02_by_{_o}", QuerySpec(statuses=ACTIVE, order_by=_o, limit=30), "status = 'ACTIVE'", f"{_c} DESC, id")


@query("r01_query", sql("SELECT id, text, round(eff, 6) AS effective FROM props WHERE context_id = 'ctx-7' AND status = 'ACTIVE' AND eff >= 0.05 ORDER BY eff DESC, id LIMIT 20", "props"))
def r01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the top 20 active propositions of a context by effective confidence as of a date."""
    spec = QuerySpec(context_id="ctx-7", statuses=ACTIVE, min_effective_confidence=0.05, as_of=AS_OF, order_by="effective_confidence", limit=20)
    return run(propositions(spark, sf_dir), spec).select("id", "text", F.round(scoring.effective_confidence(AS_OF), 6).alias("effective"))


@query("f16_current", sql(f"SELECT id FROM props WHERE NOT coalesce(invalidated_at <= {AT}, false) AND NOT coalesce({AT} < valid_from, false) AND NOT coalesce({AT} >= valid_to, false)", "props"))
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propositions(spark, sf_dir).where(scoring.is_current(AS_OF)).select("id")


@query("f17_touched_between", sql("SELECT id FROM props WHERE touched BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-09 00:00:00' AND created BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-08 12:00:00'", "props"))
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propositions(spark, sf_dir).where(scoring.last_touched().between(scoring.moment("2024-01-08 00:00:00"), scoring.moment("2024-01-09 00:00:00")) & F.col("created").between(scoring.moment("2024-01-01 00:00:00"), scoring.moment("2024-01-08 12:00:00"))).select("id")


@query("f18_effective_above", sql("SELECT id, round(eff, 6) AS effective FROM props WHERE eff > 0.6012345", "props"))
def f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    eff = scoring.effective_confidence(AS_OF)
    return propositions(spark, sf_dir).where(eff > 0.6012345).select("id", F.round(eff, 6).alias("effective")).orderBy(F.desc("effective"), "id")


@query("f21_post_filters", sql("SELECT id, type FROM (SELECT id FROM (SELECT * FROM props ORDER BY confidence DESC, id LIMIT 200) WHERE context_id = 'ctx-5' AND status = 'ACTIVE' AND confidence >= 0.5) JOIN (SELECT DISTINCT proposition_id, type FROM mentions WHERE type IN ('EventType')) ON id = proposition_id", "props", "mentions"))
def f21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters after the top k, which leave fewer than k rows."""
    top = propositions(spark, sf_dir).orderBy(F.desc("confidence"), "id").limit(200)
    kept = top.where("context_id = 'ctx-5' AND status = 'ACTIVE' AND confidence >= 0.5").where(F.exists("mentions", lambda m: m["type"].isin("EventType")))
    return kept.select("id", F.lit("EventType").alias("type"))


@query("f22_mention_type", sql("SELECT DISTINCT proposition_id AS id FROM mentions WHERE type = 'Person' AND role = 'OTHER'", "mentions"))
def f22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propositions(spark, sf_dir).where(F.exists("mentions", lambda m: (m["type"] == "Person") & (m["role"] == "OTHER"))).select("id")


@query("o03_nulls_last", sql("SELECT id, round(trust_score, 6) AS trust, row_number() OVER (ORDER BY trust_score DESC NULLS LAST, id) AS place FROM props WHERE context_id = 'ctx-6'", "props"))
def o03(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("context_id").orderBy(F.col("trust_score").desc_nulls_last(), "id")
    return propositions(spark, sf_dir).where("context_id = 'ctx-6'").select("id", F.round("trust_score", 6).alias("trust"), F.row_number().over(w).alias("place"))


@query("o09_report_top", sql("SELECT id, round(eff, 6) AS effective FROM props ORDER BY eff DESC, id LIMIT 10", "props"))
def o09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(propositions(spark, sf_dir), QuerySpec(order_by="effective_confidence", as_of=AS_OF, limit=10)).select("id", F.round(scoring.effective_confidence(AS_OF), 6).alias("effective"))


@query("o11_prompt_list", sql("SELECT id, text FROM props WHERE status = 'ACTIVE' ORDER BY confidence DESC, id LIMIT 100", "props"))
def o11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propositions(spark, sf_dir).where("status = 'ACTIVE'").orderBy(F.desc("confidence"), "id").limit(100).select("id", "text")


@query("m02_utility", sql(f"SELECT id, round({util()}, 6) AS utility FROM props", "props"))
def m02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propositions(spark, sf_dir).select("id", F.round(scoring.utility(AS_OF), 6).alias("utility"))


@query("u01_recall_union", sql("SELECT id FROM props WHERE context_id = 'ctx-1' AND confidence > 0.8 UNION SELECT proposition_id FROM mentions WHERE context_id = 'ctx-1' AND resolved_id = 'type-signup'", "props", "mentions"))
def u01(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propositions(spark, sf_dir).where("context_id = 'ctx-1'")
    return p.where("confidence > 0.8").select("id").unionByName(p.where(F.exists("mentions", lambda m: m["resolved_id"] == "type-signup")).select("id")).dropDuplicates(["id"])


@query("u04_minus_eager", sql("SELECT id FROM props WHERE context_id = 'ctx-1' AND importance > 0.4 EXCEPT SELECT id FROM props WHERE pinned", "props"))
def u04(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propositions(spark, sf_dir)
    return p.where("context_id = 'ctx-1' AND importance > 0.4").join(p.where("pinned").select("id"), "id", "left_anti").select("id")


@query("u03_eager_first_wins", sql("SELECT id, min(rank) AS source FROM (SELECT proposition_id AS id, 0 AS rank FROM mentions WHERE resolved_id = 'user-11' UNION ALL SELECT id, 1 FROM props WHERE text LIKE '%error%' AND context_id = 'ctx-1' UNION ALL SELECT id, 2 FROM props WHERE context_id = 'ctx-1' AND eff >= 0.5) GROUP BY id", "props", "mentions"))
def u03(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propositions(spark, sf_dir)
    about = p.where(F.exists("mentions", lambda m: m["resolved_id"] == "user-11")).select("id", F.lit(0).alias("source"))
    topic = p.where("context_id = 'ctx-1'").where(F.col("text").contains("error")).select("id", F.lit(1).alias("source"))
    asked = run(p, QuerySpec(context_id="ctx-1", min_effective_confidence=0.5, as_of=AS_OF)).select("id", F.lit(2).alias("source"))
    return about.unionByName(topic).unionByName(asked).groupBy("id").agg(F.min("source").alias("source"))


@query("u07_array_union", sql("SELECT id, CASE WHEN level = 1 THEN 2 ELSE 1 END AS n_grounding FROM props", "props"))
def u07(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.col("level") == 1, F.array(F.lit("extra"), F.element_at("grounding", 1))).otherwise(F.col("grounding"))
    return propositions(spark, sf_dir).select("id", F.size(F.array_union("grounding", more)).alias("n_grounding"))


@query("j01_by_mention", sql("SELECT DISTINCT proposition_id AS id, resolved_id FROM mentions WHERE resolved_id IN (SELECT 'user-' || user_id FROM events)", "mentions"))
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("resolved_id")).distinct()
    return exploded_mentions(propositions(spark, sf_dir)).join(people, "resolved_id", "left_semi").select(F.col("proposition_id").alias("id"), "resolved_id").distinct()
