"""A* and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import AS_OF, artifacts, exploded_mentions, propositions, vectors
from ..functions.scoring import effective_confidence
from ..operators import outcomes, consolidate, lifecycle, project, resolve, store
from ..operators.graph import components
from ..operators.vectors import similar_pairs
from ..plans import reports
from ..session import table
from .registry import query
from .sql import sql


@query("a01_report_counts", sql("SELECT 'status' AS dimension, status AS value, count(*) AS n FROM props GROUP BY ALL UNION ALL SELECT 'level', CAST(level AS VARCHAR), count(*) FROM props GROUP BY ALL UNION ALL SELECT 'total', '', count(*) FROM props", "props"))
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts(propositions(spark, sf_dir))


@query("p09_report_summary", sql("SELECT string_agg(dimension || CASE WHEN value <> '' THEN ' ' || value ELSE '' END || ': ' || n, chr(10) ORDER BY dimension, value) AS summary FROM c", "props", c="SELECT 'status' AS dimension, status AS value, count(*) AS n FROM props GROUP BY ALL UNION ALL SELECT 'level', CAST(level AS VARCHAR), count(*) FROM props GROUP BY ALL UNION ALL SELECT 'total', '', count(*) FROM props"))
def p09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summary(propositions(spark, sf_dir))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection records: one for each order, by priority and status."""
    o = F.col("o_orderkey")
    life = F.element_at(F.array(*[F.lit(x) for x in ("PROJECTED", "ADOPTED", "SKIPPED", "FAILED", "STALE", "bogus")]), (o % 6).cast("int") + 1)
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("ev-"), o.cast("string")).alias("proposition_id"), F.lower("o_orderpriority").alias("target"), F.concat(F.lit("ref-"), (o % 50).cast("string")).alias("target_ref"), store.safe_lifecycle(life).alias("lifecycle"), F.concat(F.lit("run-"), (o % 7).cast("string")).alias("run_id"), F.concat(F.lit("ctx-"), (F.col("o_custkey") % 10).cast("string")).alias("context_id"), F.col("o_totalprice").alias("price"))


RECORDS = "SELECT 'ev-' || o_orderkey AS proposition_id, lower(o_orderpriority) AS target, 'ref-' || (o_orderkey % 50) AS target_ref, ['PROJECTED', 'ADOPTED', 'SKIPPED', 'FAILED', 'STALE', 'FAILED'][o_orderkey % 6 + 1] AS lifecycle, 'run-' || (o_orderkey % 7) AS run_id, 'ctx-' || (o_custkey % 10) AS context_id, o_totalprice AS price FROM orders"


@query("a02_projection_health", sql("SELECT target, " + ", ".join(f"count(*) FILTER (lifecycle = '{x}') AS {x.lower()}" for x in ("PROJECTED", "ADOPTED", "SKIPPED", "FAILED", "STALE")) + " FROM records GROUP BY target", records=RECORDS))
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.health(records(spark, sf_dir))


@query("a04_resolution_coverage", sql("SELECT count(*) FILTER (r = n) AS fully, count(*) FILTER (r > 0 AND r < n) AS partly, count(*) FILTER (r = 0) AS none FROM (SELECT proposition_id, count(*) AS n, count(resolved_id) AS r FROM mentions GROUP BY 1)", "mentions"))
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    full, some = project.fully_resolved(), F.exists("mentions", lambda m: m["resolved_id"].isNotNull())
    return propositions(spark, sf_dir).agg(F.count_if(full).alias("fully"), F.count_if(some & ~full).alias("partly"), F.count_if(~some).alias("none"))


@query("a06_projection_reasons", sql("SELECT CASE WHEN confidence < 0.85 THEN 'confidence below 0.85' WHEN event_id % 13 = 0 THEN 'a mention is not resolved' ELSE 'projected' END AS reason, count(*) AS n FROM props GROUP BY ALL", "props"))
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propositions(spark, sf_dir).groupBy(F.coalesce(project.policy_reason("strict"), F.lit("projected")).alias("reason")).agg(F.count("*").alias("n"))


_KIND = "CASE WHEN decay > 0.5 THEN 'EPISODIC' WHEN confidence > 0.7 AND decay < 0.3 THEN 'SEMANTIC' ELSE 'WORKING' END"


@query("a07_p08_memory_sections", sql(f"SELECT kind, CASE kind WHEN 'SEMANTIC' THEN 'Known facts' WHEN 'EPISODIC' THEN 'Recent events' ELSE 'Current context' END AS title, string_agg('- ' || text, chr(10) ORDER BY nth) AS body FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY confidence DESC, id) AS nth FROM (SELECT *, {_KIND} AS kind FROM props)) WHERE nth <= 5 GROUP BY kind", "props"))
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.memory_sections(propositions(spark, sf_dir).withColumn("kind", project.knowledge_type()))


@query("a08_entity_groups", sql("SELECT resolved_id AS entity, count(DISTINCT proposition_id) AS n, min(proposition_id) AS first FROM mentions WHERE status = 'ACTIVE' AND resolved_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT proposition_id) >= 20", "mentions"))
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.entity_groups(propositions(spark, sf_dir), 20).select("entity", F.size("members").cast("bigint").alias("n"), F.element_at("members", 1).alias("first"))


@query("a09_grouped_marks", sql("SELECT id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM (SELECT id, 'stale' AS reason FROM props WHERE eff < 0.1 UNION ALL SELECT id, 'duplicate' FROM props WHERE event_id % 3 = 0 UNION ALL SELECT id, 'duplicate' FROM props WHERE event_id % 6 = 0) GROUP BY id", "props"))
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propositions(spark, sf_dir)
    marks = p.where(effective_confidence(AS_OF) < 0.1).select("id", F.lit("stale").alias("reason"))
    for n in (3, 6):
        marks = marks.unionByName(p.where(F.col("event_id") % n == 0).select("id", F.lit("duplicate").alias("reason")))
    return marks.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))


@query("a11_l21_survivors", sql("SELECT id AS proposition_id, best AS survivor_id FROM (SELECT v.id, first_value(v.id) OVER (PARTITION BY root ORDER BY eff DESC, rc DESC, v.id DESC) AS best FROM scored v JOIN roots ON node = v.id) WHERE id <> best", "vectors", recursive=True, scored="SELECT id, CAST(split_part(id, '-', 2) AS INT) % 5 / 5.0::DOUBLE AS eff, CAST(split_part(id, '-', 2) AS INT) % 3 AS rc FROM vectors", near="SELECT a.id AS x, b.id AS y FROM vectors a JOIN vectors b ON a.context_id = b.context_id AND a.id <> b.id AND list_cosine_similarity(a.embedding, b.embedding) >= 0.3300007", reach="SELECT x AS node, y AS other FROM near UNION SELECT reach.node, near.y FROM reach JOIN near ON near.x = reach.other", roots="SELECT node, min(least(node, other)) AS root FROM reach GROUP BY node"))
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    n = F.substring_index("id", "-", -1).cast("int")
    scored = v.select("id", ((n % 5) / F.lit(5.0)).alias("effective"), (n % 3).alias("reinforce_count"))
    roots = components(similar_pairs(v, 0.3300007).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    return lifecycle.duplicate_marks(scored, roots).select("proposition_id", "survivor_id")


@query("a12_strongest_status", sql("SELECT id, CASE max(CASE s WHEN 'ACTIVE' THEN 0 WHEN 'PROMOTED' THEN 1 WHEN 'STALE' THEN 2 WHEN 'SUPERSEDED' THEN 3 WHEN 'CONTRADICTED' THEN 4 END) WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'PROMOTED' WHEN 2 THEN 'STALE' WHEN 3 THEN 'SUPERSEDED' ELSE 'CONTRADICTED' END AS status FROM (SELECT id, status AS s FROM props UNION ALL SELECT id, CASE WHEN event_id % 2 = 0 THEN 'STALE' ELSE 'ACTIVE' END FROM props) GROUP BY id", "props"))
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propositions(spark, sf_dir)
    return lifecycle.strongest(p.select("id", "status").unionByName(p.select("id", F.when(F.col("event_id") % 2 == 0, "STALE").otherwise("ACTIVE").alias("status"))))


@query("a13_merge_aggregate", sql("SELECT context_id, round(avg(confidence), 6) AS confidence, count(DISTINCT chunk) AS n_grounding, max_by(id, (confidence, id)) AS base FROM props GROUP BY context_id", "props"))
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.size(F.array_distinct(F.flatten(F.collect_set("grounding")))).cast("bigint")
    return propositions(spark, sf_dir).groupBy("context_id").agg(F.round(F.avg("confidence"), 6).alias("confidence"), g.alias("n_grounding"), F.max(F.struct("confidence", "id"))["id"].alias("base"))


@query("a14_l31_abstractions", sql("SELECT g.entity, c.context_id, g.level, round(g.decay, 10) AS decay, round(g.confidence, 10) AS confidence, g.n AS n_sources FROM (SELECT entity, max(level) + 1 AS level, avg(decay) AS decay, avg(confidence) AS confidence, count(*) AS n FROM x GROUP BY entity HAVING count(*) >= 3) g JOIN (SELECT entity, context_id FROM (SELECT entity, context_id, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, context_id) AS nth FROM x GROUP BY entity, context_id) WHERE nth = 1) c USING (entity)", "props", "mentions", x="SELECT DISTINCT m.resolved_id AS entity, p.id, p.context_id, p.level, p.decay, p.confidence FROM props p JOIN mentions m ON m.proposition_id = p.id WHERE p.status = 'ACTIVE' AND p.level < 3 AND m.resolved_id IS NOT NULL"))
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = consolidate.abstractions(propositions(spark, sf_dir))
    return a.select("entity", "context_id", "level", F.round("decay", 10).alias("decay"), F.round("confidence", 10).alias("confidence"), "n_sources")


@query("a16_fallback_confidence", sql("SELECT coalesce(max(CASE WHEN context_id = 'ctx-1' THEN round(confidence, 6) END), 0.7) AS found, coalesce(max(CASE WHEN context_id = 'none' THEN confidence END), 0.7::DOUBLE) AS missing FROM props", "props"))
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = lambda c: F.coalesce(F.max(F.when(F.col("context_id") == c, F.round("confidence", 6))), F.lit(0.7))
    return propositions(spark, sf_dir).agg(best("ctx-1").alias("found"), best("none").alias("missing"))


_FOUND = r"SELECT 'a' || (c_custkey % 3) AS analyzer, 'Dr. Seg ' || lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' ' || c_nationkey END AS name, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END AS n_labels, c_name AS summary FROM customer"


@query("a17_e21_agreed_entities", sql(r"SELECT key, count(DISTINCT analyzer) AS n, min_by(name, (-(n_labels * 10 + length(summary)), name, summary)) AS name, min_by(summary, (-(n_labels * 10 + length(summary)), name, summary)) AS summary FROM (SELECT *, trim(regexp_replace(lower(name), '^dr\. ', '')) AS key FROM found) GROUP BY key HAVING count(DISTINCT analyzer) >= 2", found=_FOUND))
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(F.lit("Dr. Seg "), F.lower("c_mktsegment"), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit(" "), F.col("c_nationkey").cast("string"))))
    labels = F.when(k % 4 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))
    found = table(spark, sf_dir, "customer").select(F.concat(F.lit("a"), (k % 3).cast("string")).alias("analyzer"), name.alias("name"), labels.alias("labels"), F.col("c_name").alias("summary"))
    return resolve.agreed(found)


@query("a18_agreed_edges", "SELECT 's' || l_suppkey AS source_id, 'p' || (l_partkey % 100) AS target_id, 'SHIPS' AS type, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_linenumber) >= 3")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    found = table(spark, sf_dir, "lineitem").select(text("s", F.col("l_suppkey")).alias("source_id"), text("p", F.col("l_partkey") % 100).alias("target_id"), F.lit("SHIPS").alias("type"), F.col("l_linenumber").alias("analyzer"))
    return outcomes.agreed_edges(found, 3)


@query("a19_ingestion_counts", sql("SELECT count(*) FILTER (nth = 1) AS ingested, count(*) FILTER (nth > 1) AS deduplicated FROM (SELECT row_number() OVER (PARTITION BY content_hash ORDER BY source_id) AS nth FROM artifacts)", "artifacts"))
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.unclaimed(artifacts(spark, sf_dir)).agg(F.count_if(F.col("outcome") == "INGESTED").alias("ingested"), F.count_if(F.col("outcome") == "DEDUPLICATED").alias("deduplicated"))


@query("a20_context_counts", sql("SELECT context_id, count(*) AS n FROM props GROUP BY 1", "props"))
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propositions(spark, sf_dir).groupBy("context_id").agg(F.count("*").alias("n"))


@query("x13_structured_report", sql("SELECT id, text, round(eff, 6) AS effective FROM props ORDER BY eff DESC, id LIMIT 10", "props"))
def x13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top(propositions(spark, sf_dir), AS_OF).withColumn("effective", F.round("effective", 6))


@query("j19_mentioned_entities", sql("SELECT DISTINCT resolved_id AS entity FROM mentions JOIN props ON id = proposition_id WHERE resolved_id IS NOT NULL AND confidence >= 0.6", "props", "mentions"))
def j19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded_mentions(propositions(spark, sf_dir).where("confidence >= 0.6")).where("resolved_id IS NOT NULL").select(F.col("resolved_id").alias("entity")).distinct()
