"""S* store queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import exploded_mentions, propositions, provenance
from ..operators import store
from ..operators.records import find, runs
from ..operators.resolve import mention_resolutions
from ..session import table
from .aggregates import RECORDS, records
from .registry import query
from .sql import sql


def _changed(p: DataFrame) -> DataFrame:
    """Every third row again with more confidence, and as many new ones."""
    return p.where("event_id % 3 = 0").withColumn("confidence", F.lit(1.0)).unionByName(p.where("event_id % 5 = 0").withColumn("id", F.concat(F.lit("new-"), F.col("event_id").cast("string"))))


@query("s01_s09_upsert", sql("SELECT id, round(CASE WHEN event_id % 3 = 0 THEN 1.0::DOUBLE ELSE confidence END, 6) AS confidence FROM props UNION ALL SELECT 'new-' || event_id, round(confidence, 6) FROM props WHERE event_id % 5 = 0", "props"))
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propositions(spark, sf_dir)
    return store.upsert(p.select("id", "confidence"), _changed(p).select("id", "confidence"), ["id"]).select("id", F.round("confidence", 6).alias("confidence"))


@query("s03_insert_if_absent", sql("SELECT min(id) AS id, context_id, text FROM props WHERE event_id % 2 = 0 GROUP BY ALL UNION ALL SELECT min(id), context_id, text FROM props WHERE event_id % 2 = 1 AND (context_id, text) NOT IN (SELECT context_id, text FROM props WHERE event_id % 2 = 0) GROUP BY ALL", "props"))
def s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propositions(spark, sf_dir).select("id", "context_id", "text", "event_id")
    keys = ["context_id", "text"]
    old = store.insert_if_absent(p.limit(0), p.where("event_id % 2 = 0"), keys)
    return store.insert_if_absent(old, p.where("event_id % 2 = 1"), keys).select("id", *keys)


@query("s04_two_phase_save", sql("SELECT proposition_id, 'mention' AS part, span AS value FROM mentions WHERE proposition_id NOT IN (SELECT id FROM props WHERE event_id % 4 = 0) UNION ALL SELECT id, 'mention', 'replaced' FROM props WHERE event_id % 4 = 0 UNION ALL SELECT proposition_id, 'source', key FROM provenance GROUP BY ALL UNION ALL SELECT id, 'source', 'uri:new' FROM props WHERE event_id % 4 = 0", "props", "mentions", "provenance"))
def s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propositions(spark, sf_dir)
    saved = p.where("event_id % 4 = 0").select(F.col("id").alias("proposition_id"))
    old_m = exploded_mentions(p).select("proposition_id", "span")
    old_s = provenance(spark, sf_dir).select("proposition_id", "kind", "key")
    again = old_s.join(saved, "proposition_id", "left_semi")
    m, s = store.save_two_phase(old_m, saved.withColumn("span", F.lit("replaced")), old_s, again.unionByName(saved.select("proposition_id", F.lit("uri").alias("kind"), F.lit("uri:new").alias("key"))))
    return m.select("proposition_id", F.lit("mention").alias("part"), F.col("span").alias("value")).unionByName(s.select("proposition_id", F.lit("source").alias("part"), F.col("key").alias("value")))


@query("s07_find_by_id", sql("SELECT id, text FROM props WHERE id = 'ev-321'", "props"))
def s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propositions(spark, sf_dir).where("id = 'ev-321'").select("id", "text")


@query("s08_find_all", sql("SELECT id, text, status FROM props", "props"))
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propositions(spark, sf_dir).select("id", "text", "status")


@query("s10_delete", sql("SELECT id FROM props WHERE event_id % 6 <> 0", "props"))
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propositions(spark, sf_dir)
    return store.without(p, p.where("event_id % 6 = 0")).select("id")


@query("s11_clear_context_prefix", sql("SELECT id, n AS cleared FROM props, (SELECT count(*) AS n FROM props WHERE context_id LIKE 'ctx-1%') WHERE context_id NOT LIKE 'ctx-1%'", "props"))
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    stay, n = store.clear(propositions(spark, sf_dir), prefix="ctx-1")
    return stay.select("id", F.lit(n).cast("bigint").alias("cleared"))


@query("s12_cascade_clear", sql("SELECT DISTINCT key FROM provenance WHERE key NOT IN (SELECT key FROM provenance JOIN props ON id = proposition_id WHERE pinned)", "props", "provenance"))
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the pinned propositions are cleared."""
    p, s = propositions(spark, sf_dir), provenance(spark, sf_dir)
    return store.orphans(s.select("key").distinct(), s, p.where("pinned"))


@query("s14_provenance_edit", sql("SELECT id, CASE WHEN event_id % 3 = 1 THEN 0 WHEN event_id % 3 = 2 THEN 1 ELSE coalesce(n, 0) + 1 END AS n FROM props LEFT JOIN (SELECT proposition_id, count(*) AS n FROM provenance GROUP BY 1) ON id = proposition_id", "props", "provenance"))
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added to, cleared or replaced, by the id."""
    rows = store.with_provenance(propositions(spark, sf_dir), provenance(spark, sf_dir))
    one = F.array(F.struct(F.lit(9).alias("pos"), F.lit("uri").alias("kind"), F.lit("uri:more").alias("key"), F.lit("more").alias("display")))
    edited = F.when(F.col("event_id") % 3 == 0, F.array_union("provenance", one)).when(F.col("event_id") % 3 == 1, F.slice("provenance", 1, 0)).otherwise(one)
    return rows.select("id", F.size(edited).cast("bigint").alias("n"))


@query("s15_j17_enriched_read", sql("SELECT id, coalesce(n, 0) AS n_sources, keys FROM props LEFT JOIN (SELECT proposition_id, count(*) AS n, string_agg(key, ',' ORDER BY pos) AS keys FROM provenance GROUP BY 1) ON id = proposition_id", "props", "provenance"))
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.with_provenance(propositions(spark, sf_dir), provenance(spark, sf_dir))
    return rows.select("id", F.size("provenance").cast("bigint").alias("n_sources"), F.when(F.size("provenance") > 0, F.array_join("provenance.key", ",")).alias("keys"))


@query("s16_s18_find_by", sql("SELECT 'entity' AS how, proposition_id AS id FROM mentions WHERE resolved_id = 'user-42' UNION SELECT 'status', id FROM props WHERE status = 'PROMOTED' AND level >= 1 UNION SELECT 'grounding', id FROM props WHERE chunk = 'chunk-17'", "props", "mentions"))
def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propositions(spark, sf_dir)
    tagged = lambda df, how: df.select(F.lit(how).alias("how"), "id")
    return store.union_all([tagged(p.where(F.exists("mentions", lambda m: m["resolved_id"] == "user-42")), "entity"), tagged(p.where("status = 'PROMOTED' AND level >= 1"), "status"), tagged(p.where(F.array_contains("grounding", "chunk-17")), "grounding")]).distinct()


@query("s19_pins", sql("SELECT id FROM props WHERE pinned AND id NOT IN ('ev-0', 'ev-100') OR id = 'ev-7'", "props"))
def s19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.pin(store.pin(propositions(spark, sf_dir), ["ev-7"]), ["ev-0", "ev-100"], False).where("pinned").select("id")


@query("s20_projection_records", sql("SELECT proposition_id, target, run_id FROM records WHERE context_id = 'ctx-3' AND lifecycle = 'STALE' OR target_ref = 'ref-9'", records=RECORDS))
def s20(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return find(r, context_id="ctx-3", stale=True).union(find(r, target_ref="ref-9")).distinct().select("proposition_id", "target", "run_id")


@query("s21_s24_merge_records", sql("SELECT run_id, target, max(price) AS price FROM records GROUP BY ALL", records=RECORDS))
def s21(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).select("run_id", "target", "price")
    return store.upsert(r.limit(0), r, ["run_id", "target"], "price")


@query("s22_l23_mark_stale", sql("SELECT proposition_id, run_id, CASE WHEN p.status IN ('SUPERSEDED', 'CONTRADICTED', 'STALE') THEN 'STALE' ELSE lifecycle END AS lifecycle, p.status IN ('SUPERSEDED', 'CONTRADICTED', 'STALE') AND lifecycle <> 'STALE' IS TRUE AS changed FROM records LEFT JOIN props p ON p.id = proposition_id WHERE p.id IS NOT NULL", "props", records=RECORDS).replace("IS TRUE AS changed", "AS changed"))
def s22(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.lifecycle import stale_cascade

    p = propositions(spark, sf_dir)
    own = records(spark, sf_dir).join(p.select(F.col("id").alias("proposition_id")), "proposition_id", "left_semi")
    return stale_cascade(own, p.select("id", F.col("status").alias("new_status"))).select("proposition_id", "run_id", "lifecycle", "changed")


@query("s23_collector_records", sql("SELECT run_id, count(*) AS n, count(DISTINCT proposition_id) AS n_propositions FROM records GROUP BY run_id", records=RECORDS))
def s23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(records(spark, sf_dir))


@query("s25_safe_rows", "SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'SKIPPED' WHEN o_orderstatus = 'O' THEN 'MARKED' ELSE 'SKIPPED' END AS outcome, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE epoch_us(TIMESTAMP '2024-01-02 03:04:05') // 1000000 END AS at FROM orders")
def s25(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderstatus") == "O", "MARKED").otherwise("nonsense")
    at = F.when(F.col("o_orderkey") % 3 == 0, "not a time").otherwise("2024-01-02 03:04:05")
    return o.select(F.col("o_orderkey").alias("k"), store.safe_outcome(name).alias("outcome"), F.unix_seconds(store.safe_time(at)).alias("at"))


@query("s28_mention_ids", sql("SELECT proposition_id || '#' || pos || ':' || span || '|' || type || '|' || role || '|' || coalesce(resolved_id, '') AS mention_id FROM mentions", "mentions"))
def s28(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = exploded_mentions(propositions(spark, sf_dir))
    return m.select(store.mention_id(F.col("proposition_id"), F.col("pos"), F.col("span"), F.col("type"), F.col("role"), F.col("resolved_id")).alias("mention_id"))


@query("s34_events", sql("SELECT id, CASE WHEN event_id % 4 = 3 OR new = 'ACTIVE' THEN 'PERSISTED' ELSE 'STATUS_CHANGED' END AS event FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'STALE' ELSE 'ACTIVE' END AS new FROM props) WHERE event_id % 4 = 3 OR new = 'ACTIVE' OR new <> status", "props"))
def s34(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propositions(spark, sf_dir)
    new = p.withColumn("status", F.when(F.col("event_id") % 2 == 0, "STALE").otherwise("ACTIVE"))
    return store.events(p.where("event_id % 4 <> 3"), new).select("id", "event")


@query("j12_mention_resolutions", sql("SELECT proposition_id, pos, upper(type) || ':' || span AS entity FROM mentions WHERE type = 'EventType' UNION ALL SELECT proposition_id, pos, NULL FROM mentions WHERE type <> 'EventType'", "mentions"))
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions with the resolution of the same span and type, in any case and spacing."""
    m = exploded_mentions(propositions(spark, sf_dir))
    known = m.where("type = 'EventType'").select(F.upper("span").alias("span"), F.concat(F.lit(" "), F.col("type")).alias("type"), F.concat(F.upper("type"), F.lit(":"), F.col("span")).alias("entity")).distinct()
    return mention_resolutions(m, known).select("proposition_id", "pos", "entity")


@query("w03_first_of_batch", sql("SELECT id FROM (SELECT id, event_id, row_number() OVER (PARTITION BY context_id, text ORDER BY id) AS nth FROM props) WHERE nth = 1", "props"))
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.revise import first_of_batch

    return first_of_batch(propositions(spark, sf_dir)).select("id")
