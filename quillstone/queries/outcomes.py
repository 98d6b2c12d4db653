"""Queries of edits, revision outcomes, records, chunk entities and rule helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import AS_OF, entities, exploded_mentions, facts, name_word, propositions, provenance
from ..functions import mention_rules
from ..operators import datalog, edits, graph, outcomes, project, records, resolve, store
from ..plans import ingest
from ..session import table
from .graphs import _PROJECTED, relations
from .registry import query
from .sql import AT, sql
from .sql import name_word as name_word_sql

_TEXT = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("p06_clock_edits", sql(f"""SELECT id, CASE WHEN event_id % 4 = 0 THEN text || '!' ELSE text END AS text, CASE WHEN event_id % 4 = 1 THEN 'STALE' ELSE status END AS status, round(CASE WHEN event_id % 4 = 2 THEN confidence / 2 ELSE confidence END, 6) AS confidence,
  CASE WHEN event_id % 4 IN (0, 2) THEN {AT} ELSE content_revised END AS content_revised, CASE WHEN event_id % 4 = 1 OR event_id % 5 = 0 THEN {AT} ELSE metadata_revised END AS metadata_revised, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS n_grounding FROM props""", "props"))
def p06(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, e = propositions(spark, sf_dir), F.col("event_id")
    p = edits.edited(p, AS_OF, e % 4 == 0, text=F.concat("text", F.lit("!")))
    p = edits.edited(p, AS_OF, e % 4 == 1, status=F.lit("STALE"))
    p = edits.edited(p, AS_OF, e % 4 == 2, confidence=F.col("confidence") / 2)
    p = edits.edited(p, AS_OF, e % 5 == 0, grounding=edits.grounded_in(F.array(F.lit("chunk-more"), F.lit("chunk-more"))))
    return p.select("id", "text", "status", F.round("confidence", 6).alias("confidence"), "content_revised", "metadata_revised", F.size("grounding").alias("n_grounding"))


@query("l15_cached_trust", sql(f"SELECT id, content_revised, {AT} AS metadata_revised, round([0.9, 0.75, 0.6, 0.5][tier + 1]::DOUBLE, 6) AS trust FROM props JOIN tiers ON proposition_id = id", "props", "tiers"))
def l15(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scoring import trust_of_tier
    from ..schema import TRUST_KEY

    rows = store.with_authority(propositions(spark, sf_dir), provenance(spark, sf_dir)).withColumn("metadata", F.create_map(F.lit(TRUST_KEY), F.lit("old"), F.lit("other"), F.lit("1")))
    out = edits.with_trust(rows, trust_of_tier(F.col("authority")), AS_OF)
    return out.select("id", "content_revised", "metadata_revised", F.round(F.col("metadata")[TRUST_KEY].cast("double"), 6).alias("trust"))


def revised(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every fourth event is new; one of each action in turn, two new ones to an existing row."""
    p, e = propositions(spark, sf_dir), F.col("event_id")
    new, old = p.where("event_id % 4 = 0"), p.where("event_id % 4 <> 0")
    action = F.element_at(F.array(*[F.lit(a) for a in outcomes.ACTIONS]), (F.floor(e / 4) % 5 + 1).cast("int"))
    match = F.when(~action.isin("NEW", "GENERALIZED"), _TEXT("ev-", e - e % 8 + 1))
    return new.select("id", action.alias("action"), match.alias("match_id")), new, old


_RESULTS = f"SELECT *, list_value({', '.join(repr(a) for a in outcomes.ACTIONS)})[event_id // 4 % 5 + 1] AS action FROM props WHERE event_id % 4 = 0"
_CHANGES = """SELECT o.id, CASE action WHEN 'MERGED' THEN least(0.99::DOUBLE, o.confidence + 0.3::DOUBLE * n.confidence) WHEN 'REINFORCED' THEN least(0.95::DOUBLE, o.confidence + 0.1::DOUBLE * n.confidence) ELSE CASE WHEN o.pinned THEN o.confidence ELSE greatest(0.05::DOUBLE, o.confidence * 0.3::DOUBLE) END END AS confidence,
  CASE action WHEN 'MERGED' THEN o.decay * 0.7::DOUBLE WHEN 'REINFORCED' THEN o.decay * 0.85::DOUBLE ELSE CASE WHEN o.pinned THEN o.decay ELSE least(1.0::DOUBLE, o.decay + 0.15::DOUBLE) END END AS decay,
  CASE WHEN action = 'CONTRADICTED' AND NOT o.pinned THEN 'CONTRADICTED' ELSE o.status END AS status, CAST(o.reinforce_count + CASE WHEN action = 'CONTRADICTED' THEN 0 ELSE 1 END AS INT) AS reinforce_count,
  CASE WHEN action = 'CONTRADICTED' THEN o.chunk WHEN o.chunk = n.chunk THEN o.chunk || ',more' ELSE o.chunk || ',' || n.chunk || ',more' END AS grounding, n.id AS giver FROM results n JOIN props o ON o.event_id = n.event_id - n.event_id % 8 + 1 WHERE action NOT IN ('NEW', 'GENERALIZED')"""


@query("l13_rows_to_persist", sql("""SELECT id, round(confidence, 6) AS confidence, round(decay, 6) AS decay, status, reinforce_count, chunk || ',more' AS grounding FROM results WHERE action IN ('NEW', 'CONTRADICTED', 'GENERALIZED')
UNION ALL SELECT id, round(confidence, 6), round(decay, 6), status, reinforce_count, grounding FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, giver) AS nth FROM changes) WHERE nth = 1""", "props", results=_RESULTS, changes=_CHANGES))
def l13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a chunk more in the grounding of what is new (I11)."""
    out = outcomes.to_persist(*revised(spark, sf_dir), grounding=F.array(F.lit("more")))
    return out.select("id", F.round("confidence", 6).alias("confidence"), F.round("decay", 6).alias("decay"), "status", "reinforce_count", F.array_join("grounding", ",").alias("grounding"))


@query("a03_extraction_counts", sql(f"SELECT {', '.join(f'''count(*) FILTER (action = '{a}') AS {a.lower()}''' for a in outcomes.ACTIONS)}, count(*) AS total FROM results", "props", results=_RESULTS))
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.extraction_counts(revised(spark, sf_dir)[0])


@query("p04_full_rows", sql("SELECT p.id, p.context_id, p.text, CASE WHEN p.event_id % 9 = 0 THEN 3 ELSE 2 END AS n_mentions, p.chunk AS grounding, coalesce(s.keys, '') AS sources, p.touched AS revised, p.status, CASE WHEN r.action = 'NEW' THEN 'CREATED' ELSE r.action END AS action FROM props p LEFT JOIN results r ON r.id = p.id LEFT JOIN (SELECT proposition_id, string_agg(key, ',' ORDER BY pos) AS keys FROM provenance GROUP BY 1) s ON s.proposition_id = p.id", "props", "provenance", results=_RESULTS))
def p04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outcomes.full_rows(store.with_provenance(propositions(spark, sf_dir), provenance(spark, sf_dir)), revised(spark, sf_dir)[0])
    return rows.select("id", "context_id", "text", F.size("mentions").alias("n_mentions"), F.array_join("grounding", ",").alias("grounding"), F.array_join("provenance.key", ",").alias("sources"), "revised", "status", "action")


def analysed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Names of 64 kinds of parts as mentions of orders' chunks, and two of three kinds as known entities, half with another label."""
    kind, name = F.col("l_partkey") % 64, lambda k: F.concat(name_word(k), F.lit(" "), name_word(k + 1000))
    m = table(spark, sf_dir, "lineitem").select(_TEXT("chunk-", F.col("l_orderkey")).alias("chunk_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place"), name(kind).alias("span"), F.lit("Part").alias("type"))
    k = F.col("k")
    known = table(spark, sf_dir, "part").select((F.col("p_partkey") % 64).alias("k")).distinct().where("k % 3 <> 0")
    return m, known.select(_TEXT("part-", k).alias("id"), name(k).alias("name"), F.when(k % 2 == 0, F.array(F.lit("Part"))).otherwise(F.array(F.lit("Thing"))).alias("labels"))


_CHUNKS = {
    "m": f"SELECT 'chunk-' || l_orderkey AS chunk_id, l_orderkey * 8 + l_linenumber AS place, lower({name_word_sql('l_partkey % 64')} || ' ' || {name_word_sql('l_partkey % 64 + 1000')}) AS name FROM lineitem",
    "known": f"SELECT DISTINCT lower({name_word_sql('p_partkey % 64')} || ' ' || {name_word_sql('p_partkey % 64 + 1000')}) AS name, p_partkey % 64 AS k FROM part WHERE p_partkey % 64 % 3 <> 0",
    "found": "SELECT m.*, CASE WHEN k IS NULL THEN 'NEW' WHEN k % 2 = 0 THEN 'REFERENCE' ELSE 'UPDATED' END AS kind, k FROM m LEFT JOIN known USING (name)",
}


@query("e16_u05_chunk_entities", sql("SELECT name, kind, CASE WHEN k IS NOT NULL THEN 'part-' || k END AS id, arg_min(chunk_id, place) AS chunk_id FROM found GROUP BY ALL", **_CHUNKS))
def e16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity once, as its first chunk has it; no two of these names are near each other, so each new name is an entity."""
    rows = outcomes.chunk_entities(ingest.chunk_entities(*analysed(spark, sf_dir)))
    return rows.select(F.lower("name").alias("name"), "kind", F.when(F.col("kind") != "NEW", F.col("id")).alias("id"), "chunk_id")


@query("a05_entity_counts", sql("SELECT count(DISTINCT name) FILTER (kind = 'NEW') AS new, count(DISTINCT name) FILTER (kind = 'UPDATED') AS updated, count(DISTINCT name) FILTER (kind = 'REFERENCE') AS reference, count(DISTINCT name) AS total FROM found", **_CHUNKS))
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.entity_counts(outcomes.chunk_entities(ingest.chunk_entities(*analysed(spark, sf_dir))))


@query("e16_entity_edges", sql("SELECT source, count(*) AS n FROM (SELECT DISTINCT chunk_id AS source, name FROM found WHERE kind <> 'REFERENCE') GROUP BY source", **_CHUNKS))
def e16b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.entity_edges(ingest.chunk_entities(*analysed(spark, sf_dir))).groupBy("source").agg(F.count("*").alias("n"))


@query("x06_x07_lineage_records", sql("SELECT id AS proposition_id, CASE WHEN outcome <> 'PROJECTED' THEN outcome WHEN user_id % 10 = 9 THEN 'FAILED' WHEN user_id % 3 = 2 THEN 'PROJECTED' ELSE 'ADOPTED' END AS lifecycle, CASE WHEN outcome <> 'PROJECTED' OR user_id % 10 = 9 THEN NULL ELSE source_id || '-[' || CASE WHEN user_id % 3 = 1 THEN 'LIKES' ELSE type END || ']->' || target_id END AS target_ref, CASE WHEN outcome <> 'PROJECTED' THEN reason WHEN user_id % 10 = 9 THEN 'not persisted: full' WHEN user_id % 3 = 0 THEN 'adopted' WHEN user_id % 3 = 1 THEN 'aligned' END AS reason FROM projected", "props", "tiers", projected=_PROJECTED))
def x07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three people one has the edge, one another edge to the same thing, one none; a tenth of the edges can't be written."""
    rows = project.project_edges(propositions(spark, sf_dir), relations(spark))
    edges = project.merged_edges(rows).withColumn("u", F.substring_index("source_id", "-", -1).cast("int"))
    there = edges.where("u % 3 < 2").withColumn("type", F.when(F.col("u") % 3 == 0, F.col("type")).otherwise("LIKES"))
    lost = edges.where("u % 10 = 9").select(project.edge_ref(F.col("source_id"), F.col("type"), F.col("target_id")).alias("target_ref"), F.lit("full").alias("reason"))
    return project.lineage_records(rows, there, "run-1", failed=lost).select("proposition_id", "lifecycle", "target_ref", "reason")


@query("x08_described_edges", sql("SELECT source_id, target_id, type, string_agg(DISTINCT text, '; ' ORDER BY text) AS description, round(avg(p.confidence), 6) AS confidence, ['PRIMARY', 'SECONDARY', 'DERIVED', 'UNKNOWN'][min(p.tier) + 1] AS authority FROM projected p JOIN props q ON q.id = p.id WHERE outcome = 'PROJECTED' GROUP BY ALL", "props", "tiers", projected=_PROJECTED))
def x08(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = store.with_authority(propositions(spark, sf_dir), provenance(spark, sf_dir))
    out = project.described_edges(project.merged_edges(project.project_edges(p, relations(spark))), p)
    return out.withColumn("confidence", F.round("confidence", 6))


@query("x15_batch_completed", sql("SELECT count(*) FILTER (outcome = 'PROJECTED') AS succeeded, count(*) FILTER (outcome = 'SKIPPED') AS skipped, count(*) FILTER (outcome = 'FAILED') AS failed, count(*) AS total FROM projected", "props", "tiers", projected=_PROJECTED))
def x15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.batch_completed(project.project_edges(propositions(spark, sf_dir), relations(spark)))


@query("p10_reason_summary", sql("SELECT (SELECT count(*) FROM projected WHERE outcome = 'PROJECTED') || ' projected; ' || string_agg(n || ' ' || reason, '; ' ORDER BY n DESC, reason) AS summary FROM (SELECT reason, count(*) AS n FROM projected WHERE outcome <> 'PROJECTED' GROUP BY reason)", "props", "tiers", projected=_PROJECTED))
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.reason_summary(project.project_edges(propositions(spark, sf_dir), relations(spark)))


@query("i15_extraction_windows", sql("SELECT conv_id, min(i) AS start, max(i) + 1 AS end FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((i - 9) / 8) AS BIGINT)), least(i // 8, greatest(0, CAST(ceil((n - 10) / 8) AS BIGINT))) + 1)) AS w FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n >= 6) GROUP BY conv_id, w"))
def i15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.windows(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("text"), **ingest.EXTRACTION).select("conv_id", "start", "end")


@query("i08_extraction", sql("SELECT doc_id AS source_id, CAST(0 AS BIGINT) AS place, CASE WHEN length(text) % 7 <> 3 THEN len(string_split(text, chr(10))) END AS n, CASE WHEN length(text) % 7 = 3 THEN 'ValueError: too odd' END AS error FROM documents"))
def i08(spark: SparkSession, sf_dir: str) -> DataFrame:
    def lines(text: str) -> list[str]:
        if len(text) % 7 == 3:
            raise ValueError("too odd")
        return text.split("\n")

    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.lit(0).alias("place"), "text")
    return ingest.extract_each(chunks, lines, "parallel").select("source_id", "place", F.size("statements").cast("bigint").alias("n"), "error").withColumn("n", F.when(F.col("error").isNull(), F.col("n")))


@query("j21_zipped", sql("SELECT doc_id AS source_id, CASE WHEN doc_id % 3 <> 0 THEN n_chars END AS result FROM documents"))
def j21(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.lit(0).alias("place"), "n_chars")
    return ingest.zipped(d.drop("n_chars"), d.where("source_id % 3 <> 0").withColumnRenamed("n_chars", "result")).select("source_id", "result")


@query("v10_composite_filter", sql("SELECT proposition_id, pos, length(span) >= 5 AND (type <> 'EventType' OR span <> 'click') AND length(span) <= 8 AS passes FROM mentions", "mentions"))
def v10(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.col("span")
    click = F.when((F.col("type") == "EventType") & (span == "click"), "a click")
    rules = (mention_rules.not_blank(span), mention_rules.length_between(span, 5, 8), click)
    return exploded_mentions(propositions(spark, sf_dir)).select("proposition_id", "pos", mention_rules.composite(*rules).alias("passes"))


@query("g18_ask_by_name", sql("SELECT arg1 AS \"T\" FROM facts WHERE predicate = 'knows' AND arg0 = 'c7'", "facts"))
def g18(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = entities(spark, sf_dir)
    name = names.where("id = 'c7'").first()["name"]
    return datalog.ask_by_name(datalog.Program(facts(spark, sf_dir)), f"knows('{name.upper()}', T)", names)[0]


@query("g18_predicates", sql("SELECT predicate, count(*) AS n FROM facts GROUP BY predicate", "facts"))
def g18b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datalog.predicates(facts(spark, sf_dir))


@query("p02_path_rows", sql("SELECT CAST(1 AS INT) AS hop, 'type-click' AS source, t AS target, p1 AS proposition_id FROM way UNION ALL SELECT 2, t, 'type-error', p2 FROM way", "edges", way="SELECT l.b AS t, l.p AS p1, r.p AS p2 FROM (SELECT a, b, min(p) AS p FROM edges GROUP BY a, b) l JOIN (SELECT a, b, min(p) AS p FROM edges GROUP BY a, b) r ON l.b = r.a AND l.a = 'type-click' AND r.b = 'type-error' ORDER BY l.p, r.p LIMIT 1"))
def p02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.path_rows(graph.path_between(graph.co_mentions(propositions(spark, sf_dir)), "type-click", "type-error"))


@query("p03_explained", sql("SELECT p.id, p.text, p.status, p.valid_from, (SELECT string_agg(key, ',' ORDER BY pos) FROM provenance WHERE proposition_id = 'ev-14') AS sources, p.chunk AS grounding, (SELECT string_agg(text, ';' ORDER BY event_id DESC) FROM props WHERE event_id IN (12, 13)) AS abstracts FROM props p WHERE p.id = 'ev-14'", "props", "provenance"))
def p03(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = graph.explained(propositions(spark, sf_dir), provenance(spark, sf_dir), "ev-14")
    return x.select("id", "text", "status", "temporal.valid_from", F.array_join("key", ",").alias("sources"), F.array_join("grounding", ",").alias("grounding"), F.array_join("abstracts", ";").alias("abstracts"))


@query("j16_paths_in_context", sql("SELECT id AS path_id FROM props p WHERE level = 1 AND (SELECT count(*) FROM props q WHERE q.event_id IN (p.event_id - 1, p.event_id - 2) AND q.context_id = 'ctx-3') = 2 UNION ALL SELECT id FROM props WHERE level = 0", "props"))
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of an abstraction as a path; a row without sources is an empty path."""
    p = propositions(spark, sf_dir)
    return graph.paths_in_context(p.select(F.col("id").alias("path_id"), F.col("source_ids").alias("via")), p, "ctx-3").select("path_id")


_HISTORY = "SELECT 'ctx-' || (o_custkey % 10) AS context_id, o_custkey AS source_id, o_orderkey % 100 AS end_index, o_orderdate AS processed_at, md5(CAST(o_orderkey AS VARCHAR)) AS content_hash FROM orders"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(_TEXT("ctx-", k % 10).alias("context_id"), k.alias("source_id"), (F.col("o_orderkey") % 100).alias("end_index"), F.col("o_orderdate").alias("processed_at"), F.md5(F.col("o_orderkey").cast("string")).alias("content_hash"))


@query("s26_w05_bookmarks", sql("SELECT context_id, source_id, max_by(end_index, (processed_at, end_index)) AS end_index FROM history GROUP BY ALL", history=_HISTORY))
def s26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.last_bookmarks(history(spark, sf_dir)).select("context_id", "source_id", "end_index")


@query("s26_is_processed", sql("SELECT l_orderkey AS k, l_linenumber AS line, EXISTS (SELECT 1 FROM history h WHERE h.content_hash = md5(CAST(l_orderkey * 2 AS VARCHAR)) AND h.context_id = 'ctx-' || (l_partkey % 10)) AS processed FROM lineitem", history=_HISTORY))
def s26b(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.md5((F.col("l_orderkey") * 2).cast("string")).alias("content_hash"), _TEXT("ctx-", F.col("l_partkey") % 10).alias("context_id"))
    return records.processed(chunks, history(spark, sf_dir)).select("k", "line", "processed")


@query("s26_cleared", sql("SELECT context_id, count(*) AS n FROM history WHERE context_id <> 'ctx-3' GROUP BY 1", history=_HISTORY))
def s26c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.clear(history(spark, sf_dir), context_id="ctx-3")[0].groupBy("context_id").agg(F.count("*").alias("n"))


@query("i14_event_stream", sql(f"SELECT id, CASE WHEN event_id % 4 = 3 OR event_id % 2 = 1 THEN 'PERSISTED' ELSE 'STATUS_CHANGED' END AS kind, {AT} AS at, CASE WHEN event_id % 2 = 0 THEN status || '->STALE' END AS detail FROM props WHERE event_id % 2 = 1 OR status <> 'STALE'", "props"))
def i14(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propositions(spark, sf_dir)
    new = p.withColumn("status", F.when(F.col("event_id") % 2 == 0, "STALE").otherwise("ACTIVE"))
    return records.event_stream(store.events(p.where("event_id % 4 <> 3"), new), F.to_timestamp(F.lit(AS_OF)))


@query("e15_assertions", sql("""SELECT o_orderkey AS k, CASE WHEN c.id IS NULL OR o_custkey % 11 = 0 THEN 'UNRESOLVED' WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'VETOED' ELSE 'PERSISTED' END AS outcome, CASE WHEN c.id IS NOT NULL AND o_custkey % 11 <> 0 AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN c.id || '-[' || o_orderpriority || ']->' || c.id END AS edge
FROM orders LEFT JOIN (SELECT name, min(id) AS id FROM entities GROUP BY name) c ON c.name = (SELECT name FROM entities e WHERE e.id = 'c' || o_custkey)""", "entities"))
def e15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's name in capitals asserted to be related to itself; every eleventh one is misspelt."""
    e = entities(spark, sf_dir)
    o = table(spark, sf_dir, "orders").join(e.select("id", "name"), F.col("id") == _TEXT("c", F.col("o_custkey")))
    asked = o.select(F.col("o_orderkey").alias("k"), F.concat(F.lit(" "), F.upper("name")).alias("from"), F.col("o_orderpriority").alias("type"), F.when(F.col("o_custkey") % 11 == 0, "who").otherwise(F.col("name")).alias("to"))
    permitted = table(spark, sf_dir, "orders").where("o_orderpriority < '3'").select(F.col("o_orderpriority").alias("type"))
    return resolve.assert_relationships(asked, e, permitted)


@query("m13_text_distance", sql("SELECT id, round((1 - d / greatest(length(name), 20)::DOUBLE) * 0.7, 6) AS score FROM (SELECT id, name, levenshtein(lower(name), (SELECT lower(name) FROM entities WHERE id = 'c7')) AS d FROM entities) WHERE d <= 3", "entities"))
def m13(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir)
    return resolve.by_text_distance(e, e.where("id = 'c7'").first()["name"]).withColumn("score", F.round("score", 6))
