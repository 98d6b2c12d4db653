"""M*, T*, V* and P* queries: column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import AS_OF, artifacts, entities, exploded_mentions, propositions, provenance, vectors
from ..functions import mention_rules as rules
from ..functions import scoring, text
from ..operators.vectors import clusters, similar_pairs, top_k
from ..schema import TIERS
from ..session import table
from .registry import query
from .sql import AT, sql


@query("m01_effective_confidence", sql("SELECT id, round(eff, 6) AS effective FROM props", "props"))
def m01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propositions(spark, sf_dir).select("id", F.round(scoring.effective_confidence(AS_OF), 6).alias("effective"))


@query("m03_cosine_pairs", sql("SELECT a.id AS id_a, b.id AS id_b, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS score FROM vectors a JOIN vectors b ON a.context_id = b.context_id AND a.id < b.id WHERE list_cosine_similarity(a.embedding, b.embedding) >= 0.3000007", "vectors"))
def m03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(vectors(spark, sf_dir), 0.3000007).select("id_a", "id_b", F.round("score", 6).alias("score"))


@query("m04_recall_relevance", sql(f"SELECT id, round(0.4 * (len(list_intersect(['user', 'click', 'now'], list_distinct(string_split_regex(lower(text), '\\s+')))) / 3.0::DOUBLE) + 0.3 * exp(-greatest((epoch_us({AT}) - epoch_us(content_revised)) / 1000000.0::DOUBLE, 0) / 86400.0::DOUBLE) + 0.3 * confidence, 6) AS relevance FROM props", "props"))
def m04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propositions(spark, sf_dir).select("id", F.round(scoring.recall_relevance(["user", "click", "now"], AS_OF), 6).alias("relevance"))


@query(
    "m06_m09_merge_arithmetic",
    sql("SELECT id, round(least(0.99, confidence + confidence * 0.3), 6) AS merged, round(decay * 0.7, 6) AS merged_decay, round(least(0.95, confidence + confidence * 0.1), 6) AS reinforced, round(decay * 0.85, 6) AS reinforced_decay, round(CASE WHEN pinned THEN confidence ELSE greatest(0.05, confidence * 0.3) END, 6) AS contradicted, round(CASE WHEN pinned THEN decay ELSE least(1.0, decay + 0.15) END, 6) AS contradicted_decay, round(least(1.0, confidence + 0.1), 6) AS consolidated FROM props", "props"),
)
def m06(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.revise import contradicted, merged, reinforced

    c, d = F.col("confidence"), F.col("decay")
    m, r, x = merged(c, d, c), reinforced(c, d, c), contradicted(c, d, F.col("pinned"))
    six = lambda v, n: F.round(v, 6).alias(n)
    return propositions(spark, sf_dir).select("id", six(m[0], "merged"), six(m[1], "merged_decay"), six(r[0], "reinforced"), six(r[1], "reinforced_decay"), six(x[0], "contradicted"), six(x[1], "contradicted_decay"), six(F.least(F.lit(1.0), c + 0.1), "consolidated"))


@query("m10_m12_trust_by_authority", sql("SELECT proposition_id AS id, ['PRIMARY', 'SECONDARY', 'DERIVED', 'UNKNOWN'][tier + 1] AS authority, [0.9, 0.75, 0.6, 0.5][tier + 1]::DOUBLE AS trust, 1.0::DOUBLE AS neutral FROM tiers", "tiers"))
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.store import with_authority

    rows = with_authority(propositions(spark, sf_dir), provenance(spark, sf_dir))
    return rows.select("id", "authority", scoring.trust_of_tier(F.col("authority")).alias("trust"), F.lit(1.0).alias("neutral"))


@query("m14_fuzzy_names", "WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT a.name AS name_a, b.name AS name_b FROM n a JOIN n b ON a.name < b.name AND least(length(a.name), length(b.name)) >= 4 AND levenshtein(lower(a.name), lower(b.name)) <= floor(0.2 * least(length(a.name), length(b.name)))")
def m14(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select("p_name").distinct()
    return n.toDF("name_a").join(n.toDF("name_b"), (F.col("name_a") < F.col("name_b")) & text.is_fuzzy_name(F.col("name_a"), F.col("name_b")))


@query("m15_name_scores", sql(r"SELECT id, name, (CASE WHEN name LIKE '% %' THEN 1000 ELSE 0 END + CASE WHEN regexp_matches(name, '\p{Lu}') THEN 500 ELSE 0 END + CASE WHEN regexp_matches(name, '^\p{Lu}') THEN 100 ELSE 0 END - CASE WHEN name = upper(name) AND regexp_matches(name, '\p{L}') THEN 200 ELSE 0 END - CASE WHEN name LIKE '%@%' THEN 2000 ELSE 0 END - CASE WHEN regexp_matches(name, '\p{Nd}') THEN 50 ELSE 0 END + length(name))::INT AS score FROM (SELECT id, CASE WHEN id LIKE '%7' THEN upper(name) WHEN id LIKE '%5' THEN 'a@b' ELSE name END AS name FROM entities)", "entities"))
def m15(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("id").endswith("7"), F.upper("name")).when(F.col("id").endswith("5"), "a@b").otherwise(F.col("name"))
    return entities(spark, sf_dir).select("id", name.alias("name")).select("id", "name", text.name_score(F.col("name")).alias("score"))


@query("t01_canonical_text", sql(r"SELECT source_id, length(c) AS chars, md5(c) AS hash FROM (SELECT source_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS c FROM artifacts)", "artifacts"))
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text.canonical(F.col("text"))
    return artifacts(spark, sf_dir).select("source_id", c.alias("c")).select("source_id", F.length("c").alias("chars"), F.md5("c").alias("hash"))


NAMES = ("Dr. Watson", "John Smith Jr.", "Lynda M Coker", "Lynda M. Coker", "Coker, Lynda M.", "Coker, Lynda", "A. Lincoln", "  Prof Ada   Lovelace ", "Mr. Brown III", "plain", "Ann B. Cole D. Eve")
_VALUES = ", ".join(f"('{n}')" for n in NAMES)
_NORMAL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN regexp_matches(trim(n), '^[^,]+,\s*[^,].*$') THEN trim(regexp_replace(trim(n), '^([^,]+),\s*([^,].*)$', '\2 \1')) ELSE trim(n) END, '(?i)^(mrs|mr|ms|dr|prof)\.?\s+', ''), '(?i)\s+(jr\.?|sr\.?|iii|ii|iv)$', ''), '(\w\w)\s+[A-Z]\.?\s+(\w\w)', '\1 \2', 'g'), '\s+', ' ', 'g'))"""


@query("t02_person_names", f"SELECT o_orderkey % 1000 AS k, count(*) AS n, {_NORMAL} AS name FROM orders, (SELECT row_number() OVER () - 1 AS i, n FROM (VALUES {_VALUES}) v(n)) WHERE o_orderkey % {len(NAMES)} = i GROUP BY ALL")
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in NAMES])
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1000).alias("k"), F.element_at(names, (F.col("o_orderkey") % len(NAMES)).cast("int") + 1).alias("n"))
    return o.select("k", text.person_name(F.col("n")).alias("name")).groupBy("k", "name").agg(F.count("*").alias("n"))


@query("t03_comparison_names", sql(r"SELECT name, count(*) AS n FROM (SELECT trim(regexp_replace(regexp_replace(lower(name), '^(mrs|mr|ms|dr|prof)\.?\s+', ''), '\s+', ' ', 'g')) AS name FROM entities) GROUP BY name", "entities"))
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).select(text.comparison_name(F.col("name")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("t04_partial_names", "WITH n AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(lower(name), ' ')) AS word FROM n)) SELECT word, name FROM w JOIN n ON length(word) >= 4 AND list_contains(string_split(lower(name), ' '), word) AND name LIKE '% %'")
def t04(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    w = n.select(F.explode(F.split(F.lower("name"), " ")).alias("word")).distinct()
    keyed = n.select("name", F.explode(F.array_distinct(F.split(F.lower("name"), " "))).alias("word"))
    return w.join(keyed, "word").where(text.is_partial_name(F.col("word"), F.col("name"))).select("word", "name")


@query("t05_keyword_hits", sql(r"SELECT source_id, len(list_filter(['lic', 'den', 'que', 'the'], lambda w: contains(lower(text), w))) AS hits, len(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 3))) AS n_keywords FROM artifacts", "artifacts"))
def t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("lic", "den", "que", "the")])
    return artifacts(spark, sf_dir).select("source_id", text.keyword_hits(words, F.col("text")).cast("bigint").alias("hits"), F.size(text.keywords(F.col("text"))).cast("bigint").alias("n_keywords"))


@query("t07_t10_predicates", r"SELECT p_partkey AS id, regexp_replace(upper(trim(p_name)), '\s+', '_', 'g') AS kind, CASE WHEN contains(p_type, '_') THEN replace(lower(p_type), '_', ' ') ELSE 'has ' || lower(regexp_replace(p_type, '([a-z])([A-Z])', '\1 \2', 'g')) END AS predicate, '''' || regexp_replace(lower(p_brand), '[^a-z0-9_]', '_', 'g') || '''' AS atom, lower(regexp_replace(regexp_replace(p_name, ' ', '', 'g'), '([a-z])([A-Z])', '\1_\2', 'g')) AS fact FROM part")
def t07(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), text.relationship_type(F.col("p_name")).alias("kind"), text.predicate_of(F.col("p_type")).alias("predicate"), text.atom(F.col("p_brand")).alias("atom"), text.fact_predicate(F.replace("p_name", F.lit(" "), F.lit(""))).alias("fact"))


@query("t11_content_hash", sql("SELECT source_id, content_hash FROM artifacts", "artifacts"))
def t11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts(spark, sf_dir).select("source_id", "content_hash")


@query("t14_preview", sql("SELECT source_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview FROM artifacts", "artifacts"))
def t14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts(spark, sf_dir).select("source_id", text.preview(F.col("text")).alias("preview"))


@query("t15_simple_labels", "SELECT DISTINCT p_brand, split_part('x.y.' || p_brand, '.', -1) AS label FROM part")
def t15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand", text.simple_label(F.concat(F.lit("x.y."), F.col("p_brand"))).alias("label")).distinct()


@query("t16_age", r"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS INT) END AS age FROM events")
def t16(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id").cast("string")
    phrase = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("is "), u, F.lit(" years old"))).when(F.col("event_id") % 2 == 0, F.concat(F.lit("Age "), u)).otherwise(F.concat(u, F.lit(" dogs")))
    return table(spark, sf_dir, "events").select("event_id", text.age_in(phrase).alias("age"))


@query(
    "v01_v07_mention_rules",
    sql(
        r"""SELECT proposition_id, pos, CASE WHEN trim(s) = '' THEN 'blank' WHEN regexp_matches(lower(trim(s)), '^(this|that|these|those|the|an|a)( |$)') THEN 'vague reference' WHEN length(s) < 6 THEN 'shorter than 6' WHEN length(s) > 9 THEN 'longer than 9' END AS reason,
        CASE WHEN NOT regexp_full_match(s, '[a-z]+ [0-9]+') AND len(list_filter(string_split_regex(trim(s), '\s+'), lambda w: w <> '')) < 3 THEN 'pattern; fewer words than 3' END AS any_reason,
        CASE WHEN regexp_matches(lower(trim(s)), '^(click|user)s?$') THEN 'names a type' END AS type_word
        FROM (SELECT proposition_id, pos, CASE WHEN pos = 0 AND proposition_id LIKE '%3' THEN 'the ' || span WHEN pos = 1 AND proposition_id LIKE '%4' THEN '  ' ELSE span END AS s FROM mentions)""",
        "mentions",
    ),
)
def v01(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("proposition_id")
    s = F.when((F.col("pos") == 0) & p.endswith("3"), F.concat(F.lit("the "), F.col("span"))).when((F.col("pos") == 1) & p.endswith("4"), "  ").otherwise(F.col("span"))
    m = exploded_mentions(propositions(spark, sf_dir)).select("proposition_id", "pos", s.alias("s"))
    s = F.col("s")
    return m.select("proposition_id", "pos", rules.all_of(rules.not_blank(s), rules.not_vague(s), rules.length_between(s, 6, 9)).alias("reason"), rules.any_of(rules.matches(s, "[a-z]+ [0-9]+"), rules.least_words(s, 3)).alias("any_reason"), rules.not_type_word(s, ("click", "user")).alias("type_word"))


@query("v08_v11_schema_filter_counts", sql("SELECT type, outcome, count(*) AS n FROM (SELECT type, CASE WHEN type = 'Person' AND (length(span) > 7 OR span = 'user 5') THEN 'rejected' ELSE 'accepted' END AS outcome FROM mentions) GROUP BY ALL", "mentions"))
def v08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons of at most seven letters and not the fifth; other types have no rules."""
    schema = {"PERSON": (lambda s: rules.length_between(s, 0, 7), lambda s: F.when(s == "user 5", "the fifth"))}
    return rules.counts(exploded_mentions(propositions(spark, sf_dir)), rules.by_schema(F.col("type"), F.col("span"), schema))


@query("v09_whole_text_mentions", sql("SELECT source_id, length(text) >= 50 AS rejected FROM artifacts", "artifacts"))
def v09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts(spark, sf_dir).select("source_id", rules.whole_text(F.concat(F.lit(" "), F.col("text")), F.col("text")).isNotNull().alias("rejected"))


@query("p01_summaries", sql("SELECT id, text, round(confidence, 6) AS confidence, status, n, subject FROM props JOIN (SELECT proposition_id, count(*) AS n, max(CASE WHEN role = 'SUBJECT' THEN resolved_id END) AS subject FROM mentions GROUP BY 1) ON id = proposition_id", "props", "mentions"))
def p01(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = F.element_at(F.filter("mentions", lambda m: m["role"] == "SUBJECT"), 1)["resolved_id"]
    return propositions(spark, sf_dir).select("id", "text", F.round("confidence", 6).alias("confidence"), "status", F.size("mentions").cast("bigint").alias("n"), subject.alias("subject"))


@query("p05_staged_rows", sql("SELECT id, least(1.0, greatest(0.0, round(confidence * 3 - 1, 6))) AS confidence, CASE WHEN trim(reasoning) <> '' THEN reasoning END AS reasoning FROM props", "props"))
def p05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propositions(spark, sf_dir).select("id", scoring.capped(F.round(F.col("confidence") * 3 - 1, 6), 0.0, 1.0).alias("confidence"), text.blank_to_null(F.col("reasoning")).alias("reasoning"))


@query("p07_decay_applied", sql("SELECT id, round(least(1.0, greatest(0.0, eff)), 6) AS confidence FROM props", "props"))
def p07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propositions(spark, sf_dir).select("id", F.round(scoring.capped(scoring.effective_confidence(AS_OF), 0.0, 1.0), 6).alias("confidence"))


@query("a15_best_authority", sql("SELECT resolved_id AS entity, min(tier) AS tier FROM mentions JOIN tiers USING (proposition_id) WHERE resolved_id IS NOT NULL GROUP BY 1", "mentions", "tiers"))
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.store import with_authority

    p = with_authority(propositions(spark, sf_dir), provenance(spark, sf_dir))
    order = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("authority")).cast("int") - 1
    return p.select(order.alias("tier"), F.explode("mentions").alias("m")).select("tier", F.col("m.resolved_id").alias("entity")).where("entity IS NOT NULL").groupBy("entity").agg(F.min("tier").alias("tier"))


QUERY_SQL = "(SELECT embedding FROM vectors WHERE id = 'vec-7')"


def _vector(spark: SparkSession, sf_dir: str, name: str) -> list[float]:
    return vectors(spark, sf_dir).where(F.col("id") == name).first()["embedding"]


@query("o05_top_k", sql(f"SELECT id, round(list_cosine_similarity(embedding, {QUERY_SQL}), 6) AS score FROM vectors WHERE list_cosine_similarity(embedding, {QUERY_SQL}) >= 0.1000007 ORDER BY list_cosine_similarity(embedding, {QUERY_SQL}) DESC, id LIMIT 20", "vectors"))
def o05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(vectors(spark, sf_dir), _vector(spark, sf_dir, "vec-7"), 20, 0.1000007).select("id", F.round("score", 6).alias("score"))


@query("o06_filtered_top_k", sql(f"SELECT id, round(list_cosine_similarity(embedding, {QUERY_SQL}), 6) AS score FROM vectors WHERE context_id = 'lab-3' AND list_cosine_similarity(embedding, {QUERY_SQL}) >= 0.0000007 ORDER BY list_cosine_similarity(embedding, {QUERY_SQL}) DESC, id LIMIT 10", "vectors"))
def o06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(vectors(spark, sf_dir), _vector(spark, sf_dir, "vec-7"), 10, 0.0000007, F.col("context_id") == "lab-3").select("id", F.round("score", 6).alias("score"))


@query("j02_post_filtered_top_k", sql(f"SELECT id FROM (SELECT * FROM vectors ORDER BY list_cosine_similarity(embedding, {QUERY_SQL}) DESC, id LIMIT 50) WHERE context_id = 'lab-3'", "vectors"))
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return top_k(v, _vector(spark, sf_dir, "vec-7"), 50, -1.0).join(v.where("context_id = 'lab-3'").select("id"), "id", "left_semi").select("id")


_PAIRS = "SELECT a.id AS id_a, b.id AS id_b, list_cosine_similarity(a.embedding, b.embedding) AS score FROM vectors a JOIN vectors b ON a.context_id = b.context_id AND a.id < b.id"


@query("j03_o07_clusters", sql("SELECT id_a AS anchor_id, count(*) AS size, string_agg(id_b, ',' ORDER BY rank) AS members FROM (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY score DESC, id_b) AS rank FROM pairs WHERE score >= 0.2000007) WHERE rank <= 5 GROUP BY id_a", "vectors", pairs=_PAIRS))
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clusters(vectors(spark, sf_dir), 0.2000007, 5)
    return c.select("anchor_id", F.col("size").cast("bigint").alias("size"), F.array_join("similar.id", ",").alias("members")).orderBy(F.desc("size"), "anchor_id")


@query("w01_ranked_similar", sql("SELECT id_a, id_b, rank FROM (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY score DESC, id_b) AS rank FROM pairs WHERE score >= 0.1500007) WHERE rank <= 3", "vectors", pairs=_PAIRS))
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("id_a").orderBy(F.desc("score"), "id_b")
    return similar_pairs(vectors(spark, sf_dir), 0.1500007, k=3).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("id_a", "id_b", "rank")
