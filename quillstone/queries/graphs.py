"""G*, J* graph queries and X* projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import facts, propositions, provenance, vectors
from ..operators import graph, project
from ..operators.datalog import RULES, Program, parse
from ..operators.store import with_authority
from ..operators.vectors import similar_pairs
from .registry import query
from .sql import sql


@query("j04_co_mentions", sql("SELECT a, b, count(*) AS n FROM edges GROUP BY a, b", "edges"))
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.co_mentions(propositions(spark, sf_dir)).groupBy("a", "b").agg(F.count("*").alias("n"))


def _bfs(edges: str, start: str, depth: int) -> dict[str, str]:
    return {
        "reach": f"SELECT '{start}' AS node, 0 AS d UNION SELECT e.b, reach.d + 1 FROM reach JOIN (SELECT DISTINCT a, b FROM {edges}) e ON e.a = reach.node WHERE reach.d < {depth} AND e.b <> '{start}'",
        "dist": "SELECT node, min(d) AS d FROM reach GROUP BY node",
    }


@query("g01_neighborhood", sql("SELECT x.node AS entity, x.d AS distance, count(DISTINCT e.p) AS n_via, min(e.p) AS first_via FROM dist x JOIN edges e ON e.b = x.node JOIN dist y ON y.node = e.a AND y.d = x.d - 1 WHERE x.d > 0 GROUP BY ALL", "edges", recursive=True, **_bfs("edges", "user-7", 2)))
def g01(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph.neighborhood(graph.co_mentions(propositions(spark, sf_dir)), "user-7", 2)
    return n.select("entity", "distance", F.size("via").cast("bigint").alias("n_via"), F.array_min("via").alias("first_via"))


@query("g04_authority_floor", sql("SELECT x.node AS entity, x.d AS distance, count(DISTINCT e.p) AS n_via FROM dist x JOIN floor_edges e ON e.b = x.node JOIN dist y ON y.node = e.a AND y.d = x.d - 1 WHERE x.d > 0 GROUP BY ALL", "edges", "tiers", recursive=True, floor_edges="SELECT a, b, p FROM edges JOIN tiers ON p = proposition_id WHERE tier <= 0", **_bfs("floor_edges", "user-9", 3)))
def g04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_authority(propositions(spark, sf_dir), provenance(spark, sf_dir))
    n = graph.neighborhood(graph.co_mentions(rows, "PRIMARY"), "user-9", 3)
    return n.select("entity", "distance", F.size("via").cast("bigint").alias("n_via"))


@query(
    "g02_path_between",
    sql(
        "SELECT array_to_string(nodes, ',') AS nodes, array_to_string(via, ',') AS via FROM walk WHERE node = 'user-24' ORDER BY via LIMIT 1",
        "edges",
        recursive=True,
        linked="SELECT a, b, min(p) AS p FROM edges GROUP BY a, b",
        **_bfs("linked", "user-3", 5),
        walk="SELECT 'user-3' AS node, ['user-3'] AS nodes, []::VARCHAR[] AS via UNION ALL SELECT e.b, list_append(walk.nodes, e.b), list_append(walk.via, e.p) FROM walk JOIN linked e ON e.a = walk.node JOIN dist x ON x.node = walk.node JOIN dist y ON y.node = e.b AND y.d = x.d + 1",
    ),
)
def g02(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = graph.path_between(graph.co_mentions(propositions(spark, sf_dir)), "user-3", "user-24")
    return p.select(F.array_join("nodes", ",").alias("nodes"), F.array_join("via", ",").alias("via"))


@query("g03_why_explain", sql("SELECT id, 0 AS place, text AS source FROM props WHERE id = 'ev-14' UNION ALL SELECT id, CAST(14 - event_id AS INT), text FROM props WHERE event_id IN (13, 12)", "props"))
def g03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.lineage(propositions(spark, sf_dir), "ev-14")


@query("j06_abstraction_sources", sql("SELECT p.id, s.id AS source_id, s.text FROM props p JOIN props s ON s.event_id IN (p.event_id - 1, p.event_id - 2) WHERE p.level = 1", "props"))
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propositions(spark, sf_dir)
    links = p.select("id", F.explode("source_ids").alias("source_id"))
    return links.join(p.select(F.col("id").alias("source_id"), "text"), "source_id").select("id", "source_id", "text")


@query("j07_abstractions_of", sql("SELECT id FROM props WHERE level = 1 AND event_id IN (13 + 1, 13 + 2)", "props"))
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propositions(spark, sf_dir).where(F.array_contains("source_ids", "ev-13")).select("id")


@query(
    "g06_two_hop_links",
    sql(
        "SELECT source, target, string_agg(x, ',' ORDER BY x) AS connectors, len(list_distinct(flatten(list(ps)))) AS n_evidence FROM (SELECT l.a AS source, r.a AS target, l.b AS x, list_concat(l.ps, r.ps) AS ps FROM pair l JOIN pair r ON l.b = r.b AND l.a < r.a ANTI JOIN pair d ON d.a = l.a AND d.b = r.a) GROUP BY ALL",
        "edges",
        pair="SELECT a, b, list(DISTINCT p) AS ps FROM edges GROUP BY a, b",
    ).replace("ANTI JOIN pair d ON d.a = l.a AND d.b = r.a", "WHERE NOT EXISTS (SELECT 1 FROM pair d WHERE d.a = l.a AND d.b = r.a)"),
)
def g06(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = graph.two_hop_links(graph.co_mentions(propositions(spark, sf_dir)))
    return links.select("source", "target", F.array_join("connectors", ",").alias("connectors"), F.size("evidence").cast("bigint").alias("n_evidence")).orderBy("source", "target", "connectors")


@query("u08_shared_neighbours", sql("SELECT DISTINCT x.b AS shared FROM edges x JOIN edges y ON x.b = y.b WHERE x.a = 'user-3' AND y.a = 'user-4'", "edges"))
def u08(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph.co_mentions(propositions(spark, sf_dir))
    return e.where("a = 'user-3'").select("b").intersect(e.where("a = 'user-4'").select("b")).select(F.col("b").alias("shared"))


@query("g07_components", sql("SELECT node, min(least(node, other)) AS root FROM reach GROUP BY node", "vectors", recursive=True, near="SELECT a.id AS x, b.id AS y FROM vectors a JOIN vectors b ON a.context_id = b.context_id AND a.id <> b.id AND list_cosine_similarity(a.embedding, b.embedding) >= 0.3300007", reach="SELECT x AS node, y AS other FROM near UNION SELECT reach.node, near.y FROM reach JOIN near ON near.x = reach.other"))
def g07(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similar_pairs(vectors(spark, sf_dir), 0.3300007)
    return graph.components(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))


def _fact(name: str, a: str = "x", b: str = "y") -> str:
    return f"SELECT arg0 AS {a}, arg1 AS {b} FROM facts WHERE predicate = '{name}'"


def _rule(name: str, goal: str, body: str, recursive: bool = False, **ctes: str) -> None:
    @query(name, sql(body, "facts", recursive=recursive, **ctes))
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Program(facts(spark, sf_dir)).ask(goal)


_CHAIN = "SELECT x, y FROM e UNION SELECT chain.x, e.y FROM chain JOIN e ON chain.y = e.x"
_SHARED = 'SELECT DISTINCT l.x AS "P", r.x AS "Q" FROM e l JOIN e r ON l.y = r.y AND l.x <> r.x'
_rule("g10_reports_to_chain", "reports_to_chain(A, B)", 'SELECT x AS "A", y AS "B" FROM chain', True, e=_fact("reports_to"), chain=_CHAIN)
_rule("g10_manages_chain", "manages_chain(s1, B)", "SELECT y AS \"B\" FROM chain WHERE x = 's1'", True, e=_fact("manages"), chain=_CHAIN)
_rule("g11_coworker", "coworker(P, Q)", _SHARED, e=_fact("works_at"))
_rule("g11_teammate", "teammate(P, Q)", _SHARED, e=_fact("member_of"))
_rule("g11_same_location", "same_location(P, Q)", _SHARED, e=_fact("lives_in"))
_rule("g12_can_help_with", "can_help_with(P, Subject)", f'SELECT x AS "P", y AS "Subject" FROM ({_fact("expert_in")} UNION {_fact("knows")})')
_rule(
    "g13_can_consult",
    "can_consult(P, Q, Subject)",
    f'SELECT DISTINCT l.x AS "P", l.y AS "Q", k.y AS "Subject" FROM ({_fact("friend_of")} UNION {_fact("colleague_of")} UNION SELECT l.x, r.x FROM e l JOIN e r ON l.y = r.y AND l.x <> r.x) l JOIN ({_fact("expert_in")}) k ON k.x = l.y',
    e=_fact("works_at"),
)
_rule("g14_owner_of_type", "owner_of_type(P, Kind)", f'SELECT DISTINCT o.x AS "P", t.y AS "Kind" FROM ({_fact("owns")}) o JOIN ({_fact("type_of")}) t ON o.y = t.x')
_rule("g14_friend_of_friend", "friend_of_friend(P, R)", 'SELECT DISTINCT l.x AS "P", r.y AS "R" FROM e l JOIN e r ON l.y = r.x AND l.x <> r.y', e=_fact("friend_of"))
_rule("g14_work_connection", "work_connection(P, Q)", f'SELECT x AS "P", y AS "Q" FROM ({_fact("colleague_of")} UNION SELECT l.x, r.x FROM e l JOIN e r ON l.y = r.y AND l.x <> r.x)', e=_fact("works_at"))
_rule("g08_ground_query", "coworker(c11, c12)", "SELECT count(*) > 0 AS holds FROM e l JOIN e r ON l.y = r.y WHERE l.x = 'c11' AND r.x = 'c12'", e=_fact("works_at"))
_rule("g09_bindings", "friend_of(X, c5)", "SELECT x AS \"X\" FROM e WHERE y = 'c5'", e=_fact("friend_of"))


@query("g17_user_rules", sql('SELECT DISTINCT a.x AS "A", b.y AS "T" FROM f a JOIN k b ON a.y = b.x UNION SELECT DISTINCT f.x, \'none\' FROM f WHERE f.y = \'c1\'', "facts", f=_fact("friend_of"), k=_fact("knows")))
def g17(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "friend_topic(A, T) :- friend_of(A, B), knows(B, T). friend_topic(A, none) :- friend_of(A, c1)."
    return Program(facts(spark, sf_dir), RULES + own).ask("friend_topic(A, T)")


def relations(spark: SparkSession) -> DataFrame:
    from ..schema import RELATIONS

    rows = [
        (0, "purchase", "PROCEDURAL", "Person", "EventType", 0.5, "SECONDARY", "WORKING"),
        (1, "Sign", "SEMANTIC", "person", None, 0.2, None, None),
        (2, "click", "EPISODIC", "Robot", None, None, "PRIMARY", None),
        (3, "view", "WORKING", None, "EventType", None, None, None),
    ]
    return spark.createDataFrame(rows, RELATIONS)


_PROJECTED = """SELECT p.id, p.context_id, p.confidence, p.decay, p.event_id, p.user_id, p.event_type, t.tier, CASE WHEN contains(text, 'purchase') THEN 0 WHEN contains(text, 'sign') THEN 1 WHEN contains(text, 'click') THEN 2 WHEN contains(text, 'view') THEN 3 END AS rel,
  CASE WHEN p.confidence < 0.7 OR p.event_id % 13 = 0 THEN 'SKIPPED' WHEN event_type NOT IN ('purchase', 'signup', 'click', 'view') OR event_type = 'click' THEN 'FAILED' ELSE 'PROJECTED' END AS outcome,
  CASE WHEN p.confidence < 0.7 THEN 'confidence below 0.7' WHEN p.event_id % 13 = 0 THEN 'subject or object not resolved' WHEN event_type NOT IN ('purchase', 'signup', 'click', 'view') THEN 'no matching predicate' WHEN event_type = 'click' THEN 'subject type' END AS reason,
  'user-' || user_id AS source_id, 'type-' || event_type AS target_id, CASE event_type WHEN 'purchase' THEN 'PURCHASE' WHEN 'signup' THEN 'SIGN' WHEN 'view' THEN 'VIEW' END AS type
  FROM props p JOIN tiers t ON t.proposition_id = p.id"""


@query("x01_x03_project_edges", sql("SELECT id, outcome, reason, CASE WHEN outcome = 'PROJECTED' THEN source_id END AS source_id, CASE WHEN outcome = 'PROJECTED' THEN target_id END AS target_id, CASE WHEN outcome = 'PROJECTED' THEN type END AS type FROM projected", "props", "tiers", projected=_PROJECTED))
def x02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.project_edges(propositions(spark, sf_dir), relations(spark)).select("id", "outcome", "reason", "source_id", "target_id", "type")


@query("x01_policies", sql("SELECT id, CASE WHEN confidence < 0.85 THEN 'confidence below 0.85' WHEN event_id % 13 = 0 THEN 'a mention is not resolved' END AS strict, CASE WHEN confidence < 0.7 THEN 'confidence below 0.7' WHEN event_id % 13 = 0 THEN 'subject or object not resolved' END AS lenient, NULL::VARCHAR AS always FROM props", "props"))
def x01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propositions(spark, sf_dir).select("id", *[project.policy_reason(k).alias(k) for k in ("strict", "lenient", "always")])


@query("x05_merged_edges", sql("SELECT source_id, target_id, type, round(max(confidence), 6) AS confidence, count(*) AS n FROM projected WHERE outcome = 'PROJECTED' GROUP BY ALL", "props", "tiers", projected=_PROJECTED))
def x05(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = project.merged_edges(project.project_edges(propositions(spark, sf_dir), relations(spark)))
    return e.select("source_id", "target_id", "type", F.round("confidence", 6).alias("confidence"), F.size("source_ids").cast("bigint").alias("n"))


@query("x10_knowledge_types", sql("SELECT id, CASE WHEN decay > 0.5 THEN 'EPISODIC' WHEN confidence > 0.7 AND decay < 0.3 THEN 'SEMANTIC' ELSE 'WORKING' END AS kind, coalesce(CASE WHEN contains(text, 'purchase') THEN 'PROCEDURAL' WHEN contains(text, 'sign') THEN 'SEMANTIC' WHEN contains(text, 'click') THEN 'EPISODIC' WHEN contains(text, 'view') THEN 'WORKING' END, CASE WHEN decay > 0.5 THEN 'EPISODIC' WHEN confidence > 0.7 AND decay < 0.3 THEN 'SEMANTIC' ELSE 'WORKING' END) AS by_relation FROM props", "props"))
def x10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = project.with_relation(propositions(spark, sf_dir), relations(spark))
    return rows.select("id", project.knowledge_type().alias("kind"), F.coalesce("relation.knowledge_type", project.knowledge_type()).alias("by_relation"))


@query("j14_first_relation", sql("SELECT id, CAST(CASE WHEN contains(text, 'purchase') THEN 0 WHEN contains(text, 'sign') THEN 1 WHEN contains(text, 'click') THEN 2 WHEN contains(text, 'view') THEN 3 END AS INT) AS ord FROM props", "props"))
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.with_relation(propositions(spark, sf_dir), relations(spark)).select("id", F.col("relation.ord").alias("ord"))


@query("g15_g16_facts", sql("SELECT lower(type) AS predicate, source_id AS arg0, target_id AS arg1, lower(type) || '(''' || replace(source_id, '-', '_') || ''', ''' || replace(target_id, '-', '_') || ''').' AS line FROM projected WHERE outcome = 'PROJECTED' GROUP BY ALL", "props", "tiers", projected=_PROJECTED))
def g15(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import atom

    rows = project.facts_of(project.merged_edges(project.project_edges(propositions(spark, sf_dir), relations(spark))))
    line = F.concat("predicate", F.lit("("), atom(F.col("arg0")), F.lit(", "), atom(F.col("arg1")), F.lit(")."))
    return rows.select("predicate", "arg0", "arg1", line.alias("line"))


@query("i12_structural_edges", sql("SELECT chunk AS source, 'HAS_PROPOSITION' AS type, id AS target, NULL::VARCHAR AS role FROM props UNION SELECT proposition_id, 'MENTIONS', resolved_id, role FROM mentions WHERE resolved_id IS NOT NULL UNION SELECT chunk, 'HAS_ENTITY', resolved_id, NULL FROM mentions JOIN props ON id = proposition_id WHERE resolved_id IS NOT NULL", "props", "mentions"))
def i12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.structural_edges(propositions(spark, sf_dir))


@query("j15_x09_grounding", sql("SELECT id, chunk AS ref, CASE WHEN event_id // 10 % 3 = 0 THEN chunk WHEN event_id // 10 % 3 = 1 THEN 'doc:' || chunk END AS entity_id FROM props", "props"))
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propositions(spark, sf_dir)
    n = F.floor(F.col("event_id") / 10)
    chunk = F.concat(F.lit("chunk-"), n.cast("string"))
    chunks = p.select(F.when(n % 3 == 0, chunk).when(n % 3 == 1, F.concat(F.lit("doc:"), chunk)).alias("entity_id")).where("entity_id IS NOT NULL").distinct()
    return project.grounded(p, chunks).select("id", "ref", "entity_id")


assert len(parse(RULES)) == 16
