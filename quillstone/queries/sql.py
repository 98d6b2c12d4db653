"""The views of ``quillstone.fixtures`` as DuckDB common table expressions."""

from __future__ import annotations

from ..fixtures import AS_OF

AT = f"TIMESTAMP '{AS_OF}'"


def days(start: str, at: str = AT) -> str:
    return f"greatest(floor((epoch_us({at}) - epoch_us({start})) / 86400000000.0), 0)"


def effective(k: float = 2.0, at: str = AT) -> str:
    return (
        f"CASE WHEN invalidated_at <= {at} THEN 0.0::DOUBLE WHEN valid_from IS NULL THEN confidence * exp(-decay * {k} * {days('content_revised', at)}) "
        f"WHEN {at} < valid_from OR coalesce({at} >= valid_to, false) THEN 0.0::DOUBLE WHEN valid_to IS NOT NULL THEN confidence "
        f"ELSE confidence * exp(-decay * {k} * {days('valid_from', at)}) END"
    )


def util(k: float = 2.0) -> str:
    return f"({effective(k)}) * (1 + 0.5::DOUBLE * importance) * (1 + 0.1::DOUBLE * ln(1 + reinforce_count))"


_WORD = "translate(upper(left(md5(CAST({0} AS VARCHAR)), 1)), '0123456789', 'GHIJKLMNOP') || translate(substr(md5(CAST({0} AS VARCHAR)), 2, 9), '0123456789', 'ghijklmnop')"


def name_word(k: str) -> str:
    return _WORD.format(k)


VIEWS = {
    "props0": """SELECT event_id, 'ev-' || event_id AS id, 'ctx-' || (user_id % 10) AS context_id, 'user ' || user_id || ' ' || event_type AS text, user_id, event_type,
  least(1.0::DOUBLE, value / 500) AS confidence, (event_id % 5) * 0.05::DOUBLE AS decay, (event_id % 11) / 10.0::DOUBLE AS importance,
  CASE WHEN event_id % 3 = 0 THEN ' ' ELSE 'seen' END AS reasoning, 'chunk-' || (event_id // 10) AS chunk,
  ts AS created, ts AS content_revised, ts + INTERVAL 1 DAY * (event_id % 3) AS metadata_revised, event_id % 50 = 0 AS pinned, ts + INTERVAL 1 DAY * (event_id % 4) AS last_accessed,
  CASE WHEN event_id % 10 < 6 THEN 'ACTIVE' WHEN event_id % 10 = 6 THEN 'SUPERSEDED' WHEN event_id % 10 = 7 THEN 'CONTRADICTED' WHEN event_id % 10 = 8 THEN 'PROMOTED' ELSE 'STALE' END AS status,
  CASE WHEN event_id % 7 = 0 AND event_id >= 2 THEN 1 ELSE 0 END AS level, CAST(event_id % 4 AS INT) AS reinforce_count,
  CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 END AS trust_score,
  CASE WHEN event_id % 6 IN (1, 2, 3, 4) THEN ts - INTERVAL 1 DAY END AS observed_at, CASE WHEN event_id % 6 IN (1, 2, 3) THEN ts END AS valid_from,
  CASE event_id % 6 WHEN 2 THEN ts + INTERVAL 10 DAY WHEN 3 THEN ts + INTERVAL 60 DAY END AS valid_to, CASE WHEN event_id % 6 = 4 THEN ts + INTERVAL 5 DAY END AS invalidated_at
  FROM events""",
    "props": f"SELECT *, {effective()} AS eff, greatest(content_revised, metadata_revised) AS touched FROM props0",
    "mentions": """SELECT id AS proposition_id, context_id, status, 0 AS pos, 'user ' || user_id AS span, 'Person' AS type, 'user-' || user_id AS resolved_id, 'SUBJECT' AS role FROM props0
  UNION ALL SELECT id, context_id, status, 1, event_type, 'EventType', CASE WHEN event_id % 13 <> 0 THEN 'type-' || event_type END, 'OBJECT' FROM props0
  UNION ALL SELECT id, context_id, status, 2, 'user ' || (user_id + 1), 'Person', 'user-' || ((user_id * 7 + 3) % 150), 'OTHER' FROM props0 WHERE event_id % 9 = 0""",
    "provenance": """SELECT 'ev-' || event_id AS proposition_id, 0 AS pos, ['uri', 'file', 'content', 'connector'][event_id % 4 + 1] AS kind, ['uri', 'file', 'content', 'connector'][event_id % 4 + 1] || ':' || (event_id % 100) AS key, 'source ' || (event_id % 100) AS display FROM events WHERE event_id % 11 <> 0
  UNION ALL SELECT 'ev-' || event_id, 1, 'content', 'content:' || (event_id % 50), 'note ' || (event_id % 50) FROM events WHERE event_id % 11 <> 0 AND event_id % 3 = 0""",
    "tiers": "SELECT id AS proposition_id, coalesce(min(CASE kind WHEN 'connector' THEN 0 WHEN 'uri' THEN 1 WHEN 'file' THEN 1 WHEN 'content' THEN 2 END), 3) AS tier FROM props0 LEFT JOIN provenance ON proposition_id = id GROUP BY id",
    "vectors": "SELECT 'vec-' || vec_id AS id, 'lab-' || label AS context_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings",
    "facts": """SELECT 'works_at' AS predicate, 'c' || c_custkey AS arg0, 'co' || (c_custkey // 10) AS arg1 FROM customer
  UNION ALL SELECT 'member_of', 'c' || c_custkey, 'team' || (c_custkey // 7) FROM customer
  UNION ALL SELECT 'lives_in', 'c' || c_custkey, 'n' || c_nationkey || '-' || (c_custkey // 25) FROM customer
  UNION ALL SELECT 'friend_of', 'c' || c_custkey, 'c' || (c_custkey // 2) FROM customer WHERE c_custkey > 0
  UNION ALL SELECT 'colleague_of', 'c' || c_custkey, 'c' || (c_custkey + 1) FROM customer WHERE c_custkey % 4 = 0
  UNION ALL SELECT 'expert_in', 'c' || c_custkey, lower(c_mktsegment) FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT 'knows', 'c' || c_custkey, lower(c_mktsegment) FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT 'reports_to', 's' || s_suppkey, 's' || (s_suppkey // 2) FROM supplier WHERE s_suppkey > 0
  UNION ALL SELECT 'manages', 's' || (s_suppkey // 2), 's' || s_suppkey FROM supplier WHERE s_suppkey > 0
  UNION ALL SELECT 'owns', 'c' || o_custkey, 'o' || o_orderkey FROM orders
  UNION ALL SELECT 'type_of', 'o' || o_orderkey, lower(o_orderpriority) FROM orders""",
    "artifacts": "SELECT doc_id AS source_id, ['uri', 'file', 'content', 'connector'][doc_id % 4 + 1] AS locator_kind, ['uri', 'file', 'content', 'connector'][doc_id % 4 + 1] || ':' || source AS locator_key, text, sha256(text) AS content_hash FROM documents",
    "entities": f"SELECT 'c' || c_custkey AS id, 'Dr. ' || {name_word('c_custkey - CASE WHEN c_custkey % 9 = 8 THEN 1 ELSE 0 END')} || ' Smith' AS name, ['Customer', upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2))] AS labels, c_nationkey AS nation FROM customer",
    "edges": "SELECT DISTINCT a.resolved_id AS a, b.resolved_id AS b, a.proposition_id AS p FROM mentions a JOIN mentions b ON a.proposition_id = b.proposition_id AND a.resolved_id <> b.resolved_id WHERE a.status = 'ACTIVE'",
}
NEEDS = {"props": ("props0",), "mentions": ("props0",), "tiers": ("props0", "provenance"), "edges": ("mentions",)}


def _ordered(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in (*_ordered(NEEDS.get(n, ())), n):
            if m not in out:
                out.append(m)
    return out


def sql(body: str, *views: str, recursive: bool = False, **ctes: str) -> str:
    """The statement after the views that it names and further common table expressions."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in _ordered(views)] + [f"{n} AS ({q})" for n, q in ctes.items()]
    head = f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else ""
    return head + body
