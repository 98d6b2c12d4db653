"""DuckDB SQL of the operators that SQL can express, over any table of documents."""

from __future__ import annotations

from .decontaminate import LEAST, WINDOW
from .mixing import NONE, SEED
from .ngram_join import THRESHOLD
from .quality_rules import CHAR_BOUND, COMMON, COMMON_WORDS, MIN_CHARS, MIN_WORDS, WORD_BOUND
from .sharding import SHARDS, SLOTS

WORD = r"[\p{L}\p{N}]+"


def words(column: str = "text") -> str:
    return f"regexp_extract_all(lower(coalesce({column}, '')), '{WORD}')"


def rules(docs: str) -> str:
    """doc_id, char_distance, word_distance, verdict."""
    t = "coalesce(text, '')"
    patterns = (r"\p{Ll}", r"[\p{Lu}\p{Lt}]", r"[\p{Lm}\p{Lo}]", r"\p{N}", r"[\t\n\x0B\f\r ]", r"[.,;:''\"()-]", r"[!?]")
    counts = ", ".join(f"length({t}) - length(regexp_replace({t}, '{p}', '', 'g')) AS c{k}" for k, p in enumerate(patterns))
    known = ", ".join(f"'{x}'" for x in COMMON_WORDS)
    lexicon = ", ".join(f"('{lang}', '{w}', {k})" for lang, own in COMMON_WORDS.items() for k, w in enumerate(own))
    rest = len(next(iter(COMMON_WORDS.values())))
    term = "CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END"
    return f"""
WITH d0 AS (SELECT doc_id, lang, row_number() OVER () AS rid, length({t}) AS size, {counts}, {words()} AS w FROM {docs}),
vocabulary AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM d0 WHERE lang NOT IN ({known})) GROUP BY ALL),
lex AS (SELECT * FROM (VALUES {lexicon}) v(own, word, bin) UNION ALL SELECT * FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) - 1 AS bin FROM vocabulary) WHERE bin < {COMMON}),
d AS (SELECT *, CASE WHEN lang IN (SELECT own FROM lex) THEN lang ELSE '*' END AS own FROM d0),
c AS (SELECT rid, own, size, unnest(range(8)) AS bin, unnest([c0, c1, c2, c3, c4, c5, c6, size - c0 - c1 - c2 - c3 - c4 - c5 - c6]) AS n FROM d),
cr AS (SELECT own, bin, sum(n) AS n FROM c GROUP BY ALL UNION ALL SELECT '*', bin, sum(n) FROM c GROUP BY bin HAVING NOT bool_or(own = '*') UNION ALL SELECT '*', bin, sum(n) FROM c GROUP BY bin HAVING bool_or(own = '*')),
cq AS (SELECT own, bin, max(n) / greatest(sum(max(n)) OVER (PARTITION BY own), 1) AS q FROM cr GROUP BY own, bin),
cd AS (SELECT rid, sqrt(greatest(sum({term}) / 2, 0)) AS d FROM (SELECT rid, c.n / c.size AS p, q FROM c JOIN cq USING (own, bin) WHERE c.size >= {MIN_CHARS}) GROUP BY rid),
x AS (SELECT rid, own, unnest(w) AS word FROM d WHERE own <> '*'),
b AS (SELECT rid, own, coalesce(bin, {rest}) AS bin, count(*) AS n FROM x LEFT JOIN lex USING (own, word) GROUP BY ALL),
wq AS (SELECT own, bin, n / sum(n) OVER (PARTITION BY own) AS q FROM (SELECT own, bin, sum(n) AS n FROM b GROUP BY ALL)),
ws AS (SELECT rid, own, sum(n) AS size FROM b GROUP BY ALL HAVING sum(n) >= {MIN_WORDS}),
wd AS (SELECT rid, sqrt(greatest(sum({term}) / 2, 0)) AS d FROM (SELECT ws.rid, coalesce(b.n, 0) / ws.size AS p, q FROM ws JOIN wq ON wq.own = ws.own LEFT JOIN b ON b.rid = ws.rid AND b.bin = wq.bin) GROUP BY rid)
SELECT doc_id, CASE WHEN len(w) > 0 THEN round(cd.d, 6) END AS char_distance, CASE WHEN len(w) > 0 THEN round(wd.d, 6) END AS word_distance,
    CASE WHEN len(w) = 0 THEN 'empty' WHEN cd.d > {CHAR_BOUND[0]} + {CHAR_BOUND[1]} / sqrt(size) THEN 'characters' WHEN wd.d > {WORD_BOUND[0]} + {WORD_BOUND[1]} / sqrt(len(w)) THEN 'words' ELSE 'keep' END AS verdict
FROM d LEFT JOIN cd USING (rid) LEFT JOIN wd USING (rid)"""


def pairs(docs: str) -> str:
    """doc_id_a, doc_id_b, jaccard."""
    return f"""
WITH w AS (SELECT doc_id, {words()} AS w FROM {docs}),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w WHERE len(w) > 0),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g),
c AS (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, any_value(a.n) + any_value(b.n) AS total, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT doc_id_a, doc_id_b, round(shared / (total - shared), 6) AS jaccard FROM c WHERE shared / (total - shared) >= {THRESHOLD}"""


def groups(docs: str) -> str:
    """doc_id, group_id of documents in a group."""
    return f"""
WITH RECURSIVE e AS (SELECT * FROM ({pairs(docs)})),
n AS (SELECT doc_id_a AS a, doc_id_b AS b FROM e UNION SELECT doc_id_b, doc_id_a FROM e),
reach AS (SELECT a, b FROM n UNION SELECT reach.a, n.b FROM reach JOIN n ON reach.b = n.a)
SELECT a AS doc_id, least(a, min(b)) AS group_id FROM reach GROUP BY a"""


def links(docs: str) -> str:
    """doc_id, class_id, n_links of documents with a similar one."""
    return f"""
WITH p AS (SELECT * FROM ({pairs(docs)})), l AS (SELECT doc_id, count(*) AS n_links FROM (SELECT doc_id_a AS doc_id FROM p UNION ALL SELECT doc_id_b FROM p) GROUP BY doc_id)
SELECT doc_id, group_id AS class_id, n_links FROM l JOIN ({groups(docs)}) USING (doc_id)"""


def passages(docs: str, benchmark: str = "benchmark") -> str:
    """doc_id, item_id, start, stop, words."""
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {words()} AS w, string_split_regex(coalesce(text, ''), '{WORD}') AS gaps, regexp_extract_all(coalesce(text, ''), '{WORD}') AS raw FROM {docs}),
u AS (SELECT doc_id, rid, unnest(range(1, len(w) + 1)) AS k, unnest(list_transform(gaps[:len(w)], lambda x: length(x))) AS gap, unnest(list_transform(raw, lambda x: length(x))) AS size FROM d),
places AS (SELECT rid, k, sum(gap + size) OVER (PARTITION BY rid ORDER BY k) - size AS first, sum(gap + size) OVER (PARTITION BY rid ORDER BY k) AS last FROM u),
i AS (SELECT item_id, {words()} AS w FROM {benchmark} WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[k:k + least({WINDOW}, len(w)) - 1], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS k FROM i WHERE len(w) >= {LEAST})),
sizes AS (SELECT DISTINCT n FROM p),
s AS (SELECT rid, doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram FROM (SELECT rid, doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT rid, doc_id, item_id, k, k + n - 1 AS e FROM s JOIN p USING (n, gram)),
j AS (SELECT *, CASE WHEN k <= 1 + max(e) OVER (PARTITION BY rid, item_id ORDER BY k, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM h),
m AS (SELECT *, sum(new) OVER (PARTITION BY rid, item_id ORDER BY k, e ROWS UNBOUNDED PRECEDING) AS island FROM j),
r AS (SELECT rid, doc_id, item_id, min(k) AS k, max(e) AS e FROM m GROUP BY rid, doc_id, item_id, island)
SELECT r.doc_id, r.item_id, CAST(a.first AS BIGINT) AS start, CAST(b.last AS BIGINT) AS stop, r.e - r.k + 1 AS words FROM r JOIN places a ON a.rid = r.rid AND a.k = r.k JOIN places b ON b.rid = r.rid AND b.k = r.e"""


def mixture(docs: str, weights: dict[str, float], fraction: float) -> str:
    """doc_id, source, n_tokens, finish, position."""
    cases = " ".join(f"WHEN '{s}' THEN {w}" for s, w in weights.items())
    weight = f"CASE source {cases} ELSE 1.0 END" if weights else "1.0"
    return f"""
WITH t AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+')) AS n_tokens, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM {docs}),
v AS (SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, n_tokens ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST({weight} AS DOUBLE) AS finish FROM t),
g AS (SELECT *, sum(n_tokens) OVER (ORDER BY finish, key, doc_id NULLS FIRST, n_tokens ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (ORDER BY finish, key, doc_id NULLS FIRST, n_tokens) AS position FROM v)
SELECT doc_id, source, n_tokens, round(finish, 6) AS finish, position FROM g WHERE run <= (SELECT floor({fraction} * sum(n_tokens)) FROM t)"""


def shards(docs: str) -> str:
    """doc_id, slot, shard."""
    return f"""
WITH d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS INT) AS slot, strlen(coalesce(text, '')) AS n FROM {docs}),
l AS (SELECT s.slot, s.slot * {SHARDS} // {SLOTS} AS home, coalesce(sum(d.n), 0) AS load FROM (SELECT unnest(range({SLOTS})) AS slot) s LEFT JOIN d USING (slot) GROUP BY ALL),
mean AS (SELECT sum(load) / {SHARDS} AS mean FROM l),
r AS (SELECT *, sum(load) OVER (PARTITION BY home ORDER BY load DESC, slot) AS run, row_number() OVER (PARTITION BY home ORDER BY load DESC, slot) AS nth FROM l),
k AS (SELECT slot, home, load, mean, run <= mean OR nth = 1 AS stays FROM r, mean),
lack AS (SELECT home, greatest(max(mean) - sum(CASE WHEN stays THEN load ELSE 0 END), 0) AS lack FROM k GROUP BY home),
ends AS (SELECT home, sum(lack) OVER (ORDER BY home) AS fin FROM lack),
loose AS (SELECT slot, (sum(load) OVER (ORDER BY load DESC, slot) - load / 2) * (SELECT sum(lack) FROM lack) / sum(load) OVER () AS middle FROM k WHERE NOT stays),
moved AS (SELECT slot, least(count(CASE WHEN fin <= middle THEN 1 END), {SHARDS - 1}) AS shard FROM loose, ends GROUP BY slot),
final AS (SELECT k.slot, coalesce(moved.shard, k.home) AS shard FROM k LEFT JOIN moved USING (slot))
SELECT d.doc_id, d.slot, final.shard FROM d JOIN final USING (slot)"""


CHATS = """
WITH t AS (SELECT conv_id, count(*) AS n_turns, string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text,
    sum(CASE WHEN role = 'assistant' THEN strlen(coalesce(text, '')) ELSE 0 END) AS assistant_bytes FROM conversations GROUP BY conv_id)
SELECT conv_id, n_turns, text, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(assistant_bytes AS BIGINT) AS assistant_bytes FROM t"""
