"""Queries over whole tables that have no SQL, against brute force over small ones."""

import math
import random
import re
import zlib
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone.fixtures import propositions
from quillstone.operators import consolidate, graph, resolve, revise, vectors
from quillstone.plans import ingest
from quillstone.queries import QUERIES

MENTION = "array<struct<span:string,type:string,resolved_id:string,role:string>>"


def canonical(text):
    return " ".join(re.sub(r"[^a-z0-9\s]", "", text.lower()).split())


def candidates(new, old, k=5, least=0.5):
    """(id, match_id, score) of each new row against each active row of its context."""
    out = []
    for n in new:
        a, found = set(canonical(n["text"]).split()), []
        for o in old:
            b = set(canonical(o["text"]).split())
            if o["status"] == "ACTIVE" and o["context_id"] == n["context_id"] and a & b:
                s = len(a & b) / math.sqrt(len(a) * len(b))
                found += [(-s, o["id"])] * (s >= least)
        out += [(n["id"], i, -s) for s, i in sorted(found)[:k]]
    return sorted(out)


def revised(new, old):
    """(id, action, match_id) one row after the other."""
    by, seen, out = {o["id"]: o for o in old}, set(), []
    best = defaultdict(list)
    for i, m, s in candidates(new, old):
        best[i].append((s, m))
    ids = lambda r: {m["resolved_id"] for m in r["mentions"]} - {None}
    for n in sorted(new, key=lambda r: r["id"]):
        key = (n["context_id"], canonical(n["text"]))
        if key in seen:
            continue
        seen.add(key)
        equal = [o["id"] for o in old if o["status"] == "ACTIVE" and (o["context_id"], canonical(o["text"])) == key]
        same = lambda x, y: x["resolved_id"] == y["resolved_id"] if x["resolved_id"] and y["resolved_id"] else x["span"].lower() == y["span"].lower()
        shares = any(same(x, y) for _, m in best[n["id"]] for x in n["mentions"] for y in by[m]["mentions"])
        top = max(best[n["id"]], default=None)
        if equal:
            out.append((n["id"], "MERGED", min(equal)))
        elif top is None or (top[0] < 0.95 and not shares and ids(n)):
            out.append((n["id"], "NEW", None))
        else:
            out.append((n["id"], "MERGED" if top[0] >= 0.95 else "PENDING", top[1]))
    return sorted(out)


@pytest.fixture(scope="module")
def statements(spark):
    person = lambda i: ("p", "Person", i, "SUBJECT")
    rows = [("a", "c", "Ann likes red tea", "ACTIVE", [person("ann")]), ("b", "c", "tea likes red ann!", "ACTIVE", [person("ann")]), ("d", "c", "bob likes red cars", "ACTIVE", [person("bob")]), ("e", "d", "Ann likes red tea", "ACTIVE", [person("ann")]), ("f", "c", "Ann likes green tea", "STALE", [person("ann")]), ("g", "c", "Ann likes green tea", "ACTIVE", [])]
    rows += [("h", "c", "!!", "ACTIVE", [person("x")])] + [(f"i{k}", "c", "zoe likes red tea", "ACTIVE", [person("zoe")]) for k in range(7)]
    asked = [("m", "c", "Ann likes red tea.", "ACTIVE", [person("ann")]), ("n", "c", "ann red likes tea", "ACTIVE", [person("ann")]), ("o", "c", "Ann likes blue tea", "ACTIVE", [person("ann")]), ("p", "c", "eve likes red tea", "ACTIVE", [("q", "Person", "eve", "SUBJECT")]), ("q", "c", "nothing alike", "ACTIVE", [person("ann")]), ("r", "c", "?", "ACTIVE", []), ("s", "c", "nothing alike", "ACTIVE", [])]
    schema = f"id string, context_id string, text string, status string, mentions {MENTION}"
    return spark.createDataFrame(asked, schema), spark.createDataFrame(rows, schema)


def test_similar_statements_are_all_found(statements):
    new, old = statements
    got = sorted(map(tuple, revise.similar(new, old).collect()))
    assert got == candidates(new.collect(), old.collect())
    assert sorted(map(tuple, revise.fast_path(new, old, revise.similar(new, old)).collect())) == revised(new.collect(), old.collect())


def test_revision_is_of_every_event(spark, sf):
    p = propositions(spark, sf)
    rows = [r.asDict(recursive=True) for r in p.collect()]
    fresh = lambda r: r["event_id"] % 4 == 0 or zlib.crc32(r["text"].encode()) % 4 == 0
    new, old = [r for r in rows if fresh(r)], [r for r in rows if not fresh(r)]
    got = QUERIES["l10_j10_revise_similar"](spark, sf).collect()
    assert sorted(map(tuple, got)) == revised(new, old)
    assert {r["action"] for r in got} >= {"MERGED", "PENDING"}


def overlap(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def consolidated(session, old):
    """{id: (action, match_id, confidence)} by comparing every row with every row of its context."""
    words = lambda r: set(r["text"].lower().split())
    ids = lambda r: {m["resolved_id"] for m in r["mentions"]} - {None}
    known = defaultdict(list)
    for o in old:
        known[o["context_id"]].append((o, words(o), ids(o)))
    out = {}
    for s in session:
        w, e, best = words(s), ids(s), None
        for o, v, f in known[s["context_id"]]:
            score = 0.7 * overlap(w, v) + 0.3 * (overlap(e, f) if e and f else 0.0 if e or f else 0.5)
            if score >= 0.7 and (best is None or (-score, o["id"]) < best[:2]):
                best = (-score, o["id"], o["confidence"])
        if best is None:
            out[s["id"]] = ("PROMOTED" if s["confidence"] >= 0.6 else "DISCARDED", None, round(s["confidence"], 5))
        elif -best[0] > 0.9:
            out[s["id"]] = ("REINFORCED", best[1], round(min(1.0, best[2] + 0.1), 5))
        else:
            out[s["id"]] = ("MERGED", best[1], round((best[2] + s["confidence"]) / 2, 5))
    return out


def test_consolidation_is_of_every_event(spark, sf):
    rows = [r.asDict(recursive=True) for r in propositions(spark, sf).collect()]
    fresh = lambda r: r["event_id"] % 4 == 0 or zlib.crc32(r["text"].encode()) % 4 == 0
    want = consolidated([r for r in rows if fresh(r)], [r for r in rows if not fresh(r)])
    got = {r["id"]: (r["action"], r["match_id"], r["confidence"]) for r in QUERIES["l24_l28_m05_consolidate"](spark, sf).collect()}
    assert got.keys() == want.keys()
    for i, (action, match, confidence) in want.items():
        assert got[i][:2] == (action, match) and abs(got[i][2] - confidence) < 2e-5
    assert len({a for a, _, _ in want.values()}) > 2


def test_matches_of_statements_of_all_lengths(spark):
    """Words that all statements have, and statements shorter and longer than those listed at all subsets of words."""
    draw = random.Random(4)
    text = lambda: " ".join(["the", *draw.sample("abcdefghijklmnop", draw.randint(0, 11))])
    rows = lambda p, n: [(f"{p}{k}", "c" if k % 3 else "d", text(), "ACTIVE", [("s", "P", draw.choice("xyz"), "r")][: k % 2]) for k in range(n)]
    schema = f"id string, context_id string, text string, status string, mentions {MENTION}"
    new, old = spark.createDataFrame(rows("n", 60), schema), spark.createDataFrame(rows("o", 150), schema)
    got = sorted(map(tuple, revise.similar(new, old).collect()))
    want = candidates(new.collect(), old.collect())
    assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(x[2] - y[2]) < 1e-12 for x, y in zip(got, want, strict=True))
    scored = {}
    for least in (0.7, 0.45, 0.2):
        best = {r["id"]: r["match_id"] for r in consolidate.best_matches(new, old, least).collect()}
        words, ids = (lambda r: set(r["text"].lower().split())), (lambda r: {m["resolved_id"] for m in r["mentions"]})
        for n in new.collect():
            for o in old.collect():
                e, f = ids(n), ids(o)
                scored[n["id"], o["id"]] = 0.7 * overlap(words(n), words(o)) + 0.3 * (overlap(e, f) if e and f else 0.0 if e or f else 0.5) if n["context_id"] == o["context_id"] else -1
            near = [(-round(s, 9), o) for (i, o), s in scored.items() if i == n["id"] and s >= least]
            assert best.get(n["id"]) == (min(near)[1] if near else None)


def test_a_word_of_all_statements_joins_none(spark):
    from quillstone.operators.overlap import meetings

    side = lambda p: spark.range(300).selectExpr("'c' AS context_id", f"concat('{p}', id) AS {p}id", f"array('user', concat('u', id), concat('k', id % 3)) AS {p}words")
    met = meetings(side("a"), side("b"), "context_id", "awords", "bwords", 4 / 7, lambda m, n: (m + n) * 4 / 11)
    assert {(r["aid"][1:], r["bid"][1:]) for r in met.collect()} == {(str(k), str(k)) for k in range(300)}


@pytest.mark.parametrize("few", [0, 3, 64])
def test_links_of_hubs_and_others(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "LIGHT", few)
    monkeypatch.setattr(graph, "WIDE", 2)
    draw = random.Random(8)
    drawn = {(f"e{min(draw.randrange(14), draw.randrange(14))}", f"e{draw.randrange(14)}", f"p{draw.randrange(30)}") for _ in range(34)}
    edges = {(x, y, p) for a, b, p in drawn for x, y in ((a, b), (b, a)) if a != b}
    near = defaultdict(lambda: defaultdict(set))
    for a, b, p in edges:
        near[a][b].add(p)
    want = [(a, b, sorted(x), sorted(set().union(*(near[a][k] | near[b][k] for k in x)))) for a in near for b in near if a < b and b not in near[a] and (x := near[a].keys() & near[b].keys())]
    got = graph.two_hop_links(spark.createDataFrame(sorted(edges), "a string, b string, p string")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 5


def test_contradictions_of_crowds(spark, monkeypatch):
    monkeypatch.setattr(consolidate, "CHUNK", 2)
    monkeypatch.setattr(consolidate, "BLOCK", 3)
    draw = random.Random(2)
    rows = [(f"r{k}", draw.choice("cd"), f"{draw.choice('xy')} {draw.choice(('error', 'purchase'))}", "ACTIVE", [("s", "P", e, "r") for e in draw.sample("uvw", draw.randint(0, 3))]) for k in range(70)]
    props = spark.createDataFrame(rows, f"id string, context_id string, text string, status string, mentions {MENTION}")
    test = lambda a, b: a.endswith("error") & b.endswith("purchase")
    shares = lambda p, q: {m[2] for m in p[4]} & {m[2] for m in q[4]}
    met = [(p, q) for p in rows for q in rows if p[0] < q[0] and p[1] == q[1] and shares(p, q)]
    assert sorted((r["id_a"], r["id_b"]) for r in consolidate.contradiction_candidates(props).collect()) == sorted((p[0], q[0]) for p, q in met)
    got = consolidate.contradiction_candidates(props, test, F.col("text")).collect()
    assert sorted((r["id_a"], r["id_b"], r["row_a"]["text"]) for r in got) == sorted((p[0], q[0], p[2]) for p, q in met if p[2][2:] != q[2][2:])


def test_entities_of_names_of_many_and_few_mentions(spark, monkeypatch):
    known = spark.createDataFrame([("k", "Ann Cole", ["P"])], "id string, name string, labels array<string>")
    mentions = spark.createDataFrame([(f"c{k}", k, (" Ann Cole", "ann cole", "Bob Ray", "Eve")[k % 4 if k < 9 else 2], "P" if k else None) for k in range(40)] + [("z", None, "Eve ", "P"), ("y", 1, " ", "P")], "chunk_id string, place int, span string, type string")
    rows = lambda: sorted(map(repr, ingest.chunk_entities(mentions, known).collect()))
    want = rows()
    for most in (0, 5):
        monkeypatch.setattr(ingest, "OFTEN", most)
        assert rows() == want
    assert len(want) == 41 and sum("kind='REFERENCE'" in r for r in want) == 4


def test_a_block_gives_the_most_similar_only(spark):
    draw = random.Random(3)
    rows = [(f"v{k:02}", "c", [draw.random() for _ in range(4)]) for k in range(40)]
    df = spark.createDataFrame(rows, "id string, context_id string, embedding array<double>")
    every = defaultdict(list)
    for r in vectors.similar_pairs(df, 0.0, 64).collect():
        every[r["id_a"]].append((-r["score"], r["id_b"]))
    got = vectors.similar_pairs(df, 0.0, 64, 2).collect()
    assert sorted((r["id_a"], r["id_b"]) for r in got) == sorted((a, b) for a, x in every.items() for _, b in sorted(x)[:2])
    labelled = df.select("id", "embedding", F.when(F.col("id") < "v20", F.array(F.lit("P"))).when(F.col("id") < "v30", F.array(F.lit("Q"))).alias("labels"))
    near = {r["qid"]: r["considered"] for r in resolve.vector_candidates(labelled.withColumnRenamed("id", "qid"), labelled, -1.0, k=100).collect()}
    assert [near[f"v{k}"] for k in (10, 25, 35)] == [30, 20, 40]
    assert len(resolve._nearest(3, -1.0)(labelled.withColumnRenamed("id", "qid").withColumn("labels", F.array().cast("array<string>")).toPandas().pipe(lambda g: pd.concat([g.assign(side=0), g.assign(side=1)])))) == 120
