"""What no query runs whole: maintenance stages, streams and their restarts, the JSON store, long chains, listeners, edges of rules."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillstone.functions import mention_rules
from quillstone.operators import consolidate, datalog, edits, graph, object_graph, outcomes, records
from quillstone.plans import ingest, maintenance, retrieval
from quillstone.schema import PROPOSITIONS, TRUST_KEY
from quillstone.sources.json_store import JsonStore
from quillstone.streaming import incremental

AT = "2024-02-01 00:00:00"
DAY = datetime.datetime(2024, 1, 31)


def proposition(pid, text, confidence=0.9, decay=0.0, status="ACTIVE", context="c", level=0, pinned=False, entities=("e",)):
    mentions = [(x, "T", x, "SUBJECT") for x in entities]
    return (pid, context, text, mentions, confidence, decay, 0.5, None, [], DAY, DAY, DAY, pinned, DAY, status, level, [], 0, None, None, None, None)


@pytest.fixture
def store(spark):
    return lambda *rows: spark.createDataFrame(list(rows), PROPOSITIONS)


def statuses(rows):
    return {r["id"]: r["status"] for r in rows.collect()}


# Maintenance


def test_stages_not_asked_for_do_nothing(store):
    p = store(proposition("a", "x"), proposition("b", "y", 0.01, status="STALE"))
    out = maintenance.maintain(p, AT)
    assert statuses(out.rows) == {"a": "ACTIVE", "b": "STALE"}
    assert out.consolidated is out.abstractions is out.superseded is out.retired is out.collected is None


def test_a_session_is_consolidated(store):
    old = store(proposition("a", "ann likes red tea", 0.5), proposition("b", "bob drives a blue car every day", 0.5), proposition("s", "other", 0.3, status="STALE"))
    new = store(proposition("n1", "ann likes red tea", 0.4), proposition("n2", "bob drives a blue car each day", 0.9), proposition("n3", "unlike all", 0.7, status="PROMOTED"), proposition("n4", "faint thing", 0.2))
    out = maintenance.maintain(old, AT, new)
    assert {r["id"]: r["action"] for r in out.consolidated.collect()} == {"n1": "REINFORCED", "n2": "MERGED", "n3": "PROMOTED", "n4": "DISCARDED"}
    got = {r["id"]: (r["status"], round(r["confidence"], 6)) for r in out.rows.collect()}
    assert got == {"a": ("ACTIVE", 0.6), "b": ("ACTIVE", 0.7), "s": ("STALE", 0.3), "n3": ("ACTIVE", 0.7)}


def test_groups_are_abstracted_and_their_sources_superseded(store):
    p = store(*[proposition(f"a{k}", f"t{k}", entities=("e", "f") if k < 3 else ("e",)) for k in range(4)], proposition("z", "alone", entities=("g",)), proposition("h", "higher", level=1))
    out = maintenance.maintain(p, AT, abstract=consolidate.join_texts, least=3)
    found = {r["entity"]: r["text"] for r in out.abstractions.collect()}
    assert found == {"e": "t0; t1; t2; t3", "f": "t0; t1; t2"}
    got = statuses(out.rows)
    assert [got[f"a{k}"] for k in range(4)] == ["SUPERSEDED"] * 4 and got["z"] == got["h"] == "ACTIVE" and len(got) == 8
    assert out.superseded.count() == 4


def test_faded_rows_are_retired_and_collected(store):
    p = store(proposition("a", "x", 0.9), proposition("b", "y", 0.02), proposition("c", "z", 0.08), proposition("d", "p", 0.02, pinned=True), proposition("e", "s", 0.01, status="STALE"))
    out = maintenance.maintain(p, AT, retire_below=0.05, collect=True)
    assert {r["id"] for r in out.retired.collect()} == {"b", "d"}
    assert statuses(out.rows) == {"a": "ACTIVE", "c": "STALE", "e": "STALE"}
    faded = store(proposition("a", "x", 0.9, 0.5))
    assert maintenance.maintain(faded, AT, retire_below=0.4, decay_k=1.0).retired.count() == 0
    assert maintenance.maintain(faded, AT, retire_below=0.4, decay_k=2.0).retired.count() == 1


def test_contexts_are_due_after_enough_new_rows(store, spark):
    p = store(*[proposition(f"a{k}", "x") for k in range(10)], *[proposition(f"b{k}", "x", context="d") for k in range(9)], proposition("s", "x", context="d", status="STALE"))
    assert [tuple(r) for r in maintenance.due(p).collect()] == [("c", 10)]
    assert maintenance.due(p, spark.createDataFrame([("c", 1)], "context_id string, n bigint")).collect() == []


def test_a_failing_pass_leaves_the_others_alone(store):
    def broken(rows):
        raise ValueError("no")

    p = store(proposition("a", "x"), proposition("b", "y"))
    out = maintenance.dream(p, {"broken": broken, "stale": lambda rows: rows.where("id = 'a'").withColumn("status", F.lit("STALE")), "both": lambda rows: rows.withColumn("status", F.lit("CONTRADICTED"))})
    assert out.failed == {"broken": "no"} and statuses(out.saves) == {"a": "CONTRADICTED", "b": "CONTRADICTED"}


# Streams


def test_a_restart_ingests_nothing_twice(spark, tmp_path):
    write = lambda rows, name: spark.createDataFrame(rows, "source_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    run = lambda: incremental.ingest_once(incremental.read_growing(spark, f"{tmp_path}/in/*", "source_id bigint, text string"), f"{tmp_path}/ledger", f"{tmp_path}/at").awaitTermination()
    seen = lambda: sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/ledger").select("source_id").collect())
    write([(1, "a"), (2, "a"), (3, "b")], "one")
    run()
    assert seen() == [(1,), (3,)]
    run()
    assert seen() == [(1,), (3,)]
    write([(4, "b"), (5, "c")], "two")
    run()
    assert seen() == [(1,), (3,), (5,)]


def test_streams_count_windows_and_rates(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/conversations.parquet").write.parquet(f"{tmp_path}/c")
    turns = incremental.read_growing(spark, f"{tmp_path}/c", "conv_id bigint, turn bigint, role string, text string")
    incremental.due_windows(turns, "conv_id", 6).writeStream.format("memory").queryName("due").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    want = spark.read.parquet(f"{tmp_path}/c").groupBy("conv_id").count().where("count >= 6").collect()
    assert sorted(map(tuple, spark.table("due").collect())) == sorted(map(tuple, want))
    spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/e")
    events = incremental.read_growing(spark, f"{tmp_path}/e", spark.read.parquet(f"{tmp_path}/e").schema.simpleString()[7:-1].replace(":", " "))
    incremental.event_rates(events).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("rates").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{tmp_path}/e").count()


# Stores, records, retrieval


def test_a_json_store_is_recovered_by_another(spark, store, tmp_path):
    first = JsonStore(spark, f"{tmp_path}/json")
    assert first.load().collect() == [] and first.similar().collect() == []
    first.save_all(store(proposition("a", "x"), proposition("b", "y")))
    JsonStore(spark, f"{tmp_path}/json").save_all(store(proposition("b", "new"), proposition("c", "z")))
    again = JsonStore(spark, f"{tmp_path}/json")
    assert {r["id"]: r["text"] for r in again.load().collect()} == {"a": "x", "b": "new", "c": "z"}
    assert not again.searches_vectors and not again.walks_graphs


def test_clamped_arguments():
    assert retrieval.clamp(0, 0, -1.0) == (1, 1, 0.0) and retrieval.clamp(1000, 99, 2.0) == (100, 5, 1.0) and retrieval.clamp(7, 3, 0.4) == (7, 3, 0.4)


def test_a_failing_listener_stops_no_other(spark):
    heard = []
    assert records.fan_out(spark.range(3), {"one": lambda e: 1 / 0, "two": lambda e: heard.append(e.count())}) == {"one": "division by zero"}
    assert heard == [3]


def test_edits_move_their_clock(store):
    p = store(proposition("a", "x"))
    now = datetime.datetime(2024, 2, 1)
    about = edits.with_trust(p, F.lit(0.75), AT).first()
    assert about["metadata"] == {TRUST_KEY: "0.75"} and about["metadata_revised"] == now and about["content_revised"] == DAY
    same = edits.edited(p, AT, decay=F.lit(0.5)).first()
    assert same["decay"] == 0.5 and same["metadata_revised"] == same["content_revised"] == DAY
    with pytest.raises(Exception, match="between 0 and 1"):
        edits.edited(p, AT, confidence=F.lit(1.5)).collect()


def test_no_result_persists_nothing(store, spark):
    p = store(proposition("a", "x"))
    none = spark.createDataFrame([], "id string, action string, match_id string")
    assert outcomes.to_persist(none, p, p).collect() == []
    assert outcomes.extraction_counts(none).first()["total"] == 0


# Extraction


def test_extraction_isolates_failures_and_keeps_places(spark):
    chunks = spark.createDataFrame([(1, k, None if k == 3 else f"t{k}") for k in range(9)], "source_id bigint, place int, text string").repartition(4)

    def extract(text):
        if text == "t5":
            raise KeyError("bad")
        return [text.upper()]

    for mode in ("serial", "batched", "parallel"):
        got = {r["place"]: (r["statements"], r["error"]) for r in ingest.extract_each(chunks, extract, mode).collect()}
        assert got[5] == (None, "KeyError: 'bad'") and got[3][0] is None and got[3][1].startswith("AttributeError") and got[8] == (["T8"], None) and len(got) == 9
    with pytest.raises(ValueError, match="no such mode"):
        ingest.extract_each(chunks, extract, "other")


def test_mention_filters_together(spark):
    span = F.col("s")
    got = spark.createDataFrame([("",), ("the dog",), ("Ann Lee",)], "s string").select(mention_rules.composite(mention_rules.not_blank(span), mention_rules.not_vague(span)), mention_rules.composite()).collect()
    assert [tuple(r) for r in got] == [(False, True), (False, True), (True, True)]


# Rules, graphs, objects


def test_long_chains_and_cycles_are_whole(spark):
    facts = spark.createDataFrame([("reports_to", f"p{k:03d}", f"p{k + 1:03d}") for k in range(75)] + [("manages", "a", "b"), ("manages", "b", "a")], "predicate string, arg0 string, arg1 string")
    program = datalog.Program(facts)
    assert program.ask("reports_to_chain(p000, B)").count() == 75 and program.relation("reports_to_chain").count() == 75 * 76 // 2
    assert program.ask("manages_chain(A, B)").count() == 4
    assert program.holds("reports_to(p001, p002)") and not program.holds("reports_to(p002, p001)") and program.holds("manages(a, X)")
    assert program.first("manages(X, b)") == {"X": "a"} and program.first("manages(X, zz)") is None and program.first("not a goal") is None


def test_names_in_goals(spark):
    facts = spark.createDataFrame([("knows", "i1", "tea"), ("knows", "i2", "art")], "predicate string, arg0 string, arg1 string")
    names = spark.createDataFrame([("Ann", "i1"), ("Bob", "i2"), ("ann", "i9")], "name string, id string")
    program = datalog.Program(facts)
    assert datalog.with_ids("knows('ANN', T)", names) == "knows('i1', T)" and datalog.with_ids("knows(X, T)", names) == "knows(X, T)"
    rows, wider = datalog.ask_by_name(program, "knows('ann', T)", names)
    assert not wider and [tuple(r) for r in rows.collect()] == [("tea",)]
    rows, wider = datalog.ask_by_name(program, "knows('zoe', T)", names)
    assert wider and sorted(r["T"] for r in rows.collect()) == ["art", "tea"]
    assert datalog.general("knows('a_" + "x" * 40 + "', 'b')") == "knows('a_" + "x" * 40 + "', X0)"
    assert [r["line"] for r in datalog.sample_facts(facts, names, 1).collect()] == ["knows(Ann, tea)"]


def test_objects_of_many_levels(spark):
    nodes = spark.createDataFrame([(f"n{k:03d}", "x") for k in range(70)], "id string, name string")
    links = spark.createDataFrame([(f"n{k:03d}", "f", f"n{k + 1:03d}") for k in range(69)], "source string, field string, target string")
    levels = {r["id"]: r["level"] for r in object_graph.build(nodes, links).collect()}
    assert levels == {f"n{k:03d}": 69 - k for k in range(70)}


def test_a_path_needs_all_of_its_steps_in_the_context(store, spark):
    p = store(proposition("a", "x"), proposition("b", "y"), proposition("z", "z", context="d"))
    paths = spark.createDataFrame([("p", ["a", "b"]), ("q", ["a", "z"]), ("r", []), ("s", ["gone"])], "path_id string, via array<string>")
    assert sorted(r["path_id"] for r in graph.paths_in_context(paths, p, "c").collect()) == ["p", "r"]


def test_thin_results_are_widened_by_entities(store, spark):
    p = store(*[proposition(f"a{k}", f"about {k}", 0.9 - k / 100, entities=(f"e{k % 2}",)) for k in range(8)], proposition("z", "other", entities=("f",)))
    hits = spark.createDataFrame([("a0", 1)], "id string, rank int")
    got = {r["id"]: r["score"] for r in retrieval.memory_search(p, "c", hits, ["about 2"], AT, 3).collect()}
    assert set(got) == {"a0", "a2", "a4"} and abs(got["a0"] - 2 / 61) < 1e-12 and abs(got["a2"] - 1 / 61 - 1 / 62) < 1e-12
    assert {r["id"] for r in retrieval.memory_search(p, "c", hits.limit(0), [], AT, 3).collect()} == set()


def test_many_relations_are_a_table(store, spark, monkeypatch):
    from quillstone.operators import project
    from quillstone.schema import RELATIONS

    relations = spark.createDataFrame([(k, f"Verb{k} of", "SEMANTIC", None, None, None, None, None) for k in range(9)], RELATIONS)
    p = store(proposition("a", "ann verb3 of bob, verb1 of eve"), proposition("b", "nothing"), proposition("c", "verb8 of"), proposition("d", "verb8 of"), proposition("e", None))
    want = {"a": 1, "b": None, "c": 8, "d": 8, "e": None}
    got = lambda: {r["id"]: r["o"] for r in project.with_relation(p, relations).select("id", F.col("relation.ord").alias("o")).collect()}
    assert got() == want
    monkeypatch.setattr(project, "INLINE", 3)
    assert got() == want
    monkeypatch.setattr(project, "SENT", 8)
    with pytest.raises(ValueError, match="more than 8"):
        got()


def test_vectors_of_null_texts_are_null(spark):
    from quillstone.sources.embedding import embed, hash_vectors

    texts = [None, "a", None, "b", ""]
    got = [r["embedding"] for r in embed(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").coalesce(1)).orderBy("k").collect()]
    assert [g is None for g in got] == [t is None for t in texts]
    assert [round(x, 5) for x in got[3]] == [round(float(x), 5) for x in hash_vectors(["b"])[0]]
    assert embed(spark.createDataFrame([(None,)], "text string")).first()["embedding"] is None


def test_places_in_groups_of_any_size(spark):
    from quillstone.operators.numbering import numbered

    rows = [("hot", k * 7 % 400) for k in range(400)] + [("b", 2), ("b", None), (None, 1), (None, 0), ("c", 5)]
    got = sorted(map(str, numbered(spark.createDataFrame(rows, "g string, o int").repartition(5), "g", "o").collect()))
    want = []
    for g in ("hot", "b", None, "c"):
        own = sorted((o is not None, o or 0) for x, o in rows if x == g)
        want += [f"Row(g={g!r}, o={o if some else None}, _n={len(own)}, _i={i})" for i, (some, o) in enumerate(own)]
    assert got == sorted(want)


def test_claims_of_repeated_and_null_texts(spark):
    from quillstone.operators.store import unclaimed

    rows = [(1, "a"), (2, "a"), (1, "a"), (3, None), (4, None), (None, "b"), (5, "c")]
    got = unclaimed(spark.createDataFrame(rows, "source_id int, content_hash string"), spark.createDataFrame([("c",)], "content_hash string")).collect()
    done = sorted((r["source_id"] or 0, r["content_hash"] or "") for r in got if r["outcome"] == "INGESTED")
    assert done == [(1, "a"), (3, "")] or done == [(0, "b"), (1, "a"), (3, "")]
    assert len(got) == 7
