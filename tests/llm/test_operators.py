"""Every operator against brute force, over texts that are null, empty, very long, repeated or tied, and columns whose names clash."""

import itertools
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from quillstone.llm import chat_format, decontaminate, html_extract, kernels, langid, mixing, ngram_join, quality_rules, rule_ensemble, sharding, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ["slot", "_slot", "shard", "map_version", "verdict", "_judged", "char_distance", "_gone", "_source", "_cut", "_mix_source", "key", "weight", "finish", "position", "node", "sig", "_id", "y", "nth", "_lang", "item_id", "start", "predicted"]


def words(text):
    out, run = [], ""
    for ch in text or "":
        if unicodedata.category(ch)[0] in "LN":
            run += ch.lower() if len(ch.lower()) == 1 else ch
        elif run:
            out.append(run)
            run = ""
    return out + [run] * bool(run)


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 80)
    near = base.split()
    near[40] = "other"
    texts = [None, "", " \n", "...", "one", "one", "Two words", "two, WORDS!", base, base, " ".join(near), "Ünï ça 中文 ①²", prose(2, 60_000), prose(3, 30), prose(3, 30) + " tail"]
    out = [(k, t, ["en", "de", None, "xx"][k % 4], ["a", "b", None][k % 3], len(t or "")) for k, t in enumerate(texts)]
    return [*out, out[8], (None, base, "en", "a", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def wide(docs):
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def benchmark(spark):
    b = " ".join(prose(1, 80).split()[10:25])
    return spark.createDataFrame([(1, b.upper()), (2, b), (3, None), (4, ""), (5, "one"), (6, "Two words"), (None, b), (7, "ünï ÇA 中文")], "item_id bigint, text string")


def same(a, b):
    assert Counter(map(repr, map(tuple, a))) == Counter(map(repr, map(tuple, b)))


# Kernels


def test_words_are_runs_of_letters_and_numbers():
    texts = ["", "a", "Ünï-ça 中文x ①²", "x" * 100_000, "tail "]
    slab = kernels.Slab(texts)
    joined = "\n".join(texts)
    assert [kernels.Slab([w]).word_hash[0] for t in texts for w in words(t)] == slab.word_hash.tolist()
    assert [joined[a:b].lower() for a, b in zip(*slab.spans, strict=True)] == [w for t in texts for w in words(t)]


# 5. N-gram Jaccard join


def grams(text, n=2):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_pairs(rows, threshold=0.65):
    found = {}
    sets = [(r[0], grams(r[1])) for r in rows if r[0] is not None]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i != j and a and b and len(a & b) / len(a | b) >= threshold:
            found[min(i, j), max(i, j)] = max(found.get((min(i, j), max(i, j)), 0), round(len(a & b) / len(a | b), 6))
    return [(*k, v) for k, v in found.items()]


def expanded(sets):
    """The pairs of documents that pairs of sets and their membership stand for."""
    pairs, members = ([tuple(r) for r in x.collect()] for x in sets)
    own = defaultdict(set)
    for node, doc in members:
        own[node].add(doc)
    found = {}
    for a, b, jaccard in [*pairs, *((node, node, 1.0) for node in own)]:
        for i, j in itertools.product(own[a], own[b]):
            if i != j:
                found[min(i, j), max(i, j)] = max(found.get((min(i, j), max(i, j)), 0), jaccard)
    return [(*k, v) for k, v in found.items()]


def brute_links(rows, threshold=0.65):
    """(doc_id, class_id, n_links) for rows of distinct ids."""
    n, root = Counter(), {}
    for a, b, _ in brute_pairs(rows, threshold):
        n.update((a, b))
        ends = {root.setdefault(a, a), root.setdefault(b, b)}
        root.update({k: min(ends) for k, v in root.items() if v in ends})
    return [(k, root[k], n[k]) for k in n]


def test_pairs(docs, wide, none, rows):
    same(expanded(ngram_join.similar_sets(docs)), brute_pairs(rows))
    same(expanded(ngram_join.similar_sets(wide)), brute_pairs(rows))
    assert [x.collect() for x in ngram_join.similar_sets(none)] == [[], []]


def test_links(spark, docs, wide, none, rows):
    once = list({r[0]: r for r in rows if r[0] is not None}.values())
    same(ngram_join.linked_documents(spark.createDataFrame(once, DOCS)).collect(), brute_links(once))
    same(ngram_join.linked_documents(docs).collect(), brute_links(once))
    same(ngram_join.linked_documents(wide).collect(), brute_links(once))
    assert ngram_join.linked_documents(none).collect() == []
    twice = [(1, prose(9, 60), "en", "a", 0), (1, prose(9, 60) + " tail", "en", "a", 0), (2, "alone here", "en", "a", 0)]
    same(ngram_join.linked_documents(spark.createDataFrame(twice, DOCS)).collect(), [(1, 1, 2)])


def test_links_of_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    base = prose(4, 120).split()
    rows = []
    for k in range(40):
        own = list(base)
        own[(k * 3) % 118] = f"x{k // 2}"
        rows.append((k, " ".join(own), "en", "a", 0))
    rows += [(100 + k, prose(50 + k, 40), "en", "a", 0) for k in range(10)]
    same(ngram_join.linked_documents(spark.createDataFrame(rows, DOCS)).collect(), brute_links(rows))


def test_pairs_recall(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(150):
        base = [f"w{x}" for x in rng.integers(0, 3000, int(rng.choice([4, 8, 11, 20, 37, 60, 200, 900])))]
        for _ in range(3):
            copy = list(base)
            for at in rng.integers(0, len(base), max(1, len(base) // 30)):
                copy[at] = f"w{rng.integers(0, 3000)}"
            rows.append((len(rows), " ".join(copy), "en", "a", 0))
    want = brute_pairs(rows)
    found = expanded(ngram_join.similar_sets(spark.createDataFrame(rows, DOCS)))
    assert set(found) <= set(want)
    assert len(found) >= 0.98 * len(want) > 100


def test_ngrams_of_one_text_are_known(spark):
    """They come first in prefixes and aren't searched; the shared ones are never taken for them."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"{x:x}" for x in rng.integers(0, 1 << 20, 200)) + " in all texts" for _ in range(400)]
    order, _ = ngram_join._prefix_tables(spark.createDataFrame([(t,) for t in texts], "text string"), 2, 0.65)
    grams = np.concatenate([s.gram_sets(2)[0] for _, s in kernels.slabs(texts)])
    gram, count = np.unique(grams, return_counts=True)
    level = ngram_join._level(order.value, gram)
    assert (level[count == 1] > 0).mean() < 0.02
    assert (level[count > 1] > 0).all() and (count == 400).sum() == 2


def at_the_threshold(pairs, seed):
    """Pairs of texts that share just as many word pairs as the threshold needs, in sizes that signatures serve worst, and larger ones."""
    rng = np.random.default_rng(seed)
    sizes = [(26, 40), (23, 27), (26, 27), (10, 15), (12, 18), (17, 17), (33, 42), (90, 120), (300, 300)]
    rows = []
    for k in range(pairs):
        a, b = sizes[k % len(sizes)]
        both = -(-(a + b) * 65 // 165)
        base = [f"w{x}" for x in rng.integers(0, 100_000, both + 1)]
        for size in (a, b):
            rows.append((len(rows), " ".join(base + [f"w{x}" for x in rng.integers(0, 100_000, size - both)]), "en", "a", 0))
    return rows


def test_pairs_at_the_threshold_are_whole(spark):
    rows = at_the_threshold(540, 11)
    want = brute_pairs(rows)
    assert len(want) >= 500
    docs = spark.createDataFrame(rows, DOCS)
    same(expanded(ngram_join.similar_sets(docs)), want)
    same(ngram_join.linked_documents(docs).collect(), brute_links(rows))


@pytest.mark.parametrize("whole", [2, 1000])
def test_pairs_are_whole_with_few_signatures(spark, monkeypatch, whole):
    """Clusters whose groups few signatures connect: groups compared as a whole, and set by set, each pair once."""
    monkeypatch.setattr(ngram_join, "WHOLE", whole)
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 500, int(rng.choice([14, 25, 40, 150])))]
        for _ in range(12):
            copy = list(base)
            for at in rng.integers(0, len(base), max(1, len(base) // 14)):
                copy[at] = f"w{rng.integers(0, 500)}"
            rows.append((len(rows), " ".join(copy), "en", "a", 0))
    docs = spark.createDataFrame(rows, DOCS)
    want = brute_pairs(rows)
    same(expanded(ngram_join.similar_sets(docs, partitions=1)), want)
    same(ngram_join.linked_documents(docs, partitions=1).collect(), brute_links(rows))


def test_what_finds_nothing_is_not_shuffled(spark):
    """Signatures of one text only: of texts that have nothing in common no more than counts is written (before: 2 bytes and more a letter)."""
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"{x:x}" for x in rng.integers(0, 1 << 28, 60)), "en", "a", 0) for k in range(3000)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4).localCheckpoint()
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    assert ngram_join.linked_documents(docs).collect() == []
    assert written() - before < sum(len(r[1]) for r in rows)


def test_every_pair_meets_in_one_tile(spark, monkeypatch):
    """A group of many blocks, small ones that it is linked with, and links of those; a set is not sent again for each link."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    groups = {0: range(100), **{k: range(100 * k, 100 * k + 1 + k % 3) for k in range(1, 121)}}
    placed = [(node, key, i // 16) for key, nodes in groups.items() for i, node in enumerate(nodes)]
    links = [(0, k) for k in range(1, 101)] + [(k, k + 1) for k in range(1, 110)]
    got = ngram_join._places(spark.createDataFrame(placed, "node bigint, key bigint, blk bigint"), spark.createDataFrame(links, "key_a bigint, key_b bigint")).collect()
    tiles = defaultdict(list)
    for tile, node, side in got:
        tiles[tile].append((node, side))
    met = Counter()
    for own in tiles.values():
        met.update(tuple(sorted((a, b))) for (a, x), (b, y) in itertools.combinations(own, 2) if x == y == 0 or (x == 2) != (y == 2))
    want = {p for nodes in groups.values() for p in itertools.combinations(nodes, 2)} | {(a, b) for x, y in links for a in groups[x] for b in groups[y]}
    assert set(met) == want and set(met.values()) == {1}
    assert len(got) < 0.3 * sum(len(groups[x]) + len(groups[y]) for x, y in links)


def test_pairs_are_whole_where_places_are_joined(spark, monkeypatch):
    """Places of sets that are too many to be sent, and groups of several blocks and pieces."""
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    rng = np.random.default_rng(12)
    rows = []
    for _ in range(6):
        base = [f"w{x}" for x in rng.integers(0, 400, int(rng.choice([12, 30, 80])))]
        for _ in range(20):
            copy = list(base)
            for at in rng.integers(0, len(base), max(1, len(base) // 12)):
                copy[at] = f"w{rng.integers(0, 400)}"
            rows.append((len(rows), " ".join(copy), "en", "a", 0))
    rows += [(1000 + k, rows[k][1], "en", "a", 0) for k in range(0, 120, 5)]
    docs = spark.createDataFrame(rows, DOCS)
    same(expanded(ngram_join.similar_sets(docs)), brute_pairs(rows))
    same(ngram_join.linked_documents(docs).collect(), brute_links(rows))


def test_one_of_each_group_stays(docs, wide, none, rows):
    low = {}
    for a, b, _ in sorted(brute_pairs(rows)):
        low[b] = min(low.get(a, a), low.get(b, b))
    want = [r for r in rows if r[0] is None or low.get(r[0], r[0]) == r[0]]
    same(ngram_join.drop_near_duplicates(docs).collect(), want)
    kept = ngram_join.drop_near_duplicates(wide)
    assert kept.columns == wide.columns
    same([r[:5] for r in kept.collect()], want)
    assert {r["_gone"] for r in kept.collect()} == {"own _gone"}
    assert ngram_join.drop_near_duplicates(none).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in ngram_join.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}


# 4. Decontamination


def brute_passages(rows, items, window=8, least=3):
    out = []
    for doc, text, *_ in rows:
        w = words(text)
        spans, at = [], 0
        for m in re.finditer(r"[^\W_]+", text or ""):
            spans.append(m.span())
        for item, body in items:
            v = words(body)
            n = min(window, len(v))
            if item is None or body is None or len(v) < least:
                continue
            known = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            hits = [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in known]
            at = 0
            while at < len(hits):
                end = at
                while end + 1 < len(hits) and hits[end + 1] <= hits[end] + n:
                    end += 1
                out.append((doc, item, spans[hits[at]][0], spans[hits[end] + n - 1][1], hits[end] + n - hits[at]))
                at = end + 1
    return out


def test_passages(docs, wide, none, rows, benchmark):
    items = [tuple(r) for r in benchmark.collect()]
    want = brute_passages([r for r in rows if "①" not in (r[1] or "")], items)
    want.append((11, 7, 0, 9, 3))
    same(decontaminate.passages(docs, benchmark).collect(), want)
    same(decontaminate.passages(wide, benchmark.withColumn("doc_id", F.lit(0))).collect(), want)
    assert decontaminate.passages(none, benchmark).collect() == decontaminate.passages(docs, benchmark.limit(0)).collect() == []


def test_a_large_benchmark_takes_several_scans(docs, rows, benchmark, monkeypatch):
    whole, left = decontaminate.passages(docs, benchmark).collect(), decontaminate.drop_contaminated(docs, benchmark).collect()
    monkeypatch.setattr(decontaminate, "AUTOMATON_CHARS", 40)
    same(decontaminate.passages(docs, benchmark).collect(), whole)
    same(decontaminate.drop_contaminated(docs, benchmark).collect(), left)


def test_contaminated_go(docs, wide, none, rows, benchmark):
    bad = {r[0] for r in decontaminate.passages(docs, benchmark).where("doc_id IS NOT NULL").collect()}
    want = [r for r in rows if r[0] not in bad and not (r[0] is None and r[1])]
    same(decontaminate.drop_contaminated(docs, benchmark).collect(), want)
    kept = decontaminate.drop_contaminated(wide, benchmark)
    assert kept.columns == wide.columns and kept.count() == len(want)
    assert decontaminate.drop_contaminated(docs, benchmark.limit(0)).count() == len(rows)


def test_another_benchmark_is_another_automaton(spark, docs):
    for word in ("two words more", "Ünï ça 中文"):
        one = spark.createDataFrame([(1, word)], "item_id bigint, text string")
        assert decontaminate.passages(docs, one).count() == len(brute_passages([], [])) + (word != "two words more")


# 7. Quality rules


def brute_rules(rows):
    table = quality_rules.class_table()
    vocabulary, refs, own = dict(quality_rules.COMMON_WORDS), defaultdict(Counter), []
    for lang in {r[2] for r in rows} - {None, *vocabulary}:
        n = Counter(w for r in rows if r[2] == lang for w in words(r[1]))
        if n:
            vocabulary[lang] = tuple(sorted(n, key=lambda w: (-n[w], w))[:12])
    for _, text, lang, *_ in rows:
        lang = lang if lang in vocabulary else "*"
        c = Counter(int(table[ord(x)]) for x in text or "")
        known = vocabulary.get(lang, ())
        w = Counter(known.index(x) if x in known else len(known) for x in words(text)) if known else Counter()
        own.append((lang, c, w))
        refs["c", lang] += c
        refs["w", lang] += w
    total = sum((v for (kind, _), v in refs.items() if kind == "c"), Counter())
    refs["c", "*"] = total

    def distance(p, q, bins):
        p, q = ({k: x[k] / max(sum(x.values()), 1) for k in range(bins)} for x in (p, q))
        part = lambda a, b: sum(a[k] * np.log2(2 * a[k] / (a[k] + b[k])) for k in range(bins) if a[k])
        return max((part(p, q) + part(q, p)) / 2, 0) ** 0.5

    for (_, text, *_), (lang, c, w) in zip(rows, own, strict=True):
        n, m = sum(c.values()), sum(w.values())
        if not words(text):
            yield None, None, "empty"
            continue
        dc = distance(c, refs["c", lang], 8) if n >= 100 else None
        dw = distance(w, refs["w", lang], 13) if lang != "*" and m >= 60 else None
        over = [d is not None and d > a + b / size**0.5 for d, (a, b), size in ((dc, quality_rules.CHAR_BOUND, max(n, 1)), (dw, quality_rules.WORD_BOUND, max(m, 1)))]
        dc, dw = (None if d is None else round(float(d), 6) for d in (dc, dw))
        yield dc, dw, "characters" if over[0] else "words" if over[1] else "keep"


def test_rules(docs, wide, none, rows):
    own = [*rows, (90, "a!!! ### " * 60, "en", "a", 0), (91, "the w123 w345 " * 100, "en", "a", 0)]
    own += [(92 + k, "la %d sol %s " % (k, "mar" * (k % 3)) * 30, "it", "a", 0) for k in range(8)] + [(105, "w9 w8 w7 " * 90, "it", "a", 0)]
    more = docs.sparkSession.createDataFrame(own, DOCS)
    want = list(brute_rules(own))
    got = quality_rules.judge(more)
    same([(*r[:5], *r[5:]) for r in got.collect()], [(*a, *b) for a, b in zip(own, want, strict=True)])
    assert {"characters", "words", "keep", "empty"} == {b[2] for b in want} and want[-1][2] == "words"
    same(quality_rules.drop_rejected(more).collect(), [a for a, b in zip(own, want, strict=True) if b[2] == "keep"])
    kept = quality_rules.drop_rejected(wide)
    assert kept.columns == wide.columns and {r["verdict"] for r in kept.collect()} == {"own verdict"}
    judged = quality_rules.judge(wide).collect()
    assert {r["_judged"] for r in judged} == {"own _judged"} and {r["verdict"] for r in judged} <= {"keep", "empty", "characters", "words"}
    assert quality_rules.judge(none).columns == got.columns and quality_rules.judge(none).collect() == []


# 8. Mixing


def brute_mixture(rows, weights, fraction):
    import hashlib

    queues, out = defaultdict(list), []
    for doc, text, _, source, _ in rows:
        source = source or mixing.NONE
        n = len(re.findall(r"[^ \t\n\r\f]+", text or ""))
        key = hashlib.md5(f"mix:{'' if doc is None else doc}".encode()).hexdigest()
        if weights.get(source, 1.0) > 0:
            queues[source].append((key, doc is not None, doc or 0, n, doc))
    for source, own in queues.items():
        run = 0
        for key, has, k, n, doc in sorted(own, key=lambda x: x[:4]):
            run += n
            out.append((run / weights.get(source, 1.0), key, has, k, n, doc, source))
    out.sort()
    budget, run, taken = int(fraction * sum(x[4] for x in out)), 0, []
    for place, (finish, _, _, _, n, doc, source) in enumerate(out, 1):
        run += n
        if run > budget:
            break
        taken.append((doc, source, n, round(finish, 6), place))
    return taken


@pytest.mark.parametrize("fraction", [0.0, 0.02, 0.5, 1.0])
def test_mixture(docs, wide, rows, fraction):
    weights = {"a": 0.5, "b": 3.0}
    want = brute_mixture(rows, weights, fraction)
    assert [tuple(r) for r in mixing.mixture(docs, weights, budget_fraction=fraction).collect()] == want
    kept = mixing.take_mixture(wide, weights, budget_fraction=fraction)
    assert kept.columns == wide.columns
    same([(r["doc_id"],) for r in kept.collect()], [(w[0],) for w in want])
    assert {r["_source"] for r in kept.collect()} <= {"own _source"}


def test_mixture_leaves_out_and_of_nothing(docs, none):
    assert {r["source"] for r in mixing.mixture(docs, {"a": 0.0}, budget_fraction=1.0).collect()} == {"b", mixing.NONE}
    assert mixing.mixture(none).collect() == mixing.take_mixture(none).collect() == []


def test_mixture_follows_the_weights(spark):
    rows = [(k, prose(k, 20), "en", "ab"[k % 2], 0) for k in range(600)]
    got = Counter(r["source"] for r in mixing.mixture(spark.createDataFrame(rows, DOCS), {"a": 1.0, "b": 3.0}, budget_fraction=0.4).collect())
    assert abs(got["b"] - 3 * got["a"]) <= 4


def test_ranges_are_equally_full_whatever_the_weights(spark):
    rows = [(k, "one two", "en", "a" if k % 100 == 0 else "b" if k % 3 else "c", 0) for k in range(4000)]
    weights = {"a": 1e-5, "b": 1e5}
    df = spark.createDataFrame(rows, DOCS)
    for fraction in (0.3, 0.999):
        assert [tuple(r) for r in mixing.mixture(df, weights, budget_fraction=fraction).collect()] == brute_mixture(rows, weights, fraction)


# 2. Sharding


def test_sharding(spark, docs, wide, none, rows):
    import hashlib

    slot = lambda d: int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:3], 16)
    got = sharding.shard_documents(docs).collect()
    same([(*r[:5], r["slot"]) for r in got], [(*r, slot(r[0])) for r in rows])
    assert {r["map_version"] for r in got} == {2} and all(0 <= r["shard"] < sharding.SHARDS for r in got)
    loads = {r["slot"]: (r["records"], r["bytes"]) for r in sharding.slot_loads(docs).collect()}
    want = defaultdict(lambda: [0, 0])
    for r in rows:
        want[slot(r[0])][0] += 1
        want[slot(r[0])][1] += len((r[1] or "").encode())
    assert loads == {k: tuple(v) for k, v in want.items()}
    clash = sharding.shard_documents(wide).collect()
    assert {r["_slot"] for r in clash} == {"own _slot"} and Counter(r["slot"] for r in clash) == Counter(slot(r[0]) for r in rows)
    assert sharding.shard_documents(none).collect() == []


def test_the_map_is_kept_and_edited(spark, tmp_path, rows):
    many = [(k, "x" * (1 + k % 50), "en", "a", 0) for k in range(9000)]
    folder = f"{tmp_path}/map"
    place = lambda d, **k: {r["doc_id"]: (r["shard"], r["map_version"]) for r in sharding.shard_documents(spark.createDataFrame(d, DOCS), folder=folder, **k).collect()}
    first, second = place(many), place(many)
    assert {v for _, v in first.values()} == {2} and {v for _, v in second.values()} == {3}
    moved = sum(first[k][0] != second[k][0] for k in first) / len(many)
    assert moved < 0.05
    fewer = place(many[:4000], shards=12)
    assert {v for _, v in fewer.values()} == {4} and max(s for s, _ in fewer.values()) == 11
    assert sharding.SlotMap.load(spark, folder, 1).version == 1


def test_slot_map_is_edited_little_and_balances(spark, tmp_path):
    rng = np.random.default_rng(3)
    load = rng.pareto(1.5, sharding.SLOTS).astype(np.int64) + 1
    load[:300] *= 50  # one shard's slots are heavy
    first = sharding.SlotMap.initial()
    second = first.edited(load, first.shards)
    held = np.bincount(second.shard, load, minlength=16)
    assert held.max() <= 1.15 * held.mean() + load.max() and np.bincount(first.shard, load).max() > 2 * held.mean()
    assert (second.shard != first.shard).mean() < 0.5
    fewer = second.edited(load, 12)
    assert fewer.shard.max() == 11 and fewer.version == 3
    for m in (first, second):
        m.save(spark, f"{tmp_path}/map")
    again = sharding.SlotMap.load(spark, f"{tmp_path}/map")
    assert again.version == 2 and (again.shard == second.shard).all()
    assert (sharding.SlotMap.load(spark, f"{tmp_path}/map", 1).shard == first.shard).all()
    with pytest.raises(Exception, match="exist"):
        second.save(spark, f"{tmp_path}/map")


# 3. WARC

PAGES = [(1, "http://a/1", "<p>x</p>"), (2, None, None), (None, "u", "null id"), (3, "odd\r\nInjected: 1", ""), (3, "odd\r\nInjected: 1", ""), (4, "ü", "é" * 300_000), (5, "", "\r\n\r\n")]


def test_bundle_files(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").repartition(2)
    packed = warc.bundles(pages, frame_bytes=200, bundle_bytes=300)
    warc.write_files(packed, f"{tmp_path}/w")
    ids = spark.createDataFrame([(3,), (4,), (99,), (None,), (3,)], "page_id bigint")
    same(warc.fetch_files(spark, f"{tmp_path}/w", ids).collect(), [p for p in PAGES if p[0] in (3, 4)])
    names = [r["bundle_id"] for r in packed.collect()]
    assert len(set(names)) == len(names) and sorted(names) == sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/w/bundles").select("bundle_id").collect())
    own = [re.search(rb"urn:uuid:[^>]+", warc.read_frame(bytes(b["payload"]), r["frame"])[r["start"] :])[0] for b in packed.collect() for r in b["records"]]
    assert len(set(own)) == len(PAGES)


def test_bundles_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("records", F.lit(1))
    packed = warc.bundles(pages.repartition(2), frame_bytes=200, bundle_bytes=300)
    same(warc.fetch(packed).collect(), PAGES)
    ids = spark.createDataFrame([(3,), (4,), (99,)], "page_id bigint")
    same(warc.fetch(packed, ids).collect(), [p for p in PAGES if p[0] in (3, 4)])
    for b in packed.collect():
        whole = b"".join(warc.read_frame(bytes(b["payload"]), k) for k in range(b["n_frames"]))
        reader = zstandard.ZstdDecompressor().stream_reader(bytes(b["payload"]), read_across_frames=True)
        assert reader.read() == whole and len(whole) == b["raw_bytes"]
        places = warc.frame_places(bytes(b["payload"]))
        for r in b["records"]:
            assert warc.read_record(bytes(b["payload"]), r["frame"], r["start"], r["length"])[0] == r["page_id"] and r["start"] + r["length"] <= places[r["frame"]][2]
    assert warc.bundles(pages.limit(0)).collect() == []
    with pytest.raises(ValueError, match="seek table"):
        warc.frame_places(b"x" * 20)


# 6. HTML extraction


def brute_region(page, w):
    own = [(a, b, len(page[a:b].split()) * w.word if t is None else 0.0 if t == html_extract.MARK else w.tag(t), t is None and bool(page[a:b].strip())) for a, b, t in html_extract.segments(page)]
    best = (0.0, 0, 0)
    for i, (a, _, _, text) in enumerate(own):
        run = 0.0
        for _, b, s, _ in own[i:] if text else ():
            run += s
            if run > best[0] + 1e-9:
                best = run, a, b
    return best


def test_best_region_is_the_best():
    rng = np.random.default_rng(1)
    for _ in range(200):
        page = "".join(rng.choice(["<p>", "</p>", "<div>", "</div>", "<a href='x'>", "</a>", "some words here", " one ", "<!-- a b -->", "<script>var a = '<p>'</script>", "<br/>", "&amp; z"], 30))
        w = html_extract.Weights(1.0, -2.0, {"p": -0.5, "a": -4.0})
        start, stop, score = html_extract.best_region(page, w)
        assert abs(score - brute_region(page, w)[0]) < 1e-6
        assert not score or abs(sum(len(page[a:b].split()) if t is None else w.tag(t) for a, b, t in html_extract.segments(page) if start <= a < stop) - score) < 1e-6


def brute_segments(page):
    """One character after the other."""
    at = begin = 0
    while at < len(page):
        low = page[at:].lower()
        if page[at] != "<" or at + 1 == len(page) or not (page[at + 1] in "/!?" or page[at + 1].isascii() and page[at + 1].isalpha()):
            at += 1
            continue
        if at > begin:
            yield begin, at, None
        raw = next((n for n in ("script", "style") if low.startswith("<" + n) and not (low[len(n) + 1 :][:1].isalnum() or low[len(n) + 1 :][:1] == "_")), None)
        letter = low[1:2].isalpha() or low[1:2] == "/" and low[2:3].isascii() and low[2:3].isalpha()
        name = raw or (re.match(r"/?[^\s/>]*", low[1:])[0].lstrip("/") if letter else "!")
        if low.startswith("<!--"):
            end = low.find("-->", 4)
            end = len(page) if end < 0 else at + end + 3
        elif raw:
            m = re.search(rf"</{raw}\s*>", low)
            end = at + m.end() if m else len(page)
        else:
            end = at + 1 + (len(re.match(r"/?[^\s/>]*", low[1:])[0]) if letter else 0)
            while end < len(page) and page[end] != ">":
                end += 1
                if letter and page[end - 1] == "=":
                    quote = end + len(page[end:]) - len(page[end:].lstrip())
                    close = page.find(page[quote], quote + 1) if page[quote : quote + 1] in ('"', "'") and quote < len(page) else -1
                    end = close + 1 if close > 0 else quote
            end = min(end + 1, len(page))
        yield at, end, name
        at = begin = end
    if begin < len(page):
        yield begin, len(page), None


def test_tokens():
    for page, text in (("<p>if a < b then keep all these words here</p>", "if a < b then keep all these words here"), ('<a title="x > y">link</a> text', "link text")):
        assert html_extract.region_text(page, 0, len(page)) == text
    draw = np.random.default_rng(2)
    parts = ["<", ">", "</", "a", "b ", "=", '"', "'", " = ", "<p", "<a href='x>'", '<i t="', "<!--", "-->", "<!", "<?", "<script>", "</script >", "<Style", "1 < 2", "</p>", "/", "<br/>", "é", "< p>"]
    for _ in range(3000):
        page = "".join(draw.choice(parts, draw.integers(1, 14)))
        assert list(html_extract.segments(page)) == list(brute_segments(page)), page


def test_extraction_defined_cases(spark):
    pages = [(1, None), (2, ""), (3, "<div><a>x</a></div>"), (4, "<b " + "x" * 10), (None, "plain words only"), (5, "<p>" + "long words " * 200_000 + "</p>"), (6, "<script>never words"), (6, "<script>never words")]
    df = spark.createDataFrame(pages, "page_id bigint, html string").withColumn("content", F.lit(1))
    got = sorted(html_extract.extract(df).collect(), key=str)
    by = {r["page_id"]: r for r in got}
    assert len(got) == 8 and by[1]["content"] is None and by[1]["score"] is None and by[2]["content"] == "" == by[6]["content"] == by[4]["content"]
    assert by[None]["content"] == "plain words only" and by[5]["words"] == 400_000
    assert html_extract.extract(df.limit(0)).collect() == []


def test_extraction_finds_held_out_articles(spark, sf):
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").collect() if html_extract.marked(r["html"] or "")]
    if len(pages) >= 10:
        w = html_extract.fit(pages[::2])
        assert np.mean([html_extract._overlap(p, html_extract.marked(p), w) for p in pages[1::2]]) > 0.85


# 9. Chat formatting

TURNS = [(1, 2, "user", "b"), (1, 1, "system", "é中"), (1, None, None, None), (1, 2, "assistant", "b"), (None, 1, "user", "x"), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (None, 0, "user", "y"), (3, 1, "user", "long " * 200_000)]


def test_chats(spark):
    turns = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string")
    first = lambda x: (x is not None, x if x is not None else "")
    groups = defaultdict(list)
    for c, t, r, x in TURNS:
        groups[c].append(((t is not None, t or 0), first(r), first(x)))
    want = []
    for c, own in groups.items():
        text = "".join(f"<|im_start|>{r[1] if r[0] else 'unknown'}\n{x[1]}<|im_end|>\n" for _, r, x in sorted(own))
        want.append((c, len(own), text, len(text.encode()), sum(len(x[1].encode()) for _, r, x in own if r[1] == "assistant")))
    same(chat_format.format_chats(turns.withColumns({"n_turns": F.lit(0), "start": F.lit(0)})).collect(), want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    same(chat_format.format_chats(turns).collect(), want)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert chat_format.format_chats(turns.limit(0)).collect() == []


# 1. Language identification


def test_presence_is_the_set_of_grams():
    for text in ("", "a", "Ab, ça!", "x" * 50_000 + " y"):
        alone = langid.presence(kernels.Slab([text]))[0]
        pair = langid.presence(kernels.Slab(["other", text, "z"]))[1]
        assert (alone == pair).all() and bool(alone.sum()) == bool(words(text))
    assert langid.presence(kernels.Slab(["abab"])).sum() == len({"a", "b", "ab", "ba", "aba", "bab"})


def test_scores_are_those_of_dense_algebra(monkeypatch):
    """Kernels from sets of n-grams, and the ridge solved in the landmarks' coefficients instead of Nyström features."""
    monkeypatch.setattr(langid, "DIMENSIONS", 1 << 18)
    rng = np.random.default_rng(4)
    alphabet = {"a": "abcde ", "b": "cdefg ", "c": "efghi "}
    texts, langs = zip(*(("".join(rng.choice(list(alphabet[k]), 30)) + k, k) for _ in range(8) for k in alphabet), strict=True)
    sets = []
    for t in texts:
        s = " ".join(words(t))
        sets.append({s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)} - {" "})
    places = langid.presence(kernels.Slab(list(texts)))
    assert [int(r.sum()) for r in places] == [len(s) for s in sets]  # no two of these n-grams share a place
    k = np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets])
    model = langid.fit(list(texts), list(langs))
    n = len(texts)  # fewer than LANDMARKS, so each text is one
    kb, y = np.hstack([k, np.ones((n, 1))]), np.where(np.array(langs)[:, None] == np.array(sorted(alphabet)), 1.0, -1.0)
    penalty = np.zeros((n + 1, n + 1))
    penalty[:n, :n] = langid.RIDGE * n / n * k
    penalty[-1, -1] = 1e-9
    solved = np.linalg.lstsq(kb.T @ kb + penalty, kb.T @ y, rcond=None)[0]
    assert np.allclose(model.scores(places), kb @ solved, atol=2e-3)


def test_every_language_has_a_landmark(monkeypatch):
    monkeypatch.setattr(langid, "LANDMARKS", 2)
    texts = {lang: " ".join(f"{a}{b}" for a in lang for b in lang[::-1]) for lang in ("abc", "def", "ghi", "jkl", "mno")}
    model = langid.fit([t for t in texts.values() for _ in range(3)], [x for x in texts for _ in range(3)])
    assert len(model.landmarks) == 5
    got = model.scores(langid.presence(kernels.Slab(list(texts.values())))).argmax(axis=1)
    assert [model.languages[k] for k in got] == list(texts)


def test_held_out_languages(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars >= 200")
    model = langid.fit_model(d.where("doc_id % 2 = 0"))
    got = langid.identify(d.where("doc_id % 2 = 1"), model).collect()
    assert np.mean([r["lang"] == r["predicted"] for r in got]) > 0.95


def test_language_defined_cases(docs, wide, none, rows):
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[0]["predicted"] == by[1]["predicted"] == by[3]["predicted"] == "und" and by[0]["margin"] is None
    same(langid.identify(wide).collect(), got)
    assert langid.identify(none).collect() == []
    only = docs.where("lang = 'de'")
    assert {r["predicted"] for r in langid.identify(only).collect()} <= {"de", "und"}
    assert {r["predicted"] for r in langid.identify(docs.withColumn("lang", F.lit(None))).collect()} == {"und"}


# 10. Quality classifier


def test_rules_in_spark_are_those_in_numpy(spark, sf):
    d, l = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = rule_ensemble.fit_ensemble(d.where("doc_id % 2 = 0"), l)
    stats = rule_ensemble.statistics(F.col("text"))
    table = d.select("doc_id", *(c.alias(n) for n, c in stats.items())).orderBy("doc_id").collect()
    want = model.probability(np.array([tuple(r)[1:] for r in table], float))
    got = rule_ensemble.score(d, model).orderBy("doc_id").collect()
    assert np.allclose([r["probability"] for r in got], want, atol=1e-6)
    known = {r["doc_id"]: r["quality"] for r in l.collect()}
    held = [(r["keep"], known[r["doc_id"]]) for r in got if r["doc_id"] % 2 and r["doc_id"] in known]
    assert np.mean([k == bool(q) for k, q in held]) > 0.85


def test_classifier_defined_cases(spark, docs, wide, none, rows):
    labels = spark.createDataFrame([(1, 0), (8, 1), (8, 0), (9, 1), (12, 1), (None, 1), (3, None), (999, 0), (3, 0)], "doc_id bigint, quality int")
    got = rule_ensemble.classify(docs, labels).collect()
    assert len(got) == len(rows)
    same(rule_ensemble.classify(wide, labels.withColumn("text", F.lit(1))).collect(), got)
    assert all(r["keep"] for r in rule_ensemble.classify(docs, labels.limit(0)).collect())
    assert not any(r["keep"] for r in rule_ensemble.classify(docs, labels.where("quality = 0")).collect())
    assert rule_ensemble.classify(none, labels).collect() == []


def test_lasso_leaves_out_noise():
    rng = np.random.default_rng(0)
    x = rng.random((600, 6))
    model = rule_ensemble.fit(x, (x[:, 2] > 0.6).astype(float), list("abcdef"))
    assert all(2 in {k for k, _, _ in rule} for rule, w in zip(model.rules, model.weights, strict=True) if abs(w) > 0.5)
    assert len(model.rules) < len(rule_ensemble.tree_rules(x, (x[:, 2] > 0.6).astype(float))) / 2
    assert ((model.probability(x) >= 0.5) == (x[:, 2] > 0.6)).mean() > 0.97


def brute_statistics(text):
    text = text or ""
    n, parts = len(text), re.findall(r"\S+", text)
    kind = lambda test: sum(map(test, text)) / max(n, 1)
    category = unicodedata.category
    shorts = sum(len(w) <= 3 and all(category(c)[0] == "L" for c in w) for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w)
    symbol = lambda c: category(c)[0] not in "LN" and c not in " \t\n\x0b\f\r.,;:!?'\"()-"
    return [n, len(parts), n / max(len(parts), 1), kind(lambda c: category(c) == "Lu"), kind(lambda c: category(c)[0] == "N"), kind(lambda c: c in "!?"), kind(lambda c: c in ".,;:"), kind(symbol), text.count("\n") / max(n, 1), shorts / max(len(parts), 1)]


def test_statistics(spark):
    texts = ["", None, "A be SEE! down, 12 ①.\nx; (y) #€ é", "one one two", "Ünï ça 中文 - a" * 50]
    stats = rule_ensemble.statistics(F.col("t"))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(*(c.alias(n) for n, c in stats.items())).collect()
    assert np.allclose([tuple(r)[:10] for r in got], [brute_statistics(t) for t in texts])
    assert got[3]["repeats"] == 1 / 3


def test_a_tree_splits_where_brute_force_does():
    rng = np.random.default_rng(3)
    x, g = rng.integers(0, 6, (60, 3)).astype(float), rng.normal(size=60)
    cuts = [np.unique(x[:, k]) for k in range(3)]
    best = None
    for k in range(3):
        for c in cuts[k]:
            above = x[:, k] > c
            if 5 <= above.sum() <= 55:
                error = sum(((g[s] - g[s].mean()) ** 2).sum() for s in (above, ~above))
                if best is None or error < best[0] - 1e-9:
                    best = error, k, c
    gain, k, c = rule_ensemble._split(x, g, cuts)
    assert (k, c) == best[1:] and abs(((g - g.mean()) ** 2).sum() - best[0] - gain) < 1e-9


def test_lasso_meets_its_conditions():
    """At the optimum the gradient is -penalty * sign(w) where w isn't 0, within the penalty elsewhere, and 0 for the intercept."""
    rng = np.random.default_rng(6)
    r = (rng.random((200, 8)) > 0.5).astype(float)
    y = (r[:, 0] + 0.3 * rng.normal(size=200) > 0.5).astype(float)
    w, b = rule_ensemble.lasso_logistic(r, y, 0.01, rounds=5000)
    e = (1 / (1 + np.exp(-(r @ w + b))) - y) / len(y)
    slope = r.T @ e
    assert abs(e.sum()) < 1e-5 and np.all(np.abs(slope) <= 0.01 + 1e-5)
    assert np.allclose(slope[w != 0], -0.01 * np.sign(w[w != 0]), atol=1e-5) and 0 < (w != 0).sum() < 8


def test_a_doc_id_of_several_texts_fits_one_model(spark):
    rows = [(k % 40, prose(k, 5 + k % 7), "en", "a", 0) for k in range(120)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, quality int")
    one, other = (rule_ensemble.fit_ensemble(spark.createDataFrame(x, DOCS).repartition(p), labels) for x, p in ((rows, 1), (rows[::-1], 3)))
    assert one == other
