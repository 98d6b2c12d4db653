"""N-gram Jaccard join by PartEnum signatures.

Every document is the set of its distinct word n-grams; a pair joins when the Jaccard similarity of
the two sets is at least ``threshold``. Sets are put into bands of sizes (each band ends where a set
could no longer reach the threshold against the band's start), so joining sets lie in the same or in
neighbouring bands. For each band the largest Hamming distance k of a joining pair is known. The
domain of n-grams is split into n1 partitions of three parts each; where two joining sets differ in
at most one part of a partition, they agree on one of its three subsets of two parts, and the sums of
their hashed members there, the signatures, are the same. In bands up to ``EXACT`` n-grams
n1 = ceil((k + 1) / 2), for which the pigeonhole principle leaves one such partition at least. Sets of
up to ``SMALL`` n-grams take every n-gram as a part of its own: all subsets of the least possible
overlap are enumerated.

Larger sets have up to thousands of partitions, any of which two joining sets share with a fair
chance, so n1 = ceil((k + 1) / 3), of which ``PARTITIONS`` are indexed, and signatures of fewer than
``LEAST_MEMBERS`` n-grams, which say little, are left out. That bounds the signatures of a document by
6 * PARTITIONS however long it is; they find nearly all pairs and gather clusters into groups.

The pairs that share no signature are found by prefixes, so that none is left out. All n-grams have one
order, rare ones first. Of a set of s n-grams the first s - ceil(threshold * s) + 1 are its long prefix,
the first s - ceil(2 * threshold / (1 + threshold) * s) + 1 its short one: two joining sets have an n-gram
of the smaller one's short and the larger one's long prefix in common, whatever the order is. Pairs of groups
that have one in common and no signature are searched, and those sets are candidates whose prefixes share as
many as the threshold needs, given what can follow them. Short prefixes are mostly n-grams of one text only,
which aren't indexed, nor are those that are in no short prefix. N-grams are counted by cells, many more than there
are n-grams; the tables of common ones that are sent have 2 ** ``TABLE_BITS`` bits at most. A crowded
table makes the order worse and the search slower, not less complete. Signatures are counted in the same way, and
those of one text only, which find nothing, aren't written.

Groups that are connected are compared where the larger one is, its host; the smaller one's sets are sent there as guests,
so that a large group is not sent once for each small one it meets.

Candidates are verified on whole sets of 48-bit n-gram hashes. Sets of the same 64-bit fingerprint count
as equal without being compared.

Documents of equal sets are one class of copies and are never expanded into pairs: pairs are between
sets, and a membership says which documents have each set.

Defined results
    null text, empty text, text without a word: no n-gram, in no pair.
    fewer than n words: one n-gram, the whole word sequence.
    null doc_id: in no pair, no row. Rows that repeat a doc_id: one document with each of its sets; its
    links are those of all its sets, so a document that has two similar sets links with itself, too.
    ties (equal sets): similarity 1. Empty table: no row, same columns.
    Other columns are ignored by all but ``drop_near_duplicates``, which keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, ready
from .kernels import mix, slabs, sums

N, THRESHOLD = 2, 0.65
PARTITIONS = 12
SMALL, EXACT = 10, 36
#: Members that a signature needs in sets of at least that many n-grams.
LEAST_MEMBERS, FROM_GRAMS = 3, 24
BLOCK = 256
#: Parts, at least, in which n-grams are counted, and the most bits, as a power of two, of a table of common ones (64 MB).
CELL_PARTS, TABLE_BITS = 64, 29
#: Documents that make an n-gram more common than those of fewer.
COMMON = (2, 4, 8, 16, 32, 64, 256, 1024)
#: Texts of a slab, as a power of two; its numbers, levels of 4 bits and n-grams of 48 share 64 bits.
ROWS = 12
#: Two groups of so many sets at least are compared as a whole; in smaller ones pairs are searched. The results are the same.
WHOLE = 16
#: Ids up to this many are broadcast (16 MB, places of sets 50 MB); more are joined by a shuffle. The results are the same.
BROADCAST_IDS = 2_000_000
_U = np.uint64
_M48 = _U((1 << 48) - 1)


def band_ends(threshold: float) -> np.ndarray:
    """Largest size in each band."""
    ends, at = [], 1
    while at < 1 << 40:
        end = max(at, math.floor(at / threshold + 1e-9))
        ends.append(end)
        at = end + 1
    return np.array(ends, np.int64)


def _signatures(grams: np.ndarray, cuts: np.ndarray, threshold: float, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, signature) of all signatures of the sets between the cuts."""
    size = np.diff(cuts)
    of = np.repeat(np.arange(len(size)), size)
    ends = band_ends(threshold)
    band = np.searchsorted(ends, size)
    docs, sigs = [], []
    h1, h2, h3 = mix(grams + _U(0x51)), mix(grams + _U(0xA7)), mix(grams + _U(0x1D3))
    for step in (0, 1):
        inst = np.minimum(band + step, len(ends) - 1)
        k = np.floor(2 * (1 - threshold) / (1 + threshold) * ends[inst] + 1e-9).astype(np.int64)
        n1 = np.where(ends[inst] <= EXACT, (k + 2) // 2, (k + 3) // 3)
        p = (h1 % n1[of].astype(_U)).astype(np.int64)
        use = np.flatnonzero((p < partitions) & (size[of] >= math.ceil(threshold * (SMALL + 1))))
        cell = (of[use] * partitions + p[use]) * 3 + (h2[use] % _U(3)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell, value = cell[order], h3[use][order]
        if not len(cell):
            continue
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        total = np.add.reduceat(value, starts)
        at, inv = np.unique(cell[starts] // 3, return_inverse=True)
        parts, held = np.zeros((len(at), 3), _U), np.zeros((len(at), 3), np.int64)
        parts[inv, cell[starts] % 3] = total
        held[inv, cell[starts] % 3] = np.diff(np.append(starts, len(cell)))
        doc, part = at // partitions, at % partitions
        least = np.where(size[doc] >= FROM_GRAMS, LEAST_MEMBERS, 1)
        for a, b in ((0, 1), (0, 2), (1, 2)):
            some = held[:, a] + held[:, b] >= least
            tag = (inst[doc] * partitions + part).astype(_U) * _U(3) + _U(a + b)
            s = mix(mix(parts[:, a] * _U(0x9E3779B97F4A7C15) + parts[:, b]) + tag * _U(0xC2B2AE3D27D4EB4F))
            docs.append(doc[some])
            sigs.append(s[some])
    for i in np.flatnonzero((size > 1) & (size <= SMALL)):
        g = h3[cuts[i] : cuts[i + 1]]
        own = []
        for larger in range(int(size[i]), min(SMALL, math.floor(size[i] / threshold + 1e-9)) + 1):
            least = math.ceil(threshold * larger - 1e-9)
            own += [int(sum(map(int, c)) + (larger << 56) + 0x77) & 0xFFFFFFFFFFFFFFFF for c in combinations(g, least)]
        docs.append(np.full(len(own), i))
        sigs.append(mix(np.array(own, _U)))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    return np.concatenate(docs), np.concatenate(sigs)


def _print_of(grams: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set; equal sets, and only they but for chance, have the same."""
    a, b = sums(mix(grams + _U(0x2545F491)), cuts), sums(mix(grams + _U(0x7F4A7C15)), cuts)
    return mix(a ^ mix(b + np.diff(cuts).astype(_U)))


def _cell_counter(n: int, bits: int, parts: int, hashes: Callable) -> Callable:
    """(part, cells, counts): in how many texts of this task the hashes of each cell are; cells as differences, by byte planes, which compress."""
    wide = bits - parts.bit_length() + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            cell, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            cuts = np.searchsorted(cell, np.arange(parts + 1, dtype=np.uint64) << _U(wide))
            some = [k for k in range(parts) if cuts[k] < cuts[k + 1]]
            steps = [np.diff((cell[cuts[k] : cuts[k + 1]] - (_U(k) << _U(wide))).astype(np.uint32), prepend=np.uint32(0)) for k in some]
            cells = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes() for x in steps]
            counts = [np.minimum(count[cuts[k] : cuts[k + 1]], 255).astype(np.uint8).tobytes() for k in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(cells, pa.binary()), pa.array(counts, pa.binary())], ["part", "cells", "counts"])

        for batch in batches:
            for _, slab in slabs(batch.column(0).to_pylist(), rows=1 << ROWS):
                held.append(hashes(*slab.gram_sets(n)) & _U((1 << bits) - 1))
                if sum(map(len, held)) > 1 << 22:
                    yield out()
        if sum(map(len, held)):
            yield out()

    return run


def _cell_adder(wide: int, least: tuple[int, ...], slices: list[int]) -> Callable:
    """(part, level, slice) of rows sorted by part: for each number of texts in ``least`` one bit for cells that are in so many; several cells share a bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> pa.RecordBatch:
            cell, count = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(cell)
            cell = cell[order]
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            cell, total = cell[starts], np.add.reduceat(count[order].astype(np.int64), starts)
            bits = []
            for few, own in zip(least, slices, strict=True):
                table = np.zeros(1 << own, bool)
                table[cell[total >= few] >> np.uint32(wide - own)] = True
                bits.append(np.packbits(table, bitorder="little").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([at] * len(least), pa.int32()), pa.array(range(len(least)), pa.int32()), pa.array(bits, pa.binary())], ["part", "level", "slice"])

        for batch in batches:
            for part, cells, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    if at is not None:
                        yield out()
                    at, held = part, []
                steps = np.ascontiguousarray(np.frombuffer(cells, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
                held.append((np.cumsum(steps, dtype=np.uint32), np.frombuffer(counts, np.uint8)))
        if at is not None:
            yield out()

    return run


def _common(texts: DataFrame, n: int, chars: int, least: tuple[int, ...], hashes: Callable) -> tuple[int, list[np.ndarray]]:
    """How common hashes are, where ``hashes`` gives the distinct ones of each text: the bits of a cell's number, and for each of ``least`` a table of bits.

    Cells are many more than n-grams, and they and the parts in which they are counted grow with the texts; only the tables are bounded.
    """
    bits = min(max(chars.bit_length() + 3, 24), 44)
    log = min(max((chars >> 24).bit_length(), CELL_PARTS.bit_length() - 1), bits - 12)
    tables = [min(max(chars.bit_length() - 3, 18), TABLE_BITS) - k for k in range(len(least))]
    slices = [max(min(t - log, bits - log), 3) for t in tables]
    cells = texts.select("text").mapInArrow(_cell_counter(n, bits, 1 << log, hashes), "part int, cells binary, counts binary")
    added = cells.repartition(1 << log, "part").sortWithinPartitions("part").mapInArrow(_cell_adder(bits - log, least, slices), "part int, level int, slice binary")
    out = [np.zeros((1 << log, (1 << own) // 8), np.uint8) for own in slices]
    for part, level, own in added.collect():
        out[level][part] = np.frombuffer(own, np.uint8)
    return bits, [x.ravel() for x in out]


def _level(table: tuple[int, list[np.ndarray]], hashes: np.ndarray) -> np.ndarray:
    """In how many tables each hash is before the first that lacks it."""
    bits, tables = table
    cell = hashes & _U((1 << bits) - 1)
    level, rest = np.zeros(len(hashes), np.uint8), np.arange(len(hashes))
    for own in tables:
        at = cell[rest] >> _U(bits - (8 * len(own)).bit_length() + 1)
        rest = rest[(own[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & np.uint8(1)).astype(bool)]
        level[rest] += np.uint8(1)
    return level


def _prefix_length(size: np.ndarray, share: float) -> np.ndarray:
    return size - np.ceil(share * size - 1e-9).astype(np.int64) + 1


def _prefixes(grams: np.ndarray, cuts: np.ndarray, threshold: float, table: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the set, code, whether it is in the short prefix) of the n-grams in prefixes that other texts may hold, and the last codes of each short and long prefix.

    Codes are in the order of n-grams.
    """
    size = np.diff(cuts)
    of = np.repeat(np.arange(len(size)), size)
    code = np.sort(of.astype(_U) << _U(64 - ROWS) | _level(table, grams).astype(_U) << _U(48) | grams) & _U((1 << 64 - ROWS) - 1)
    ends = [cuts[:-1] + _prefix_length(size, share) for share in (2 * threshold / (1 + threshold), threshold)]
    soon, last = np.zeros(len(size), _U), np.zeros(len(size), _U)
    soon[size > 0], last[size > 0] = (code[x[size > 0] - 1] for x in ends)
    # Two sets of up to SMALL n-grams are found by their subsets; smaller ones than this join no larger set.
    at = np.arange(len(code))
    use = np.flatnonzero((at < ends[1][of]) & (code > _M48) & (size[of] >= math.ceil(threshold * (SMALL + 1) - 1e-9)))
    return of[use], code[use], use < ends[0][of[use]], soon, last


def _lists(doc: np.ndarray, value: np.ndarray, n: int) -> pa.Array:
    """One list for each of n sets."""
    order = np.argsort(doc, kind="stable")
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[order], np.arange(n + 1)), pa.int32()), pa.array(value[order].view(np.int64)))


def _chars(texts: DataFrame) -> int:
    return int(texts.agg(F.sum(F.length("text"))).first()[0] or 0)


def _prefix_tables(texts: DataFrame, n: int, threshold: float) -> tuple[object, object]:
    """Broadcast tables: how common the n-grams are in texts, which gives their order, and which codes are in a short prefix."""
    chars = _chars(texts)
    send = texts.sparkSession.sparkContext.broadcast
    order = send(_common(texts, n, chars, COMMON, lambda grams, cuts: grams))

    def short(grams: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        _, code, early, _, _ = _prefixes(grams, cuts, threshold, order.value)
        return mix(code[early])

    return order, send(_common(texts, n, chars, (1,), short))


def _signature_table(texts: DataFrame, n: int, threshold: float, partitions: int) -> object:
    """A broadcast table of the signatures that several texts have."""
    return texts.sparkSession.sparkContext.broadcast(_common(texts, n, _chars(texts), (2,), lambda grams, cuts: _signatures(grams, cuts, threshold, partitions)[1]))


def _signer(n: int, threshold: float, partitions: int, order: object, held: object, several: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for start, slab in slabs(batch.column(1).to_pylist(), rows=1 << ROWS):
                grams, cuts = slab.gram_sets(n)
                doc, sig = _signatures(grams, cuts, threshold, partitions)
                some = _level(several.value, sig) > 0
                at, code, _, soon, last = _prefixes(grams, cuts, threshold, order.value)
                met = _level(held.value, mix(code)) > 0
                full = np.flatnonzero(np.diff(cuts))
                columns = [pa.array(_print_of(grams, cuts).view(np.int64)), pa.array(np.diff(cuts)), pa.array(soon.view(np.int64)), pa.array(last.view(np.int64)), _lists(at[met], code[met], len(cuts) - 1), _lists(doc[some], sig[some], len(cuts) - 1)]
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(cuts) - 1), *columns], ["doc_id", "node", "grams", "soon", "last", "prefix", "sigs"]).take(pa.array(full))

    return run


def _packed(grams: np.ndarray) -> bytes:
    """N-grams by their 6 bytes."""
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(members: bytes) -> np.ndarray:
    out = np.zeros((len(members) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(members, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _set_reader(n: int) -> Callable:
    """The sets of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, slab in slabs(batch.column(0).to_pylist()):
                grams, cuts = slab.gram_sets(n)
                pick = np.flatnonzero(np.diff(cuts))
                if len(pick):
                    node = _print_of(grams, cuts).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(node[pick]), pa.array([_packed(grams[cuts[i] : cuts[i + 1]]) for i in pick], pa.binary())], ["node", "members"])

    return run


def _set_sender(n: int, places: object) -> Callable:
    """The sets at their places (a broadcast array sorted by node), each once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = places.value
        sent = np.zeros(len(place), bool)
        for batch in batches:
            for _, slab in slabs(batch.column(0).to_pylist()):
                grams, cuts = slab.gram_sets(n)
                node, first = np.unique(_print_of(grams, cuts).view(np.int64), return_index=True)
                low, high = (np.searchsorted(place["node"], node, side) for side in ("left", "right"))
                pick = np.flatnonzero((low < high) & (np.diff(cuts)[first] > 0))
                pick = pick[~sent[low[pick]]]
                sent[low[pick]] = True
                at = [k for i in pick for k in range(low[i], high[i])]
                if at:
                    members = [_packed(grams[cuts[first[i]] : cuts[first[i] + 1]]) for i in pick]
                    members = pa.array(members, pa.binary()).take(pa.array(np.repeat(np.arange(len(pick)), (high - low)[pick])))
                    own = place[at]
                    yield pa.RecordBatch.from_arrays([*(pa.array(own[c]) for c in ("tile", "node", "side")), members, pa.array(own["copies"])], ["tile", "node", "side", "members", "copies"])

    return run


def _overlaps(sets: list[np.ndarray], hosts: int) -> np.ndarray:
    """Sizes of the intersections of the first sets, the hosts, with all."""
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])[:hosts]
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    shared &= np.bincount(column[of < hosts], minlength=len(value)) > 0
    rank = np.cumsum(shared) - 1
    keep = shared[column]
    of, column = of[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    out = np.zeros((hosts, len(sets)), np.float32)
    for low in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, (low, low + 4096))
        present = np.zeros((len(sets), 4096), np.float32)
        present[of[a:b], column[a:b] - low] = 1
        out += present[:hosts] @ present.T
    return np.rint(out).astype(np.int64)


def _tile_pairs(nodes: np.ndarray, side: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, threshold: float, mode: str) -> list[tuple]:
    """Pairs (node, node, jaccard), or a forest of them; for ``links`` with rows (node, null, links of this tile) besides.

    Sides are sorted. Hosts (0) are compared with one another and with guests (2), hosts of another piece (1) with guests only.
    """
    size, hosts = np.array([len(s) for s in sets]), int((side < 2).sum())
    both = _overlaps(sets, hosts)
    alike = both / (size[:hosts, None] + size[None, :] - both)
    alike[:, :hosts][side[:hosts] > 0] = 0
    a, b = np.nonzero(np.triu(alike >= threshold - 1e-12, 1))
    links = []
    if mode == "links" and len(a):
        n = np.bincount(a, copies[b], len(sets)) + np.bincount(b, copies[a], len(sets))
        some = np.flatnonzero(n)
        links = [(nodes[some], nodes[some], n[some])]
    if mode != "pairs":
        root = list(range(len(sets)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        kept = []
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = find(x), find(y)
            if x != y:
                root[y] = x
                kept.append(i)
        a, b = a[kept], b[kept]
    return links + ([(nodes[a], nodes[b], alike[a, b])] if len(a) else [])


def _verifier(threshold: float, mode: str) -> Callable:
    """Tiles arrive sorted; a tile may span batches. A row of a node with itself has its number of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(rows: list[tuple]) -> list[tuple]:
            node = np.array([r[1] for r in rows], np.int64)
            side = np.array([r[2] for r in rows])
            _, first = np.unique(node, return_index=True)
            if len(first) < 2:
                return []
            first = first[np.argsort(side[first], kind="stable")]
            sets = [_unpacked(rows[i][3]) for i in first]
            copies = np.array([rows[i][4] for i in first], np.float64)
            return _tile_pairs(node[first], side[first], sets, copies, threshold, mode)

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(3)], ["node_a", "node_b", "jaccard"])

        for batch in batches:
            found: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    found += flush(held)
                    held = []
                held.append(row)
            if found:
                yield out(found)
        if held and (found := flush(held)):
            yield out(found)

    return run


def _missed(signed: DataFrame, placed: DataFrame, links: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of large groups (key_a, key_b), and of sets in other groups (node_a, node_b), that may join though no signature connects them.

    A set that is in no group is a group by itself.
    """
    nodes = signed.where(F.size("prefix") > 0).groupBy("node").agg(*(F.first(c).alias(d) for c, d in (("grams", "size"), ("soon", "soon"), ("last", "last"), ("prefix", "prefix"))))
    nodes = checkpoint(nodes.join(placed.select("node", "key"), "node", "left").withColumn("key", F.coalesce("key", "node")))
    posts = nodes.select("node", "key", "size", "soon", "last", F.explode("prefix").alias("code"))
    several = posts.groupBy("code").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.max(F.col("code") <= F.col("soon")).alias("early")).where("low <> high AND early")
    several = checkpoint(several.select("code"))
    posts = checkpoint(posts.join(F.broadcast(several) if several.count() <= BROADCAST_IDS else several, "code"))
    held = posts.groupBy("code", "key").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.max(F.col("code") <= F.col("soon")).alias("early"))
    a, b = (held.toDF("code", f"key_{x}", f"least_{x}", f"most_{x}", f"early_{x}") for x in "ab")
    near = (F.col("most_a") >= F.col("least_b") * threshold - 1e-6) & (F.col("most_b") >= F.col("least_a") * threshold - 1e-6) & (F.col("early_a") | F.col("early_b"))
    met = a.join(b, "code").where((F.col("key_a") < F.col("key_b")) & near).select("code", "key_a", "key_b").join(links, ["key_a", "key_b"], "left_anti")
    met = checkpoint(met)
    sizes = placed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= WHOLE).select("key")
    whole = checkpoint(met.select("key_a", "key_b").distinct().join(sizes.toDF("key_a"), "key_a", "left_semi").join(sizes.toDF("key_b"), "key_b", "left_semi"))
    a, b = (posts.select("code", *(F.col(c).alias(f"{c}_{x}") for c in ("key", "node", "size", "soon", "last"))) for x in "ab")
    both = met.join(whole, ["key_a", "key_b"], "left_anti").join(a, ["code", "key_a"]).join(b, ["code", "key_b"])
    smaller = F.col("size_a") <= F.col("size_b")
    size, soon = (F.when(smaller, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")) for c in ("size", "soon"))
    large, last = (F.when(smaller, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")) for c in ("size", "last"))
    both = both.where((size >= large * threshold - 1e-6) & (F.col("code") <= soon))
    shared = both.groupBy("node_a", "node_b").agg(F.count("*").alias("shared"), F.first(size).alias("size"), F.first(large).alias("large"), F.first(soon).alias("soon"), F.first(last).alias("last"))
    # What both sets have up to the end of the prefix that ends first, the smaller set's short or the larger one's long, is shared
    # by the prefixes; the rest of that set is all that can follow.
    rest = F.when(F.col("soon") <= F.col("last"), F.ceil(2 * threshold / (1 + threshold) * F.col("size") - 1e-9)).otherwise(F.ceil(threshold * F.col("large") - 1e-9)) - 1
    needs = threshold / (1 + threshold) * (F.col("size") + F.col("large")) - 1e-6
    return whole, checkpoint(shared.where(F.col("shared") + rest >= needs).select("node_a", "node_b"))


def _places(placed: DataFrame, links: DataFrame) -> DataFrame:
    """(tile, node, side): where sets are compared. Each pair of a group's sets, or of the sets of two linked groups, meets in one tile.

    A block of a group is the host of the group's later blocks and of smaller groups that it is linked with; those guests are
    dealt into pieces of about 2 * BLOCK by hash.
    """
    groups = checkpoint(placed.groupBy("key").agg(F.count("*").alias("n"), (F.max("blk") + 1).alias("blocks")))
    a, b = (groups.select(*(F.col(c).alias(f"{c}_{x}") for c in ("key", "n", "blocks"))) for x in "ab")
    first = F.col("n_a") >= F.col("n_b")
    host, blocks, guest = (F.when(first, F.col(p)).otherwise(F.col(q)) for p, q in (("key_a", "key_b"), ("blocks_a", "blocks_b"), ("key_b", "key_a")))
    met = links.join(a, "key_a").join(b, "key_b").select(host.alias("host"), guest.alias("key"), F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("at"))
    later = placed.where("blk > 0").select("node", F.col("key").alias("host"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blk") - 1)).alias("at"))
    sizes = met.join(groups, "key").select("host", "at", "n").unionByName(later.select("host", "at", F.lit(1).cast("bigint").alias("n")))
    pieces = checkpoint(sizes.groupBy("host", "at").agg(F.ceil(F.sum("n") / (2 * BLOCK)).alias("pieces")))
    guests = met.join(placed, "key").select("node", "host", "at").unionByName(later.select("node", "host", "at")).join(pieces, ["host", "at"])
    piece = F.pmod(F.xxhash64("node", F.lit(1)), "pieces")
    guests = guests.select(F.xxhash64("host", "at", piece).alias("tile"), "node", F.lit(2).alias("side"))
    hosts = placed.join(pieces.toDF("key", "blk", "pieces"), ["key", "blk"], "left").join(groups.select("key", "n"), "key").where("n > 1 OR pieces IS NOT NULL")
    hosts = hosts.select("node", "key", "blk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("pieces", F.lit(1)) - 1)).alias("piece"))
    return hosts.select(F.xxhash64("key", "blk", "piece").alias("tile"), "node", F.when(F.col("piece") == 0, 0).otherwise(1).alias("side")).unionByName(guests)


def _sets_and_pairs(docs: DataFrame, n: int, threshold: float, partitions: int, mode: str) -> tuple[DataFrame, DataFrame]:
    """Members (node, doc_id), and verified ``pairs`` of different nodes, a ``forest`` of them that keeps the groups, or that with ``links`` counted."""
    spark = ready(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    signed = checkpoint(texts.mapInArrow(_signer(n, threshold, partitions, *_prefix_tables(texts, n, threshold), _signature_table(texts, n, threshold, partitions)), "doc_id bigint, node bigint, grams bigint, soon bigint, last bigint, prefix array<bigint>, sigs array<bigint>"))
    members = signed.select("node", "doc_id").repartition("node").distinct()

    # Buckets: sets that share a signature; the first set of a bucket is its pivot. Pivots are aggregated before
    # the shuffle and joined back, so that a hot bucket is a skewed join key, which is split, and no window.
    sigs = signed.groupBy("node").agg(F.first("sigs").alias("sigs")).select("node", F.explode("sigs").alias("sig"))
    pivots = sigs.groupBy("sig").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot <> last").drop("last")
    shared = checkpoint(sigs.join(pivots, "sig"))

    # Each set goes to the group of its smallest pivot: all of a group are candidates of that one set. Groups are dealt into blocks by hash.
    label = checkpoint(shared.groupBy("node").agg(F.min("pivot").alias("key")))
    large = label.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    blk = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1)))
    placed = checkpoint(label.join(large, "key", "left").select("node", "key", blk.alias("blk")))
    # Groups that some bucket connects are compared with one another, too.
    keys = shared.join(placed.select("node", "key"), "node").groupBy("sig").agg(F.sort_array(F.collect_set("key")).alias("keys")).where(F.size("keys") > 1)
    links = keys.select(F.posexplode("keys").alias("i", "key_a"), "keys").select("key_a", F.explode(F.slice("keys", F.col("i") + 2, F.size("keys"))).alias("key_b")).distinct()
    links = checkpoint(links)
    whole, missed = _missed(signed, placed, links, threshold)
    two = F.array(F.struct(F.col("node_a").alias("node"), F.lit(0).alias("side")), F.struct(F.col("node_b").alias("node"), F.lit(2).alias("side")))
    own = missed.select(F.xxhash64("node_a", "node_b").alias("tile"), F.explode(two).alias("end")).select("tile", "end.*")
    places = _places(placed, links.unionByName(whole)).unionByName(own)
    if mode == "links":
        places = places.join(members.groupBy("node").agg(F.count("*").alias("copies")), "node")
    else:
        places = places.withColumn("copies", F.lit(1).cast("bigint"))
    places = checkpoint(places.select("tile", "node", "side", "copies"))
    if (count := places.count()) <= BROADCAST_IDS:
        table = np.fromiter(map(tuple, places.toLocalIterator()), [("tile", "i8"), ("node", "i8"), ("side", "i4"), ("copies", "i8")], count)
        table = spark.sparkContext.broadcast(table[np.argsort(table["node"])])
        rows = texts.select("text").mapInArrow(_set_sender(n, table), "tile bigint, node bigint, side int, members binary, copies bigint")
    else:
        sets = texts.select("text").mapInArrow(_set_reader(n), "node bigint, members binary").join(places.select("node").distinct(), "node", "left_semi")
        rows = places.join(sets.groupBy("node").agg(F.first("members").alias("members")), "node").select("tile", "node", "side", "members", "copies")
    rows = rows.repartition("tile").sortWithinPartitions("tile")
    pairs = rows.mapInArrow(_verifier(threshold, mode), "node_a bigint, node_b bigint, jaccard double")
    return members, pairs


def similar_sets(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, partitions: int = PARTITIONS) -> tuple[DataFrame, DataFrame]:
    """Pairs (node_a < node_b, jaccard) of similar sets, and the membership (node, doc_id): which documents have each set.

    Documents of one node are copies, of similarity 1.
    """
    members, pairs = _sets_and_pairs(docs, n, threshold, partitions, "pairs")
    return pairs.select(F.least("node_a", "node_b").alias("node_a"), F.greatest("node_a", "node_b").alias("node_b"), F.round("jaccard", 6).alias("jaccard")), members


def _least(members: DataFrame) -> DataFrame:
    return members.groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))


def _grouped(members: DataFrame, forest: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every document that has a similar one, by the smallest doc_id."""
    least = _least(members)
    near = forest.join(least.select(F.col("node").alias("node_a"), F.col("low").alias("a")), "node_a").join(least.select(F.col("node").alias("node_b"), F.col("low").alias("b")), "node_b").select("a", "b")
    equal = members.join(least.where("copies > 1"), "node").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    return components(near.union(equal)).select(F.col("node").alias("doc_id"), F.col("root").alias("class_id"))


def linked_documents(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, partitions: int = PARTITIONS) -> DataFrame:
    """(doc_id, class_id, n_links), a row for each document that has a similar one.

    ``n_links`` is the number of documents with a similar or an equal set, ``class_id`` the smallest doc_id
    that chains of such links reach. All links between different sets are verified and counted.
    """
    members, found = _sets_and_pairs(docs, n, threshold, partitions, "links")
    found = checkpoint(found)
    classes = _grouped(members, found.where("node_a <> node_b"))
    near = found.where("node_a = node_b").groupBy(F.col("node_a").alias("node")).agg(F.sum("jaccard").cast("bigint").alias("near"))
    sized = _least(members).join(near, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links")).where("links > 0")
    links = members.join(sized, "node").groupBy("doc_id").agg(F.sum("links").alias("n_links"))
    # A document whose equal and similar sets are all its own has links, but no class with another.
    return links.join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is the smallest node it is connected with.

    Large-star and small-star rounds: a number of rounds logarithmic in the longest chain.
    """
    now = checkpoint(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct())
    before = None
    while True:
        both = now.select("a", "b").union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        now = checkpoint(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
        before = state


def near_duplicate_groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, partitions: int = PARTITIONS) -> DataFrame:
    """(doc_id, group_id) of every document that has a similar one; group_id is the smallest doc_id that chains of similar pairs reach.

    Its size grows with the documents, not with the pairs.
    """
    return _grouped(*_sets_and_pairs(docs, n, threshold, partitions, "forest")).withColumnRenamed("class_id", "group_id")


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is not among ids: a hash lookup where the ids are few enough to send, else a shuffled join."""
    ids = checkpoint(ids.select(F.col("doc_id").alias("_gone")))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs["doc_id"] == ids["_gone"], "left_anti")


def drop_near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, partitions: int = PARTITIONS) -> DataFrame:
    """The documents without those that have a similar one of a smaller doc_id in their group.

    Rows that repeat a doc_id which stays, all stay; so do rows of null doc_id and texts without a word.
    """
    groups = near_duplicate_groups(docs, n, threshold, partitions)
    return without_ids(docs, groups.where("doc_id <> group_id"))
