"""Benchmark decontamination by one Aho-Corasick automaton.

Test items (questions and answers) and documents are normalised alike: lower case, words of letters
and numbers, one space between. The automaton holds every run of ``window`` consecutive words of
every item, or the whole item where it is shorter, so any passage of that many words is found, in
any case and punctuation. Each text is scanned once, whole; hits must begin and end at word borders,
hits of an item that overlap or touch are one passage, and its place is mapped back to the original.

Defined results
    null or empty text: no passage; the document stays. Null items, and items of fewer than
    ``least`` words, match nothing: their words are too common to mean anything.
    null doc_id: its passages are reported under null. Repeated rows: each is scanned by itself.
    ties (items that share words): a passage for each item. Empty documents or benchmark: no passage.
    Other columns are ignored by ``passages`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, ready
from .kernels import Slab, slabs

WINDOW, LEAST = 8, 3
#: Characters of items in one automaton; a larger benchmark takes several scans, with the same results.
AUTOMATON_CHARS = 8_000_000
SCHEMA = "doc_id bigint, item_id bigint, start bigint, stop bigint, words bigint"
_built: dict[tuple, object] = {}


def normalised(slab: Slab) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised texts, newlines between, and the place of each in the slab."""
    v = slab.folded.copy()
    space = np.zeros(len(v), bool)
    space[1:] = (v[1:] == 0) & (v[:-1] != 0)
    v[space] = 32
    v[slab.ends - 1] = 10
    at = np.flatnonzero(v)
    return v[at], at


def _words(text: str) -> list[str]:
    v, _ = normalised(Slab([text]))
    return v.tobytes().decode("utf-32-le").split()


def automaton(items: list[tuple[int, str]], window: int, least: int) -> ahocorasick.Automaton:
    found: dict[str, dict[int, int]] = {}
    for item, text in items:
        w = _words(text)
        if len(w) >= least:
            size = min(window, len(w))
            for k in range(len(w) - size + 1):
                found.setdefault(" ".join(w[k : k + size]), {})[item] = size
    a = ahocorasick.Automaton()
    for pattern, own in found.items():
        a.add_word(pattern, (len(pattern), tuple(own.items())))
    a.make_automaton()
    return a


def scan(slab: Slab, a: ahocorasick.Automaton) -> list[tuple[int, int, int, int, int]]:
    """(index of the text, item, start, stop, words) of each passage in the slab's texts."""
    if not len(a):
        return []
    v, at = normalised(slab)
    text = v.tobytes().decode("utf-32-le")
    hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
    first_words = slab.spans[0]
    for last, (size, own) in a.iter(text):
        first = last - size + 1
        if (first == 0 or text[first - 1] in " \n") and (last + 1 == len(text) or text[last + 1] in " \n"):
            w = int(np.searchsorted(first_words, at[first]))
            doc = int(slab.word_doc[w])
            for item, n in own:
                hits.setdefault((doc, item), []).append((w, w + n))
    out = []
    for (doc, item), runs in sorted(hits.items()):
        runs.sort()
        merged = [list(runs[0])]
        for a_, b in runs[1:]:
            if a_ <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a_, b])
        begin = slab.begins[doc]
        out += [(doc, item, int(first_words[a_] - begin), int(slab.spans[1][b - 1] - begin), b - a_) for a_, b in merged]
    return out


def _ready_automaton(items: object, window: int, least: int) -> ahocorasick.Automaton:
    """Built once in each worker."""
    key = items.id, window, least
    if key not in _built:
        _built.clear()
        _built[key] = automaton(items.value, window, least)
    return _built[key]


class _Items:
    """Broadcast items with a key that outlives pickling."""

    def __init__(self, broadcast: object) -> None:
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self) -> list[tuple[int, str]]:
        return self.broadcast.value


def _finder(items: _Items, window: int, least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _ready_automaton(items, window, least)
        for batch in batches:
            ids = batch.column(0)
            for start, slab in slabs(batch.column(1).to_pylist()):
                if rows := scan(slab, a):
                    doc, *rest = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([start + d for d in doc])), *(pa.array(c, pa.int64()) for c in rest)], ["doc_id", "item_id", "start", "stop", "words"])

    return run


def _item_sets(benchmark: DataFrame) -> tuple[int, Iterator[_Items]]:
    """The items in parts that one automaton can hold each, and how many; a part is read when it is asked for."""
    sc = ready(benchmark.sparkSession).sparkContext
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL AND item_id IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = 1 + size // AUTOMATON_CHARS
    own = (items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) for k in range(parts))
    return parts, (_Items(sc.broadcast([tuple(r) for r in part.collect()])) for part in own)


def passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, start, stop, words) of each passage of a test item in a document, in characters of its text.

    With several parts, each scan is done and its items are released before the next part is read.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    parts, sets = _item_sets(benchmark)
    for items in sets:
        part = texts.mapInArrow(_finder(items, window, least), SCHEMA)
        if parts > 1:
            part = checkpoint(part)
            items.broadcast.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def _spotter(items: _Items, window: int, least: int) -> Callable:
    def clean(text: pa.Array) -> pa.Array:
        a = _ready_automaton(items, window, least)
        ok = np.ones(len(text), bool)
        for start, slab in slabs(text.to_pylist()):
            ok[[start + r[0] for r in scan(slab, a)]] = False
        return pa.array(ok)

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """The documents in which no passage of a test item was found."""
    parts, sets = _item_sets(benchmark)
    for items in sets:
        clean = F.arrow_udf(_spotter(items, window, least), "boolean")
        docs = docs.where(clean(F.col("text").cast("string")))
        if parts > 1:
            docs = checkpoint(docs)
            items.broadcast.destroy()
    return docs
