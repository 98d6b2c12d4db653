"""Quality rules by distribution divergence.

Two histograms of each document are held against the reference of its language, the sum of the
histograms of all documents of that language: characters by class, and words by common word (twelve,
and one bin for all others). The common words of four languages are listed; those of any other are the
commonest in its documents. The distance is the square root of the
Jensen-Shannon divergence in bits, from 0 to 1. A document is rejected when a distance exceeds its
bound, a base plus a slope over the root of the number of characters or words, since the noise of a
histogram falls with that root. A histogram of fewer than the least number is not judged at all.

Defined results
    null text, or text without any letter or number: rejected ("empty"), distances null.
    too short for a histogram: that distance is null and does not reject; so very short texts stay.
    null language, or one without any word: held against the sum over all documents ("*"), by
    characters alone. Words that are as common as others of their language: by the word. Ties and
    repeated rows: each row is judged by itself; all rows count in the references. Empty table: no row,
    same columns. Other columns are kept; columns of the input named like an output (``char_distance``,
    ``word_distance``, ``verdict``) are replaced by it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ready
from .kernels import Slab, hash_word, slabs

COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "des", "ein"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "que", "est", "pour"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"),
}
#: Common words of a language that has no list.
COMMON = 12
CLASSES = ("lower", "upper", "letter", "number", "space", "stop", "shout", "symbol")
ALL = "*"
#: Base and slope of the bound of a distance.
CHAR_BOUND, WORD_BOUND = (0.15, 3.5), (0.05, 2.6)
MIN_CHARS, MIN_WORDS = 100, 60
_state: dict[str, object] = {}


def class_table() -> np.ndarray:
    """Class of each code point, by index in CLASSES."""
    if "classes" not in _state:
        t = np.full(0x110000, 7, np.uint8)
        category = unicodedata.category
        for c in (*range(0xD800), *range(0xE000, 0x110000)):
            kind = category(chr(c))
            if kind[0] in "LN":
                t[c] = {"Ll": 0, "Lu": 1, "Lt": 1}.get(kind, 3 if kind[0] == "N" else 2)
        t[[9, 10, 11, 12, 13, 32]] = 4
        t[[ord(c) for c in ".,;:'\"()-"]] = 5
        t[[ord("!"), ord("?")]] = 6
        _state["classes"] = t
    return _state["classes"]


def _lexicon(words: dict[str, tuple[str, ...]]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """All common words' hashes, sorted, and for each language the bin of each of them; the last bin has all other words."""
    hashes = {w: hash_word(w) for own in words.values() for w in own}
    order = np.array(sorted(hashes.values()), np.uint64)
    bins = {}
    for lang, own in words.items():
        b = np.full(len(order) + 1, len(own))
        for k, w in enumerate(own):
            b[np.searchsorted(order, np.uint64(hashes[w]))] = k
        bins[lang] = b
    return order, bins


def _characters(slab: Slab) -> np.ndarray:
    """Histogram of classes for each text."""
    n = len(slab.texts)
    of = np.repeat(np.arange(n) * 8, slab.lens + 1)
    h = np.bincount(of + class_table()[slab.code], minlength=n * 8).reshape(n, 8)
    h[:, 4] -= 1  # the newline that closes each text
    return h


def _words(slab: Slab, order: np.ndarray) -> np.ndarray:
    """Histogram over all common words of all languages, and the rest, for each text."""
    n, size = len(slab.texts), len(order) + 1
    at = np.minimum(np.searchsorted(order, slab.word_hash), len(order) - 1)
    at = np.where(order[at] == slab.word_hash, at, len(order))
    return np.bincount(slab.word_doc * size + at, minlength=n * size).reshape(n, size)


def _binned(words: np.ndarray, bins: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), bins.max() + 1), np.int64)
    np.add.at(out.T, bins, words.T)
    return out


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of counts p from the counts q."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    q = np.broadcast_to(q / max(q.sum(), 1), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.maximum(d / 2, 0))


def _counter(words: dict[str, tuple[str, ...]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, bins = _lexicon(words)
        total: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for start, slab in slabs(batch.column(0).to_pylist()):
                c, w = _characters(slab), _words(slab, order)
                own = np.array([x if x in words else ALL for x in langs[start : start + len(slab.texts)]])
                for lang in np.unique(own):
                    pick = own == lang
                    parts = {("char", lang): c[pick].sum(axis=0)}
                    if lang in words:
                        parts["word", lang] = _binned(w[pick], bins[lang]).sum(axis=0)
                    for key, x in parts.items():
                        total[key] = total.get(key, 0) + x
        rows = [(kind, str(lang), k, int(v)) for (kind, lang), x in total.items() for k, v in enumerate(x)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["kind", "lang", "bin", "n"])

    return run


def word_lists(docs: DataFrame, listed: dict[str, tuple[str, ...]] = COMMON_WORDS) -> dict[str, tuple[str, ...]]:
    """The listed languages' words, and for every other language of the documents its commonest."""
    lang, text = F.col("lang").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    others = docs.select(lang.alias("lang"), text.alias("text")).where(F.col("lang").isNotNull() & ~F.col("lang").isin(*listed))
    counts = others.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("nth") <= COMMON)
    found: dict[str, list[tuple[int, str]]] = {}
    for r in ranked.collect():  # COMMON rows a language
        found.setdefault(r["lang"], []).append((r["nth"], r["word"]))
    return listed | {k: tuple(w for _, w in sorted(v)) for k, v in found.items()}


def references(docs: DataFrame, words: dict[str, tuple[str, ...]] = COMMON_WORDS) -> DataFrame:
    """(kind, lang, bin, n) summed over all documents: 8 character classes and the common words of each language in ``words``."""
    ready(docs.sparkSession)
    counted = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(_counter(words), "kind string, lang string, bin bigint, n bigint")
    return counted.groupBy("kind", "lang", "bin").agg(F.sum("n").alias("n"))


def _judge(words: dict[str, tuple[str, ...]], refs: dict[tuple[str, str], np.ndarray], bounds: tuple[tuple[float, float], tuple[float, float]], least: tuple[int, int]) -> Callable:
    def judged(text: pa.Array, lang: pa.Array) -> pa.Array:
        order, bins = _lexicon(words)
        langs = lang.to_pylist()
        parts = []
        for start, slab in slabs(text.to_pylist()):
            n = len(slab.texts)
            c, w = _characters(slab), _words(slab, order)
            char, word = np.full(n, np.nan), np.full(n, np.nan)
            own = np.array([x if x in words else ALL for x in langs[start : start + n]])
            for lang_ in np.unique(own):
                for x, kind, low, out in ((c, "char", least[0], char), (w, "word", least[1], word)):
                    pick = np.flatnonzero((own == lang_) & (x.sum(axis=1) >= low))
                    if len(pick) and (kind, lang_) in refs:
                        out[pick] = distances(_binned(x[pick], bins[lang_]) if kind == "word" else x[pick], refs[kind, lang_])
            empty = slab.folded_count == 0
            char[empty] = word[empty] = np.nan
            with np.errstate(invalid="ignore"):
                over = [d > base + slope / np.sqrt(np.maximum(x.sum(axis=1), 1)) for d, x, (base, slope) in zip((char, word), (c, w), bounds, strict=True)]
                verdict = np.select([empty, *over], ["empty", "characters", "words"], "keep")
            parts.append((char, word, verdict))
        char, word = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in (0, 1))
        verdict = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, str)
        return pa.StructArray.from_arrays([pa.array(np.round(char, 6), mask=np.isnan(char)), pa.array(np.round(word, 6), mask=np.isnan(word)), pa.array(verdict.astype(object), pa.string())], ["char_distance", "word_distance", "verdict"])

    return judged


def _judged(docs: DataFrame, words: dict[str, tuple[str, ...]] | None = None, char_bound: tuple[float, float] = CHAR_BOUND, word_bound: tuple[float, float] = WORD_BOUND, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> Column:
    """A struct of both distances and the verdict of each document, against the references of all of them."""
    words = word_lists(docs) if words is None else words
    refs: dict[tuple[str, str], np.ndarray] = {}
    rows = references(docs, words).collect()  # at most 21 for each language
    for r in rows:
        size = len(CLASSES) if r["kind"] == "char" else len(words[r["lang"]]) + 1
        refs.setdefault((r["kind"], r["lang"]), np.zeros(size, np.int64))[r["bin"]] = r["n"]
    refs["char", ALL] = sum((x for (kind, _), x in refs.items() if kind == "char"), np.zeros(len(CLASSES), np.int64))
    udf = F.arrow_udf(_judge(words, refs, (char_bound, word_bound), (min_chars, min_words)), "char_distance double, word_distance double, verdict string")
    return udf(F.col("text").cast("string"), F.col("lang").cast("string"))


def judge(docs: DataFrame, **options: object) -> DataFrame:
    """The documents with ``char_distance``, ``word_distance`` and ``verdict`` (keep, empty, characters or words).

    ``options`` are the word lists, bounds and least sizes that stand at the top of this module.
    """
    kept = docs.drop("char_distance", "word_distance", "verdict")
    name = "_judged"
    while name in kept.columns:
        name += "_"
    return kept.select("*", _judged(docs, **options).alias(name)).select(*kept.columns, f"{name}.*")


def drop_rejected(docs: DataFrame, **options: object) -> DataFrame:
    """The documents that the rules keep, with their own columns as they are."""
    return docs.where(_judged(docs, **options)["verdict"] == "keep")
