"""Language identification with string kernels.

The kernel of two texts is the share of their character n-grams, of one to ``ORDERS`` letters (a
blended spectrum, by presence, not count): |A ∩ B| / sqrt(|A| |B|), where the n-grams are hashed into
``DIMENSIONS`` places. ``LANDMARKS`` training texts span a Nyström approximation of the kernel's
feature space (one of each language at least), in which a ridge regression against each language's +1 / -1 is solved. A batch of texts
is scored by two matrix products: presence rows times landmark rows, then kernel values times weights.
Whole texts are used, in lower case, with everything but letters and numbers as one space.

Defined results
    null text, or text without a letter: predicted ``und``, margin null. Very short texts are scored
    like others; their margins are small. Ties of scores: the language first in alphabetical order.
    Repeated rows: each is scored by itself; in the fit, equal rows count once and a doc_id of several
    texts with each of them, up to the bound. Empty table: no row. With one labelled language, it is
    always predicted; with none, ``und``. Rows of null language are scored, not fitted on. Other
    columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ready
from .decontaminate import normalised
from .kernels import Slab, slabs

ORDERS, DIMENSIONS = 3, 1 << 14
LANDMARKS, RIDGE = 64, 1e-2
#: Labelled texts fitted on, at most, of each language, and about how many in all: with many languages
#: each has its share of those, but ``LEAST_TEXTS``.
FIT_TEXTS, FIT_ALL, LEAST_TEXTS = 200, 8000, 20
SCHEMA = "doc_id bigint, lang string, predicted string, margin double"
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)
ROWS = 256


def presence(slab: Slab) -> np.ndarray:
    """Row i has 1 wherever text i has an n-gram with that hash."""
    v, at = normalised(slab)
    n = len(slab.texts)
    out = np.zeros((n, DIMENSIONS), np.float32)
    flat = out.reshape(-1)
    row = np.searchsorted(slab.ends, at, side="right") * DIMENSIONS
    inside = v != 10
    letters = (v != 10) & (v != 32)
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    h = np.zeros(len(v), np.uint32)
    whole = np.ones(len(v), bool)
    any_letter = np.zeros(len(v), bool)
    for k in range(min(ORDERS, len(v))):
        m = len(v) - k
        h = h[:m] * np.uint32(31) + v[k:] * _PRIMES[k % len(_PRIMES)]
        whole, any_letter = whole[:m] & inside[k:], any_letter[:m] | letters[k:]
        g = h + np.uint32(k + 1) * np.uint32(0x2C1B3C6D)
        g = (g ^ (g >> np.uint32(15))) * np.uint32(0x846CA68B)
        use = whole & any_letter
        flat[row[:m][use] + (g[use] >> shift).astype(np.int64)] = 1
    return out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # presence rows, scaled by 1 / sqrt(size)
    weights: np.ndarray  # landmark x language
    bias: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
        return ((rows @ self.landmarks.T) / size) @ self.weights + self.bias


def fit(texts: list[str], langs: list[str]) -> Model:
    """A model from labelled texts; landmarks are taken from the languages in turn, one of each at least."""
    languages = sorted(set(langs))
    label = np.searchsorted(languages, langs)
    scaled = lambda slab: (r := presence(slab)) / np.sqrt(np.maximum(r.sum(axis=1, keepdims=True), 1))
    turn = np.empty(len(texts), np.int64)
    for k in range(len(languages)):
        own = np.flatnonzero(label == k)
        turn[own] = np.arange(len(own))
    marks = np.lexsort((label, turn))[: max(LANDMARKS, len(languages))]
    mark = np.concatenate([scaled(s) for _, s in slabs([texts[i] for i in marks], rows=ROWS)])
    values, vectors = np.linalg.eigh((mark @ mark.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = np.concatenate([(scaled(s) @ mark.T).astype(np.float64) @ root for _, s in slabs(texts, rows=ROWS)])
    z1 = np.hstack([z, np.ones((len(z), 1))])
    y = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    penalty = RIDGE * len(z) * np.eye(z1.shape[1]) / max(z.shape[1], 1)
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(z1.T @ z1 + penalty, z1.T @ y)
    return Model(languages, mark, (root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32))


def fit_model(docs: DataFrame, most: int = FIT_TEXTS) -> Model | None:
    """Fitted on at most so many labelled documents of each language, those whose ids have the smallest hashes; equal rows count once."""
    ready(docs.sparkSession)
    labelled = docs.select("doc_id", "lang", "text").where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL")
    langs = labelled.agg(F.count_distinct("lang")).first()[0]
    if not langs:
        return None
    most = min(most, max(LEAST_TEXTS, FIT_ALL // langs))
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    ids = labelled.select("lang", "doc_id").withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= most).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()
    sample = labelled.join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("doc_id", "lang", F.col("text").cast("string").alias("text")).distinct()
    each = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "text")
    rows = sample.withColumn("nth", F.row_number().over(each)).where(F.col("nth") <= most).orderBy("lang", "nth").collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def _scorer(model: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = model.value
        for batch in batches:
            said, margin = [], []
            for _, slab in slabs(batch.column(2).to_pylist(), rows=ROWS):
                empty = slab.folded_count == 0
                if m is None:
                    said += ["und"] * len(empty)
                    margin += [None] * len(empty)
                    continue
                s = m.scores(presence(slab))
                best = np.argmax(s, axis=1)
                top = np.partition(s, -2, axis=1)[:, -2:] if s.shape[1] > 1 else np.hstack([np.zeros_like(s), s])
                said += ["und" if e else m.languages[b] for b, e in zip(best, empty, strict=True)]
                margin += [None if e else round(float(x), 6) for x, e in zip(top[:, 1] - top[:, 0], empty, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(margin, pa.float64())], ["doc_id", "lang", "predicted", "margin"])

    return run


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, lang, predicted, margin) of each document; the margin is the best score less the second."""
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model or fit_model(docs))  # DIMENSIONS floats for each landmark: LANDMARKS, or as many as languages
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(shared), SCHEMA)
