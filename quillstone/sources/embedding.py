"""The embedding seam: any function of texts to vectors; by default a hash of the text, for tests and dry runs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ready

DIMENSIONS = 16


def hash_vectors(texts: list[str]) -> np.ndarray:
    """Numbers between -1 and 1 seeded by the text."""
    import hashlib

    raw = b"".join(hashlib.shake_128(t.encode()).digest(2 * DIMENSIONS) for t in texts)
    return np.frombuffer(raw, np.uint16).reshape(len(texts), DIMENSIONS) / 32767.5 - 1.0


def embed(rows: DataFrame, model: Callable[[list[str]], np.ndarray] = hash_vectors) -> DataFrame:
    """The rows with ``embedding``; that of a null text is null. The model sees a batch at a time."""
    ready(rows.sparkSession)

    def run(text: pa.Array) -> pa.Array:
        known = text.is_valid().to_numpy(zero_copy_only=False)
        texts = text.drop_null().to_pylist()
        vectors = np.ascontiguousarray(model(texts), np.float32) if texts else np.zeros((0, 0), np.float32)
        ends = np.concatenate([[0], np.cumsum(known)]) * vectors.shape[1]
        offsets = pa.array(ends.astype(np.int32), mask=np.concatenate([~known, [False]]))
        return pa.ListArray.from_arrays(offsets, pa.array(vectors.reshape(-1)))

    return rows.withColumn("embedding", F.arrow_udf(run, "array<float>")("text"))
