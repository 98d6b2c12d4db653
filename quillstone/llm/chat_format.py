"""Chat formatting by columnar byte assembly.

The turns of a conversation become one text, ``<|im_start|>role\\ncontent<|im_end|>\\n`` for each turn
in order. The lengths of all segments of a batch, their running offsets and the scatter indices are
computed as arrays, headers and contents are copied into one preallocated buffer, and that buffer is
the data of the Arrow column which is returned; no string is built for a turn or a conversation.

Defined results
    null text: empty content. null role: ``unknown``. null turn: before all others.
    null conv_id: one conversation of all such rows. Ties (a turn that repeats): by role, then text;
    repeated rows: repeated turns. Very long contents are copied whole. Empty table: no row.
    Other columns are ignored. Markers inside a content are copied as they are. A conversation is one
    row, which Spark bounds by 2 GiB: a longer one fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ready

START, END = b"<|im_start|>", b"<|im_end|>\n"
SCHEMA = "conv_id bigint, n_turns bigint, text string, n_bytes bigint, assistant_bytes bigint"
#: Bytes of one returned batch, unless a single conversation is longer.
FLUSH_BYTES = 1 << 26


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the ranges (start, start + length), one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and data of a string column, nulls as empty."""
    column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def assemble(conv: pa.Array, role: pa.Array, text: pa.Array, cuts: np.ndarray) -> pa.RecordBatch:
    """One row for each conversation, whose turns lie between the cuts."""
    n = len(role)
    kinds = role.fill_null("unknown").dictionary_encode()
    names = [START + r.encode() + b"\n" for r in kinds.dictionary.to_pylist()]
    kind = kinds.indices.to_numpy(zero_copy_only=False)
    heads = np.frombuffer(b"".join(names) + END, np.uint8)
    head_size = np.array([len(h) for h in names], np.int64)
    head_at = np.cumsum(head_size) - head_size
    source, data = _bytes(text)
    size = np.empty((n, 3), np.int64)
    size[:, 0], size[:, 1], size[:, 2] = head_size[kind], np.diff(source), len(END)
    offset = np.zeros(3 * n + 1, np.int64)
    np.cumsum(size.ravel(), out=offset[1:])
    out = np.empty(offset[-1], np.uint8)
    start = offset[:-1].reshape(n, 3)
    out[_ragged(start[:, 0], size[:, 0])] = heads[_ragged(head_at[kind], size[:, 0])]
    out[_ragged(start[:, 1], size[:, 1])] = data[source[0] : source[-1]]
    out[_ragged(start[:, 2], size[:, 2])] = np.tile(heads[len(heads) - len(END) :], n)
    ends = offset[3 * cuts]
    texts = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out))
    said = np.zeros(n + 1, np.int64)
    np.cumsum(np.where(np.array([x == START + b"assistant\n" for x in names], bool)[kind], size[:, 1], 0), out=said[1:])
    return pa.RecordBatch.from_arrays([conv.take(pa.array(cuts[:-1])), pa.array(np.diff(cuts)), texts, pa.array(np.diff(ends)), pa.array(np.diff(said[cuts]))], ["conv_id", "n_turns", "text", "n_bytes", "assistant_bytes"])


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by conversation; the last one of a batch is held until another begins."""

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        conv, role, text = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns)
        key, missing = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
        new = np.flatnonzero((key[1:] != key[:-1]) | (missing[1:] != missing[:-1])) + 1
        cuts = np.concatenate([[0], new, [len(conv)]])
        size = np.concatenate([[0], np.cumsum(np.diff(_bytes(text)[0]))])[cuts]
        low = 0
        while low < len(cuts) - 1:
            high = max(low + 1, int(np.searchsorted(size, size[low] + FLUSH_BYTES, side="right")) - 1)
            a, b = cuts[low], cuts[high]
            yield assemble(conv.slice(a, b - a), role.slice(a, b - a), text.slice(a, b - a), cuts[low : high + 1] - a)
            low = high

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        first, last = batch.column(0)[0].as_py(), batch.column(0)[-1].as_py()
        if held and held[-1].column(0)[-1].as_py() == last and first == last:
            held.append(batch)
            continue
        key = batch.column(0)
        same = key.is_null() if last is None else pc.fill_null(pc.equal(key, last), False)
        tail = batch.num_rows - int(np.argmin(np.append(same.to_numpy(zero_copy_only=False)[::-1], False)))
        head = [*held, batch.slice(0, tail)]
        held = [batch.slice(tail)]
        if sum(b.num_rows for b in head):
            yield from done(pa.Table.from_batches(head))
    if held:
        yield from done(pa.Table.from_batches(held))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text, n_bytes, assistant_bytes) of each conversation."""
    ready(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_formatted, SCHEMA)
