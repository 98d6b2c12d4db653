"""Context compression around a name: what stands near its occurrences, within a bound of characters."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

AROUND, SNIPPETS, MOST = 100, 3, 500


def snippets(text: str, name: str, around: int = AROUND, count: int = SNIPPETS, most: int = MOST) -> str:
    """The surroundings of the first occurrences, cut at word borders, joined where they meet."""
    spans: list[list[int]] = []
    for m in list(re.finditer(re.escape(name), text, re.IGNORECASE))[:count] if name else []:
        a, b = max(0, m.start() - around), min(len(text), m.end() + around)
        while a > 0 and not text[a - 1].isspace() and a < m.start():
            a += 1
        while b < len(text) and not text[b].isspace() and b > m.end():
            b -= 1
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    out = " ... ".join(text[a:b].strip() for a, b in spans) if spans else text
    return out[:most]


def key_sentences(text: str, name: str, most: int = MOST) -> str:
    """The sentences that hold the name, else the first ones."""
    parts = re.split(r"(?<=[.!?])\s+", text)
    own = [p for p in parts if name.lower() in p.lower()] if name else []
    return " ".join(own or parts)[:most]


def adaptive(text: str | None, name: str | None) -> str | None:
    """Short texts stay, middling ones keep sentences, long ones surroundings."""
    if text is None or len(text) <= 500:
        return text
    return key_sentences(text, name or "") if len(text) <= 2000 else snippets(text, name or "")


def compressed(text: Column, name: Column) -> Column:
    def run(t: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([adaptive(a, b) for a, b in zip(t.to_pylist(), n.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(run, "string")(text, name)
