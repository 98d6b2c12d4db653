"""Array kernels over batches of whole texts: code points, words, n-grams.

A word is a maximal run of Unicode letters and numbers (categories L and N), compared in lower
case, one code point at a time. The same words come from the SQL expression
``regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')``.

Everything here works on a *slab*: some consecutive texts of one Arrow batch, joined by newlines
and seen as one array of code points. Slabs are bounded by characters, not by rows, so that memory
stays flat; a text that is longer than the bound is a slab by itself and is never cut.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np

SLAB_CHARS = 1 << 18
_PRIME = 0x9E3779B97F4A7C15
_U = np.uint64
_state: dict[str, np.ndarray] = {}


def fold_table() -> np.ndarray:
    """Lower-case code point of each letter or number; 0 for all else."""
    if "fold" not in _state:
        t = np.zeros(0x110000, np.uint32)
        category = unicodedata.category
        for c in (*range(0xD800), *range(0xE000, 0x110000)):
            ch = chr(c)
            if category(ch)[0] in "LN":
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _state["fold"] = t
    return _state["fold"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "pow" not in _state or len(_state["pow"]) < n:
        m = max(n, SLAB_CHARS + 2)
        for name, base in (("pow", _PRIME), ("inv", pow(_PRIME, -1, 1 << 64))):
            a = np.full(m, base, _U)
            a[0] = 1
            _state[name] = np.cumprod(a)
    return _state["pow"], _state["inv"]


def hash_word(word: str) -> int:
    """What ``Slab.word_hash`` has for this word."""
    return int(Slab([word]).word_hash[0])


@dataclass
class Slab:
    texts: list[str]

    @cached_property
    def code(self) -> np.ndarray:
        return np.frombuffer(("\n".join(self.texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)

    @cached_property
    def lens(self) -> np.ndarray:
        return np.fromiter(map(len, self.texts), np.int64, len(self.texts))

    @cached_property
    def ends(self) -> np.ndarray:
        """Where each text's closing newline ends."""
        return np.cumsum(self.lens + 1)

    @cached_property
    def begins(self) -> np.ndarray:
        return self.ends - self.lens - 1

    @cached_property
    def folded(self) -> np.ndarray:
        return fold_table()[self.code]

    @cached_property
    def folded_count(self) -> np.ndarray:
        """Letters and numbers in each text."""
        return sums((self.folded != 0).astype(np.int64), np.concatenate([[0], self.ends]))

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word, in the slab."""
        inside = np.zeros(len(self.code) + 2, np.int8)
        inside[1:-1] = self.folded != 0
        d = np.diff(inside)
        return np.flatnonzero(d == 1), np.flatnonzero(d == -1)

    @cached_property
    def word_hash(self) -> np.ndarray:
        s, e = self.spans
        powers, inverse = _powers(len(self.code) + 1)
        total = np.zeros(len(self.code) + 1, _U)
        np.cumsum(self.folded * powers[: len(self.code)], out=total[1:])
        return mix((total[e] - total[s]) * inverse[s])

    @cached_property
    def word_doc(self) -> np.ndarray:
        """Index of the text that holds each word."""
        return np.searchsorted(self.ends, self.spans[0], side="right")

    @cached_property
    def word_cuts(self) -> np.ndarray:
        """The words of text i are those from cut i to cut i + 1."""
        return np.searchsorted(self.word_doc, np.arange(len(self.texts) + 1))

    def gram_sets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct word n-grams of each text as 48-bit hashes, sorted by (text, hash), and the cuts.

        A text of fewer than n words, but one at least, has one gram: all its words.
        """
        w, doc = self.word_hash, self.word_doc
        count = np.diff(self.word_cuts)
        if len(w) >= n:
            m = len(w) - n + 1
            g = w[:m]
            for k in range(1, n):
                g = mix(g * _U(3) + w[k : k + m])
            whole = doc[:m] == doc[n - 1 :]
            g, of = g[whole], doc[:m][whole]
        else:
            g, of = w[:0], doc[:0]
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            h = []
            for i in short:
                x = w[self.word_cuts[i] : self.word_cuts[i + 1]]
                y = x[:1] * _U(5)
                for k in range(1, len(x)):
                    y = mix(y * _U(3) + x[k : k + 1])
                h.append(mix(y)[0])
            g, of = np.concatenate([g, np.array(h, _U)]), np.concatenate([of, short])
        key = np.sort((of.astype(_U) << _U(48)) | (g >> _U(16)))
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        cuts = np.searchsorted(key >> _U(48), np.arange(len(self.texts) + 1, dtype=_U))
        return key & _U((1 << 48) - 1), cuts


def slabs(texts: Iterable[str | None], chars: int = SLAB_CHARS, rows: int = 1 << 14) -> Iterator[tuple[int, Slab]]:
    """(index of the first text, slab) over all texts; a null counts as the empty text."""
    part: list[str] = []
    size = start = 0
    for i, t in enumerate(texts):
        t = t or ""
        if part and (size + len(t) > chars or len(part) >= rows):
            yield start, Slab(part)
            part, size, start = [], 0, i
        part.append(t)
        size += len(t)
    if part:
        yield start, Slab(part)


def sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sum of values (modulo 2^64) between consecutive cuts."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[cuts[1:]] - total[cuts[:-1]]
