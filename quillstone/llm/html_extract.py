"""HTML main-content extraction by maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative; one linear scan finds
the contiguous region of the greatest sum, which is the content. The weights are log ratios of how
often a word or a tag of that name occurs inside and outside the content of labelled pages: pages that
mark their content by an ``article`` element. The marking tags themselves have no weight, so that a
page without them is treated alike. How strongly tags count against words is chosen on those pages.

Defined results
    null html: null content, score null. No word with a positive region: empty content, score 0.
    Comments, scripts and styles count as one tag each and never as words. Unclosed ones, and a tag that
    is never closed, reach to the end. A "<" before anything but a letter, "/", "!" or "?" is text; a
    ">" in a quoted attribute value closes nothing. Ties: the first region, and the shortest of those that
    begin alike. Repeated rows: a row each. Very long pages are scanned whole. No labelled page (an
    empty table included): fallback weights, 1 for words and -5 for every tag. Other columns are
    ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, ready

#: Labelled pages that the weights are fitted on, at most.
FIT_PAGES = 400
MARK = "article"
#: A comment; a script or style with all inside; a tag, with quoted values that may hold ">"; a declaration.
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?[a-z][^\s/>]*+)(?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*'|))*+(?:>|\Z)|<[/!?][^>]*(?:>|\Z)""",
    re.S | re.I,
)
BREAKS = frozenset("p br div li ul ol h1 h2 h3 h4 h5 h6 tr table section header footer nav article blockquote pre title".split())
SCHEMA = "page_id bigint, content string, start bigint, stop bigint, words bigint, score double"


@dataclass
class Weights:
    word: float = 1.0
    other: float = -5.0
    tags: dict[str, float] = field(default_factory=dict)

    def tag(self, name: str) -> float:
        return self.tags.get(name, self.other)


def name_of(m: re.Match) -> str:
    """Tag name without the slash; closing tags count like opening ones."""
    if m[1]:
        return m[1].lower()
    return (m[2] or "!").lstrip("/").lower()


def segments(page: str) -> Iterator[tuple[int, int, str | None]]:
    """(start, stop, tag name or None for text) of all of the page, in order."""
    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            yield at, m.start(), None
        yield m.start(), m.end(), name_of(m)
        at = m.end()
    if at < len(page):
        yield at, len(page), None


def best_region(page: str, w: Weights) -> tuple[int, int, float]:
    """Start, stop and score of the best region; it begins and ends with text."""
    best, region, run, begin = 0.0, (0, 0), 0.0, 0
    for start, stop, tag in segments(page):
        if tag is None:
            words = len(page[start:stop].split())
            if not words:
                continue
            if run <= 0:
                run, begin = 0.0, start
            run += w.word * words
            if run > best + 1e-12:
                best, region = run, (begin, stop)
        elif tag != MARK:
            run += w.tag(tag)
    return (*region, best)


def region_text(page: str, start: int, stop: int) -> str:
    """The text of a region: tags gone, block tags as line breaks, entities decoded, spaces joined."""
    out = []
    part = page[start:stop]
    for a, b, tag in segments(part):
        if tag is None:
            out.append(part[a:b])
        elif tag in BREAKS:
            out.append("\0")
    lines = (" ".join(entities.unescape(line).split()) for line in "".join(out).split("\0"))
    return "\n".join(line for line in lines if line)


def marked(page: str) -> tuple[int, int] | None:
    """The inside of the page's first article element."""
    begin = None
    for start, stop, tag in segments(page):
        if tag == MARK:
            if begin is None:
                begin = stop
            elif page.startswith("</", start):
                return begin, start
    return None


def _overlap(page: str, gold: tuple[int, int], w: Weights) -> float:
    """F1 of the words that were found."""
    start, stop, _ = best_region(page, w)
    count = lambda a, b: len(region_text(page, a, b).split()) if b > a else 0
    both = count(max(start, gold[0]), min(stop, gold[1]))
    total = count(start, stop) + count(*gold)
    return 2 * both / total if total else 1.0


def fit(pages: list[str]) -> Weights:
    """Weights from pages that mark their content."""
    labelled = [(p, g) for p in pages if (g := marked(p))]
    if not labelled:
        return Weights()
    inside, outside = Counter(), Counter()
    for page, gold in labelled:
        for start, stop, tag in segments(page):
            if tag != MARK:
                (inside if gold[0] <= start < gold[1] else outside)[tag] += len(page[start:stop].split()) if tag is None else 1
    kinds = len({*inside, *outside})
    n_in, n_out = sum(inside.values()) + kinds, sum(outside.values()) + kinds
    ratio = {k: math.log((inside[k] + 1) / n_in) - math.log((outside[k] + 1) / n_out) for k in {*inside, *outside}}
    word = max(ratio.pop(None, 0.1), 0.1)
    best: tuple[float, Weights] | None = None
    for strength in (1, 2, 4, 8, 16):
        w = Weights(word, -strength * max(1.0, word), {k: strength * min(r, -0.05) for k, r in ratio.items()})
        quality = sum(_overlap(p, g, w) for p, g in labelled) / len(labelled)
        if best is None or quality > best[0] + 1e-9:
            best = quality, w
    return best[1]


def fit_weights(pages: DataFrame, most: int = FIT_PAGES) -> Weights:
    """Weights from at most so many labelled pages, those whose ids have the smallest hashes; repeated rows count once."""
    ready(pages.sparkSession)
    key = F.md5(F.coalesce(F.col("page_id").cast("bigint").cast("string"), F.lit("")))
    own = pages.select(key.alias("key"), F.col("html").cast("string").alias("html")).where(F.lower("html").contains(f"<{MARK}")).withColumn("print", F.xxhash64("html"))
    # Hashes are chosen first, by a shuffle: the driver gets the pages of the sample alone, however many tasks there are.
    picked = checkpoint(own.select("key", "print").orderBy("key", "print").limit(most)).distinct()
    sample = own.join(F.broadcast(picked), ["key", "print"]).dropDuplicates(["key", "print"])
    return fit([r["html"] for r in sorted(sample.collect(), key=lambda r: (r["key"], r["print"]))])


def _extractor(w: Weights) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, start, stop, words, score = [], [], [], [], []
            for page in batch.column(1).to_pylist():
                if page is None:
                    for c in (content, start, stop, words, score):
                        c.append(None)
                    continue
                a, b, s = best_region(page, w)
                content.append(region_text(page, a, b))
                start.append(a)
                stop.append(b)
                words.append(len(content[-1].split()))
                score.append(round(s, 6))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip((content, start, stop, words, score), kinds, strict=True))], ["page_id", "content", "start", "stop", "words", "score"])

    return run


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, content, start, stop, words, score) of each page; start and stop are characters of its html."""
    ready(pages.sparkSession)
    w = weights or fit_weights(pages)
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(_extractor(w), SCHEMA)
