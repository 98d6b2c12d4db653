"""Ingestion: deduplicated artifacts, windows over growing sources, provenance stamps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import resolve
from ..operators.numbering import numbered
from ..session import checkpoint, ready

WINDOW, OVERLAP, TRIGGER = 20, 2, 4
#: Mentions of a name from which its entity is sent to all tasks.
OFTEN = 10_000
#: Windows of extraction: items in one, items shared with the one before, new items that set it off.
EXTRACTION = {"window": 10, "overlap": 2, "trigger": 6}


def formatted(turn_role: Column, text: Column) -> Column:
    return F.concat(F.initcap(turn_role), F.lit(" ("), turn_role, F.lit("): "), text)


def windows(items: DataFrame, source: str, place: str, text: Column, window: int = WINDOW, overlap: int = OVERLAP, trigger: int = TRIGGER, flush: bool = False) -> DataFrame:
    """(source, start, end, text, content_hash): windows of a count of items, each beginning ``overlap`` before the end of the last.

    A source whose open items are fewer than ``trigger`` waits, unless flushed. Items are numbered by
    ``place``; an item belongs to at most ceil(window / (window - overlap)) windows, so no window of all
    items is built.
    """
    if not 0 <= overlap < window:
        raise ValueError("overlap must be less than window")
    step = window - overlap
    rows = numbered(items.select(source, F.col(place).alias("_place"), text.alias("_text")), source, "_place")
    if not flush:
        rows = rows.where(F.col("_n") >= trigger)
    # Window w covers [w * step, w * step + window); the last one is the first that reaches the end.
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - window) / F.lit(step)))
    first_of = F.greatest(F.lit(0), F.ceil((F.col("_i") - window + 1) / F.lit(step)))
    own = rows.select("*", F.explode(F.sequence(first_of, F.least(F.floor(F.col("_i") / step), last))).alias("_w"))
    grouped = own.groupBy(source, "_w").agg(F.min("_i").alias("start"), (F.max("_i") + 1).alias("end"), F.sort_array(F.collect_list(F.struct("_i", "_text"))).alias("parts"))
    body = F.array_join("parts._text", "\n\n")
    return grouped.select(source, "start", "end", body.alias("text"), F.sha2(body, 256).alias("content_hash"))


def unseen(found: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Windows whose content was not processed before, each content once."""
    first = Window.partitionBy(*keys).orderBy("start")
    return found.join(history.select(*keys).distinct(), keys, "left_anti").withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def stamped(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows with the provenance of their chunk: its hash, and its locator or else the content itself."""
    digest = F.sha2(F.col(text), 256)
    kind = F.coalesce("locator_kind", F.lit("content"))
    return rows.withColumn("provenance", F.struct(kind.alias("kind"), F.coalesce("locator_key", F.concat(F.lit("content:"), digest)).alias("key"), digest.alias("content_hash")))


def sentences(text: Column) -> Column:
    """Stands in for a language model's extraction: the sentences of a text."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def extract(chunks: DataFrame, extractor: Callable[[Column], Column] = sentences) -> DataFrame:
    """(source_id, place, statement, id): the statements of each chunk; a chunk without any gives none."""
    out = chunks.select("source_id", F.posexplode(extractor(F.col("text"))).alias("place", "statement"))
    return out.withColumn("id", F.sha2(F.concat_ws("#", F.col("source_id").cast("string"), F.col("place").cast("string"), "statement"), 256))


def extract_each(chunks: DataFrame, extractor: Callable[[str], list[str]], mode: str = "parallel", width: int = 5) -> DataFrame:
    """(source_id, place, statements, error): each chunk (source_id, place, text) by itself.

    A chunk whose extraction fails has null statements and its error, and leaves the others alone. ``mode``
    says how many are at work: ``serial`` one, ``batched`` at most ``width``, ``parallel`` as many as there
    are partitions. ``place`` keeps the order whatever the mode. A null text is given to the extractor as it is.
    """
    if mode not in ("serial", "parallel", "batched") or width < 1:
        raise ValueError(f"no such mode: {mode} of {width}")
    rows = chunks.select("source_id", "place", "text")
    if mode != "parallel":
        rows = rows.coalesce(1 if mode == "serial" else width)
    ready(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found, errors = [], []
            for t in f["text"]:
                try:
                    found.append(list(extractor(t)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - isolation of chunks is the contract
                    found.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield f[["source_id", "place"]].assign(statements=found, error=errors)

    kind = chunks.schema["source_id"].dataType.simpleString()
    return rows.withColumn("place", F.col("place").cast("bigint")).mapInPandas(run, f"source_id {kind}, place bigint, statements array<string>, error string")


def zipped(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Chunks (source_id, place, ...) side by side with their results of the same source and place; one without a result has nulls."""
    return chunks.join(results, ["source_id", "place"], "left")


def chunk_entities(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """(chunk_id, place, id, kind, name, labels) of the entities that the mentions (chunk_id, place, span, type) of all chunks name.

    A span and type is one name, wherever it occurs. It is a known entity (id, name, labels) of that
    normalised name (REFERENCE if that has all its labels, else UPDATED), or else NEW: names of all chunks
    are resolved as one batch, and the new entity's id comes from the first of them.
    """
    named = mentions.where(F.trim("span") != "").select("chunk_id", "place", F.trim("span").alias("name"), "type")
    missing = F.count_if(F.col("place").isNull())
    kinds = named.groupBy("name", "type").agg(F.when(missing == 0, F.min("place")).alias("place"), F.count("*").alias("n"))
    qid = F.sha2(F.concat_ws("|", F.lower("name"), F.lower("type")), 256)
    kinds = checkpoint(kinds.withColumn("labels", F.array("type")).withColumn("qid", qid))
    asked = checkpoint(kinds.groupBy("qid").agg(F.min(F.struct("place", "name", "labels")).alias("b")).select("qid", "b.name", "b.labels"))
    old = resolve.known_entities(asked, known).select("qid", F.col("id"), F.when(F.col("kind") == "EXISTING", "UPDATED").otherwise("REFERENCE").alias("kind"))
    new = resolve.batch_entities(asked.join(old.select("qid"), "qid", "left_anti")).select("qid", F.concat(F.lit("new-"), "entity").alias("id"), F.lit("NEW").alias("kind"))
    found = checkpoint(kinds.join(old.unionByName(new), "qid").select(F.col("name").alias("_name"), F.col("type").alias("_type"), "id", "kind", "n"))
    same = (F.col("name") == F.col("_name")) & F.col("type").eqNullSafe(F.col("_type"))
    # A name of many mentions is sent to all of them, so that they aren't gathered in one task; there are few of those.
    often, rest = found.where(F.col("n") > OFTEN), found.where(F.col("n") <= OFTEN)
    out = ["chunk_id", "place", "id", "kind", "name", F.array("type").alias("labels")]
    rows = named.join(F.broadcast(often), same).select(*out)
    if rest.isEmpty():
        return rows
    return rows.unionByName(named.join(F.broadcast(often), same, "left_anti").join(rest, same).select(*out))
