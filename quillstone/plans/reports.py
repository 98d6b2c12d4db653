"""Reports: counts, tops and their text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import effective_confidence
from ..operators.query import QuerySpec, query
from ..schema import KNOWLEDGE_TYPES, LIFECYCLES

SECTIONS = {"SEMANTIC": "Known facts", "PROCEDURAL": "Preferences", "EPISODIC": "Recent events", "WORKING": "Current context"}


def counts(props: DataFrame) -> DataFrame:
    """(dimension, value, n): rows by status, by level, and all, in one pass over the rows."""
    sets = props.select("status", F.col("level").cast("string").alias("level")).groupingSets([["status"], ["level"], []], "status", "level").agg(F.count("*").alias("n"), F.grouping("status").alias("gs"), F.grouping("level").alias("gl"))
    name = F.when(F.col("gs") == 0, "status").when(F.col("gl") == 0, "level").otherwise("total")
    return sets.select(name.alias("dimension"), F.coalesce("status", "level", F.lit("")).alias("value"), "n")


def top(props: DataFrame, as_of: str, n: int = 10) -> DataFrame:
    return query(props, QuerySpec(order_by="effective_confidence", as_of=as_of, limit=n)).select("id", "text", effective_confidence(as_of).alias("effective"))


def summary(props: DataFrame) -> DataFrame:
    """One row: the counts as a text."""
    line = F.concat(F.col("dimension"), F.when(F.col("value") != "", F.concat(F.lit(" "), F.col("value"))).otherwise(""), F.lit(": "), F.col("n").cast("string"))
    return counts(props).select(F.struct("dimension", "value", line.alias("line")).alias("s")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["line"]), "\n").alias("summary"))


def health(records: DataFrame) -> DataFrame:
    """(target, PROJECTED, ADOPTED, ...): projection records of each target by lifecycle."""
    return records.groupBy("target").agg(*[F.count_if(F.col("lifecycle") == x).alias(x.lower()) for x in LIFECYCLES]).orderBy("target")


def memory_sections(typed: DataFrame, most: int = 5) -> DataFrame:
    """(kind, title, body): for each knowledge type its most certain texts, a line each."""
    from pyspark.sql import Window

    w = Window.partitionBy("kind").orderBy(F.desc("confidence"), "id")
    rows = typed.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
    title = F.create_map(*[F.lit(x) for k in KNOWLEDGE_TYPES for x in (k, SECTIONS[k])])[F.col("kind")]
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "text"))), lambda x: F.concat(F.lit("- "), x["text"])), "\n")
    return rows.groupBy("kind").agg(body.alias("body")).select("kind", title.alias("title"), "body")
