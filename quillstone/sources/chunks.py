"""Text files and their chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, text) of text files, each whole."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("source_id"), F.decode("content", "UTF-8").alias("text"))


def chunk(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """(source_id, nth, start, chunk, content_hash): all of each text in pieces of a size, each beginning ``overlap`` before the end of the last."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((F.length("text") - overlap) / F.lit(step))).cast("int")
    rows = texts.where("text IS NOT NULL").select("source_id", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("nth"))
    piece = F.substring("text", F.col("nth") * step + 1, F.lit(size))
    return rows.select("source_id", "nth", (F.col("nth") * step).alias("start"), piece.alias("chunk"), F.sha2(piece, 256).alias("content_hash"))
