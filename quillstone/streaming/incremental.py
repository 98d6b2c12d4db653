"""Streaming forms of ingestion: each micro-batch gives what the batch operators give over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_growing(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files to which others are added."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest_once(stream: DataFrame, ledger_path: str, checkpoint_path: str) -> StreamingQuery:
    """Appends each content hash to the ledger folder once.

    A batch is written under its own number, and replaced if it is run again, so a restart repeats nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("content_hash", F.sha2("text", 256)).groupBy("content_hash").agg(F.min("source_id").alias("source_id"))
        where = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            old = spark.read.schema("content_hash string, source_id bigint, batch bigint").parquet(ledger_path).where(F.col("batch") != number)
            fresh = fresh.join(old.select("content_hash"), "content_hash", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{ledger_path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()


def due_windows(stream: DataFrame, source: str, trigger: int) -> DataFrame:
    """(source, n) of sources with at least ``trigger`` items so far, as a streaming aggregate."""
    return stream.groupBy(source).agg(F.count("*").alias("n")).where(F.col("n") >= trigger)


def event_rates(stream: DataFrame, late: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Events by type in tumbling windows of event time. Late data and watermarks are an addition of this package."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
