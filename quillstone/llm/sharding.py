"""Sharding by fixed virtual slots.

A record's slot is fixed for ever: the first three hex digits of the MD5 of its id, one of 4,096. A
small versioned map says which shard holds each slot. Rebalancing edits the map: each shard keeps its
largest slots up to the mean load, the other slots are laid end to end and fill the shards that lack,
and only those slots' records move. Slots are aggregated in one pass; the map has a row a slot,
however large the data, and is sent to all tasks.

Defined results
    null doc_id: the slot of the empty string. null or empty text: 0 bytes; the record still has a slot.
    ties (slots of the same bytes): by slot number. Repeated rows: each is a record of its slot.
    Empty table: no record; the map stays as it is. Other columns are kept by ``assign``, but ``slot``,
    ``shard`` and ``map_version`` are replaced.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ready, shared_folder

SLOTS = 4096
SHARDS = 16


def slot_of(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 3), 16, 10).cast("int")


def slot_loads(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(slot, records, bytes) of each slot that has a record."""
    sized = docs.select(slot_of(docs[id_column]).alias("slot"), F.coalesce(F.octet_length(docs[text_column].cast("string")), F.lit(0)).cast("bigint").alias("n"))
    return sized.groupBy("slot").agg(F.count("*").alias("records"), F.sum("n").alias("bytes"))


@dataclass(frozen=True)
class SlotMap:
    version: int
    shards: int
    shard: np.ndarray  # by slot

    @staticmethod
    def initial(shards: int = SHARDS) -> SlotMap:
        return SlotMap(1, shards, np.arange(SLOTS) * shards // SLOTS)

    def rebalanced(self, loads: DataFrame, shards: int | None = None) -> SlotMap:
        """The next version, for the loads and a number of shards that may have changed."""
        load = np.zeros(SLOTS, np.int64)
        for r in loads.select("slot", "bytes").collect():  # SLOTS rows at most
            load[r[0]] = r[1]
        return self.edited(load, shards or self.shards)

    def edited(self, load: np.ndarray, shards: int) -> SlotMap:
        mean = int(load.sum()) / shards
        new, kept, loose = self.shard.copy(), np.zeros(shards, np.int64), []
        for s in range(max(shards, int(self.shard.max()) + 1)):
            own = np.flatnonzero(self.shard == s)
            own = own[np.lexsort((own, -load[own]))]
            if s >= shards:
                loose += own.tolist()
                continue
            run = np.cumsum(load[own])
            stay = run <= mean
            stay[:1] = True
            kept[s] = load[own[stay]].sum()
            loose += own[~stay].tolist()
        loose = np.array(loose, np.int64)
        loose = loose[np.lexsort((loose, -load[loose]))]
        lack = np.maximum(mean - kept, 0)
        if len(loose):
            weight = load[loose]
            middle = np.cumsum(weight) - weight / 2
            end = np.cumsum(lack)
            scale = end[-1] / weight.sum() if weight.sum() else 0.0
            new[loose] = np.minimum(np.searchsorted(end, middle * scale, side="right"), shards - 1)
        return SlotMap(self.version + 1, shards, new)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, self.shards, k, int(s)) for k, s in enumerate(self.shard)], "version int, shards int, slot int, shard int")

    def save(self, spark: SparkSession, folder: str) -> None:
        """Adds this version to the folder's history; a version that is there is never overwritten."""
        self.rows(spark).drop("version").coalesce(1).write.mode("error").parquet(f"{folder}/version={self.version}")

    @staticmethod
    def latest(spark: SparkSession, folder: str) -> SlotMap | None:
        """The folder's latest version, if there is any."""
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
        return SlotMap.load(spark, folder) if there else None

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        """The given version, or the latest."""
        history = spark.read.parquet(folder)
        if version is None:
            version = history.agg(F.max("version")).first()[0]
        rows = history.where(F.col("version") == version).select("slot", "shard", "shards").collect()
        shard = np.zeros(SLOTS, np.int64)
        for slot, s, _ in rows:
            shard[slot] = s
        return SlotMap(version, rows[0][2], shard)


def assign(docs: DataFrame, slot_map: SlotMap, id_column: str = "doc_id") -> DataFrame:
    """The records with ``slot``, ``shard`` and ``map_version``."""
    spark = ready(docs.sparkSession)
    docs = docs.drop("slot", "shard", "map_version")
    rows = slot_map.rows(spark).select(F.col("slot").alias("_slot"), "shard", F.col("version").alias("map_version"))
    joined = docs.alias("records").join(F.broadcast(rows), slot_of(docs[id_column]) == rows["_slot"])
    return joined.select("records.*", rows["_slot"].alias("slot"), rows["shard"], rows["map_version"])


def shard_documents(docs: DataFrame, shards: int = SHARDS, folder: str | None = None) -> DataFrame:
    """All documents assigned by the folder's latest map, rebalanced once for their bytes and saved there as the next version.

    An empty folder first gets the initial map, as version 1. Without a folder the history is in a new one
    among the session's shared files. A folder has one writer at a time: of two, the later fails.
    """
    spark = ready(docs.sparkSession)
    folder = folder or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    now = SlotMap.latest(spark, folder)
    if now is None:
        now = SlotMap.initial(shards)
        now.save(spark, folder)
    after = now.rebalanced(slot_loads(docs), shards)
    after.save(spark, folder)
    return assign(docs, after)
