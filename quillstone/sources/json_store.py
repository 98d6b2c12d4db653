"""A small store kept in one JSON folder: read whole, rewritten whole, swapped in by a rename."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.store import upsert
from ..schema import PROPOSITIONS


class JsonStore:
    """Capabilities that it lacks answer empty instead of failing."""

    searches_vectors = False
    walks_graphs = False

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str) -> tuple[object, object]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def load(self) -> DataFrame:
        fs, where = self._fs(self.path)
        if not fs.exists(where):
            return self.spark.createDataFrame([], PROPOSITIONS)
        return self.spark.read.schema(PROPOSITIONS).json(self.path)

    def save_all(self, rows: DataFrame) -> None:
        """Writes beside the folder first; if that fails, the folder is as before."""
        fs, old = self._fs(self.path)
        _, fresh = self._fs(self.path + ".new")
        fs.delete(fresh, True)
        upsert(self.load(), rows, ["id"]).write.json(self.path + ".new")
        _, gone = self._fs(self.path + ".old")
        fs.delete(gone, True)
        if fs.exists(old):
            fs.rename(old, gone)
        if not fs.rename(fresh, old):
            fs.rename(gone, old)
            raise OSError(f"could not replace {self.path}")
        fs.delete(gone, True)

    def similar(self, *_: object) -> DataFrame:
        return self.spark.createDataFrame([], "id string, score double")
