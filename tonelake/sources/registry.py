"""The table of scanned folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.operators.maintenance import forget_folder, upsert_folder

SCHEMA = "path string, last_scan_time double, song_count bigint, total_songs_in_db bigint"


class FolderRegistry:
    """Snapshots of a small table, one folder per snapshot."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def create(self) -> "FolderRegistry":
        self._write(self.spark.createDataFrame([], SCHEMA), 0)
        return self

    def _write(self, rows: DataFrame, snapshot: int) -> None:
        rows.write.parquet(f"{self.path}/rows/snapshot={snapshot}")
        self.spark.createDataFrame([(snapshot,)], "n int").coalesce(1).write.mode("append").parquet(
            f"{self.path}/snapshots"
        )

    def _last(self) -> int:
        return self.spark.read.schema("n int").parquet(f"{self.path}/snapshots").agg(F.max("n")).first()[0]

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/rows/snapshot={self._last()}")

    def upsert(self, scans: DataFrame) -> None:
        self._write(upsert_folder(self.read(), scans), self._last() + 1)

    def forget(self, path: str) -> None:
        self._write(forget_folder(self.read(), path), self._last() + 1)
