"""The stored catalog: parquet in hash buckets of the path, with snapshots.

A change reads and rewrites only the buckets it touches, a few at a time, into new version folders; a manifest row
per bucket then points to its newest version. Nothing is overwritten while it is read, a reader
keeps the snapshot it started with, and a failed change leaves the old snapshot in place. One writer at
a time: two that start from the same snapshot are noticed only where the folder's file system makes
creating a folder atomic. Old versions stay until the folder is removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.operators import maintenance as m
from tonelake.session import release, settle, shuffles_removed

SONG_COLUMNS = {
    "id": "bigint", "filepath": "string", "file_mtime": "double", "title": "string",
    "artist": "string", "album": "string", "genre": "string", "bpm": "double", "energy": "double",
    "brightness": "double", "valence": "double", "arousal": "double", "mode": "string",
    "spectral_rolloff": "double", "spectral_bandwidth": "double", "dynamic_range": "double",
    "mfccs": "array<double>", "key_confidence": "double", "harmonic_ratio": "double",
    "has_lyrics": "boolean", "lyrics_text": "string", "lyrics_processed": "boolean",
    "lyrics_emotion": "string", "lyrics_emotion_score": "double",
    "emotion_distribution": "map<string,double>", "mood_words": "array<string>",
    "rich_description": "string", "embedding": "array<float>", "clap_embedding": "array<float>",
}
SCHEMA = ", ".join(f"`{c}` {t}" for c, t in SONG_COLUMNS.items())
BUCKETS = 256  # choose so that one bucket stays in the range of 10 GB
SLICE = 1 << 29  # stored bytes that a job of a change reads, unless one bucket has more; some five times as much is shuffled


def conform(rows: DataFrame) -> DataFrame:
    """The catalog's columns in order; missing ones are NULL."""
    return rows.select(*[
        (F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in SONG_COLUMNS.items()
    ])


class Catalog:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # -- reading

    def _names(self, folder: str) -> list[str]:
        """Names in a folder below the catalog, none if it does not exist."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def _manifest(self) -> tuple[int, dict[int, str]]:
        """(snapshot, {bucket: version}) of the last snapshot that was written whole; at most ``buckets`` small rows."""
        found = sorted((int(n.split("=")[1]) for n in self._names("manifest") if n.startswith("snapshot=")), reverse=True)
        last = next(n for n in found if "_SUCCESS" in self._names(f"manifest/snapshot={n}"))
        rows = self.spark.read.schema("bucket int, version string").parquet(f"{self.path}/manifest/snapshot={last}")
        return last, {r.bucket: r.version for r in rows.collect() if r.bucket >= 0}

    def _paths(self, manifest: dict[int, str], only: list[int] | None = None) -> DataFrame:
        paths = [
            f"{self.path}/data/version={v}/bucket={b}"
            for b, v in sorted(manifest.items()) if only is None or b in only
        ]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*paths)

    def read(self) -> DataFrame:
        return self._paths(self._manifest()[1])

    def vectors(self, column: str = "embedding") -> DataFrame:
        """(id, vector) of the songs that have one."""
        return self.read().filter(F.col(column).isNotNull()).select("id", column)

    # -- writing

    def bucket(self, path: Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> dict[int, str]:
        """Write rows as a new version, {bucket: version}; AQE sizes the files of large buckets."""
        version = uuid.uuid4().hex[:12]
        target = f"{self.path}/data/version={version}"
        bucketed = conform(rows).withColumn("bucket", self.bucket(F.col("filepath")))
        with shuffles_removed(rows.sparkSession):
            bucketed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(target)
        return {int(n.split("=")[1]): version for n in self._names(f"data/version={version}") if n.startswith("bucket=")}

    def _publish(self, snapshot: int, manifest: dict[int, str]) -> None:
        rows = list(manifest.items()) or [(-1, "")]
        self.spark.createDataFrame(rows, "bucket int, version string").coalesce(1).write.parquet(
            f"{self.path}/manifest/snapshot={snapshot}"
        )

    def create(self, rows: DataFrame | None = None) -> "Catalog":
        rows = rows if rows is not None else self.spark.createDataFrame([], SCHEMA)
        self._publish(0, self._write(rows))
        return self

    def _slices(self, manifest: dict[int, str], only: list[int], changes: list[DataFrame]) -> list[list[int]]:
        """The buckets in runs whose files, with their share of the stored changes, have some ``SLICE`` bytes."""
        conf = self.spark._jsc.hadoopConfiguration()

        def size(name: str) -> int:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            return path.getFileSystem(conf).getContentSummary(path).getLength()

        total = sum(size(f"{self.path}/data/version={manifest[b]}/bucket={b}") for b in only if b in manifest)
        n = -(-(total + sum(size(t._settled) for t in changes)) // SLICE)
        each = max(1, len(only) // max(1, n))
        return [sorted(only)[i : i + each] for i in range(0, len(only), each)]

    def replace(self, change: Callable[..., DataFrame], touched: DataFrame | None = None, *changes: DataFrame) -> None:
        """New snapshot from ``change(current rows)``; with ``touched`` paths only their buckets.

        With ``changes``, stored tables of paths, a few buckets are changed at a time: ``change(current rows, *changes)``
        gets their rows of each table, so what a job shuffles is bounded, however much the change touches.
        """
        last, manifest = self._manifest()
        only = None
        if touched is not None:
            ids = touched.select(self.bucket(F.col("filepath")).alias("b")).distinct().collect()
            only = [r.b for r in ids]
        written = {}
        if not changes:
            written = self._write(change(self._paths(manifest, only)))
        for some in self._slices(manifest, only, changes) if changes else ():
            inside = self.bucket(F.col("filepath")).isin(some)
            written |= self._write(change(self._paths(manifest, some), *[t.filter(inside) for t in changes]))
        kept = {} if only is None else {b: v for b, v in manifest.items() if b not in only}
        self._publish(last + 1, {**kept, **written})

    def upsert(self, rows: DataFrame) -> None:
        self.update(m.fresh_rows(rows))

    def delete_paths(self, paths: DataFrame) -> None:
        paths = settle(paths.select("filepath"), "deleted")
        self.replace(lambda current, gone: current.join(gone, "filepath", "left_anti"), paths, paths)
        release(paths)

    def delete_folder(self, folder: str, registry=None) -> None:
        """Remove a folder's songs and, with the registry given, its entry."""
        self.replace(lambda current: m.delete_folder(current, folder))
        if registry is not None:
            registry.forget(folder)

    def update(self, rows: DataFrame) -> None:
        """Replace whole rows as given, id and vectors included."""
        rows = settle(conform(rows), "changes")
        self.replace(m.upsert, rows, rows)
        release(rows)

    def clear(self, column: str | None = None) -> None:
        """Empty the catalog, or one vector column."""
        self.replace(lambda current: m.clear_vectors(current, column) if column else current.limit(0))

    def fill_vectors(self, vectorise: Callable[[Column], Column], column: str = "embedding") -> None:
        lacking = self.read().filter(F.col(column).isNull() & F.col("rich_description").isNotNull())
        self.update(m.fill_vectors(lacking, vectorise, out=column))

    def reprocess(self, vectorise: Callable[[Column], Column]) -> None:
        from tonelake.operators.library import pending

        self.update(m.reprocess(pending(self.read()), vectorise))

    def apply_lyrics(self, found: DataFrame) -> None:
        current = self.read()
        hit = current.join(found.select("id"), "id", "left_semi")
        self.update(m.apply_lyrics(hit, found))

    def sync(self, files: DataFrame, process: Callable[[DataFrame], DataFrame], folder: str | None = None,
             force: bool = False) -> DataFrame:
        """Incremental scan: process new and changed files, drop vanished ones; returns the diff.

        ``process`` maps (filepath, file_mtime) rows to catalog rows. ``force`` starts from nothing.
        """
        if force:
            self.clear()
        diff = settle(m.diff_files(files, self.read(), folder), "diff")
        vanished = lambda d: d.filter(F.col("status") == "deleted").select("filepath")
        changed = diff.filter(F.col("status").isin("new", "modified"))
        if diff.filter(F.col("status").isin("new", "modified", "deleted")).isEmpty():
            return diff
        rows = process(changed.select("filepath", F.col("disk_mtime").alias("file_mtime")))
        rows = settle(conform(m.fresh_rows(rows)), "changes")
        # vanished and replaced rows leave in the same rewrite of their buckets
        self.replace(
            lambda current, rows, diff: m.upsert(current.join(vanished(diff), "filepath", "left_anti"), rows),
            vanished(diff).unionByName(rows.select("filepath")), rows, diff,
        )
        release(rows)
        return diff
