"""What the operators of this package share: the tables, Arrow batches, words, ranks without hot tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.session import settle

#: Fixed value: a word is a run of anything but the six white-space characters of ASCII.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch; a batch holds whole texts, so it bounds a worker's memory.
BATCH_ROWS = 192


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch of ``df``; batches stay small, as texts can be long.

    Spark reads the bound when the plan runs, which may be after this call, so it stays set in the session:
    with Spark's own bounds (10,000 rows, 64 MB) an executor of the pipeline took more than 3,000 MB.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A batch's texts, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 5; a row without id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0))


def running_sums(df: DataFrame, group: list[str], bin_: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same group that come before this one.

    Rows are in the order of ``bin_``, then of ``order``. Sums of bins give each bin's start, and a window
    runs within a bin only, so a group of any size is spread over as many tasks as it has bins. ``df`` is
    read twice and should be a stored table.
    """
    binned = df.withColumn("_bin", bin_)
    sums = binned.groupBy(*group, "_bin").agg(F.sum(value).alias("_sum"))
    before = sums.select(*group, "_bin", (F.sum("_sum").over(W.partitionBy(*group).orderBy("_bin")) - F.col("_sum")).alias("_before"))
    inside = F.sum(value).over(W.partitionBy(*group, "_bin").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    total = F.col("_before") + F.coalesce(F.col("_inside"), F.lit(0))
    return binned.withColumn("_inside", inside).join(before, [*group, "_bin"]).withColumn(name, total).drop("_bin", "_inside", "_before")


__all__ = ["WORD", "documents", "fold", "labels", "map_batches", "n_bytes", "n_words", "running_sums", "settle", "texts", "words"]
