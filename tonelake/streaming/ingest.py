"""Continuous ingest: listings arrive as files, every micro-batch brings the catalog up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tonelake.operators import library as lib
from tonelake.operators import maintenance as m
from tonelake.operators.emotion import average_emotions, summarise_emotions
from tonelake.operators.lyrics import analysis_text, explode_chunks, resolve_lookup
from tonelake.session import release, settle
from tonelake.sources.catalog import Catalog, conform
from tonelake.streaming.progress import observed

LISTING_SCHEMA = "filepath string, file_mtime double"


def newest_listing(batch: DataFrame) -> DataFrame:
    """One row per path: a micro-batch may list a file twice."""
    return batch.groupBy("filepath").agg(F.max("file_mtime").alias("file_mtime"))


def ingest_batch(catalog: Catalog, batch: DataFrame, process: Callable[[DataFrame], DataFrame]) -> None:
    """Upsert the new and changed files of one batch. Repeating a batch changes nothing."""
    files = settle(newest_listing(batch), "listing")
    diff = m.diff_files(files, catalog.read())
    changed = settle(diff.filter(F.col("status").isin("new", "modified")), "changed")
    if not changed.isEmpty():
        catalog.upsert(process(changed.select("filepath", F.col("disk_mtime").alias("file_mtime"))))
    release(files, changed)


def ingest_stream(
    spark: SparkSession, listings: str, catalog: Catalog, process: Callable[[DataFrame], DataFrame],
    checkpoint: str, files_per_batch: int = 100, schema: str = LISTING_SCHEMA,
) -> StreamingQuery:
    """Start the stream over a folder of parquet listings; ends when all present files are read.

    A :class:`BatchCallback` is told of every batch; files without a time count as failed.
    """
    stream = observed(
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(listings),
        F.col("filepath"), F.col("file_mtime").isNull(),
    )
    return (
        stream.writeStream.foreachBatch(lambda batch, _: ingest_batch(catalog, batch, process))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def analyse_lyrics(found: DataFrame, score: Callable[[DataFrame], DataFrame], key: str = "id") -> DataFrame:
    """Emotion fields of found lyrics: clean, chunk, score, average, summarise."""
    texts = found.select(key, "lyrics_text", analysis_text(F.col("lyrics_text")).alias("_text"))
    scores = score(explode_chunks(texts, "_text", key))
    summary = summarise_emotions(average_emotions(scores, key), key)
    return found.select(key, "lyrics_text").join(summary, key, "left")


LOOKUPS = "id long, title string, artist string, source string, ordinal long, text string, synced string, failed boolean"
RESULT = "id bigint, outcome string, lyrics_text string, lyrics_emotion string, lyrics_emotion_score double, lyrics_valence double, mood_words array<string>, emotion_distribution map<string,double>"


def lyrics_results(asked: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row per song of ``asked`` (rows as in ``LOOKUPS``): its outcome, and the text found with its emotions.

    found: a lookup has a good text; error: none has, and one of them failed; not_found: all others.
    """
    failed = F.coalesce(F.col("failed"), F.lit(False))
    songs = asked.groupBy("id").agg(F.bool_or(failed).alias("failed"))
    found = settle(resolve_lookup(asked.filter(~failed), "id", "ordinal").select("id", "lyrics_text"), "found")
    rows = songs.join(analyse_lyrics(found, score), "id", "left")
    outcome = F.when(F.col("lyrics_text").isNotNull(), "found").when(F.col("failed"), "error").otherwise("not_found")
    rows = rows.withColumn("outcome", outcome)
    return rows.select(*[F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in RESULT.split(", ")])


def lyrics_batch(
    catalog: Catalog, batch: DataFrame, log: str, score: Callable[[DataFrame], DataFrame], vectorise: Callable[[Column], Column],
) -> None:
    """Find lyrics for the songs of ``batch`` that lack them, and bring their rows up to date in one change.

    What was found is written to ``log`` first, whole or not at all; a batch that comes again takes it from
    there, and only songs that still lack lyrics are changed. So a batch may fail anywhere and be repeated.
    Songs get the text, emotions, valence, a new sentence and its vector, and are not pending afterwards.
    """
    spark = catalog.spark
    waiting = lib.without_lyrics(catalog.read()).select("id")
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{log}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        asked = settle(batch.join(waiting, "id", "left_semi"), "asked")
        lyrics_results(asked, score).write.mode("overwrite").parquet(log)
    found = spark.read.schema(RESULT).parquet(log).filter("outcome = 'found'").join(waiting, "id", "left_semi")
    if not found.isEmpty():
        current = catalog.read().join(found.select("id"), "id", "left_semi")
        catalog.update(m.reprocess(m.apply_lyrics(current, found), vectorise))


def lyrics_stream(
    spark: SparkSession, results: str, catalog: Catalog, log: str, score: Callable[[DataFrame], DataFrame],
    vectorise: Callable[[Column], Column], checkpoint: str, files_per_batch: int = 100,
) -> StreamingQuery:
    """Background lyrics pass over a folder of lookup results (``LOOKUPS``); of several batches the first good text of a song counts.

    Each batch has a folder in ``log``, which belongs to the checkpoint; :func:`lyrics_log` reads them.
    """
    stream = spark.readStream.schema(LOOKUPS).option("maxFilesPerTrigger", files_per_batch).parquet(results)
    told = observed(stream, F.col("title"), F.col("failed"))

    def apply(batch: DataFrame, number: int) -> None:
        lyrics_batch(catalog, batch, f"{log}/batch={number}", score, vectorise)

    return told.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lyrics_log(spark: SparkSession, log: str) -> DataFrame:
    """The results of all batches; :func:`lyrics_outcomes` counts them."""
    return spark.read.schema(RESULT + ", batch int").parquet(log)


__all__ = ["analyse_lyrics", "conform", "ingest_batch", "ingest_stream", "lyrics_batch", "lyrics_log", "lyrics_stream"]
