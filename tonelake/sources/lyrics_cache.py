"""A table of lyrics already found, keyed by file, title and artist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions.text import strip
from tonelake.operators.lyrics import resolve_sources


def cache_key(filepath: Column, title: Column, artist: Column) -> Column:
    name = lambda c: F.coalesce(c, F.lit("None"))
    return F.substring(F.md5(F.concat_ws("|", name(filepath), name(title), name(artist))), 1, 16)


def keyed(songs: DataFrame) -> DataFrame:
    return songs.withColumn("cache_key", cache_key(F.col("filepath"), F.col("title"), F.col("artist")))


def cached_lyrics(songs: DataFrame, cache: DataFrame) -> DataFrame:
    """Left lookup: stripped text, NULL when missing or blank."""
    texts = cache.select("cache_key", F.nullif(strip(F.col("text")), F.lit("")).alias("cached_text"))
    return keyed(songs).join(texts, "cache_key", "left")


def new_entries(found: DataFrame, cache: DataFrame) -> DataFrame:
    """Entries to append: filled texts whose key the cache lacks, one per key."""
    rows = keyed(found).filter(F.coalesce(strip(F.col("text")), F.lit("")) != "").select("cache_key", "text")
    fresh = rows.groupBy("cache_key").agg(F.min("text").alias("text"))
    return fresh.join(cache.select("cache_key"), "cache_key", "left_anti")


def song_lyrics(songs: DataFrame, candidates: DataFrame, cache: DataFrame, ordinal: str | None = None) -> DataFrame:
    """``id, source, lyrics_text`` of songs (id, filepath, title, artist, lyrics_text) and candidates (id, source, text).

    A stored text wins; only songs without one ask the cache and the candidates, and those without any text
    have no row.
    """
    blank = F.coalesce(F.col("lyrics_text"), F.lit("")) == ""
    stored = songs.filter(~blank).select("id", F.lit("stored").alias("source"), "lyrics_text")
    waiting = songs.filter(blank)
    columns = ["id", "source", "text", "_h", *([ordinal] if ordinal else [])]
    others = candidates.filter(~F.col("source").isin("stored", "cache")).withColumn("_h", F.xxhash64("text"))
    entries = cache.filter(strip(F.col("text")) != "").select("cache_key", "text", F.xxhash64("text").alias("_h"))
    cached = keyed(waiting).select("id", "cache_key").join(entries, "cache_key").withColumn("source", F.lit("cache"))
    if ordinal:
        cached = cached.withColumn(ordinal, F.lit(0).cast(candidates.schema[ordinal].dataType))
    rows = others.join(waiting.select("id"), "id", "left_semi").select(columns).unionByName(cached.select(columns))
    found = resolve_sources(rows, "id", ordinal).filter(F.col("lyrics_text").isNotNull())
    return stored.unionByName(found)


def write_back(songs: DataFrame, resolved: DataFrame) -> DataFrame:
    """``songs`` with the texts that were found for those that had none; ``resolved`` from :func:`song_lyrics`."""
    found = resolved.filter(F.col("source") != "stored").select("id", F.col("lyrics_text").alias("_found"))
    rows = songs.join(found, "id", "left")
    return rows.withColumn("lyrics_text", F.coalesce("_found", "lyrics_text")).select(songs.columns)


def cache_additions(songs: DataFrame, resolved: DataFrame, cache: DataFrame) -> DataFrame:
    """Entries for texts that came from a file beside the song, its tags or online; the cache's own and stored ones are no news."""
    found = resolved.filter(~F.col("source").isin("stored", "cache")).select("id", F.col("lyrics_text").alias("text"))
    return new_entries(songs.select("id", "filepath", "title", "artist").join(found, "id"), cache)


def cache_stats(cache: DataFrame) -> DataFrame:
    """Entry count and size in MB."""
    size = F.sum(F.octet_length("text")) / F.lit(1048576.0)
    return cache.agg(
        F.count("*").alias("entries"), F.coalesce(F.round(size, 2), F.lit(0.0)).alias("size_mb")
    )
