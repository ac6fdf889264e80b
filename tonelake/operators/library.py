"""Browsing the catalog: defaults, responses, filters, sorts, counts, folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions.numbers import js_round, text_or
from tonelake.plans.ranking import match_quality
from tonelake.rules import AUDIO_EXTENSIONS
from tonelake.session import settle

LIST_LIMIT = 500


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def base_name(path: Column) -> Column:
    """File name without its extension; a leading dot is no extension."""
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]*$", "")


def is_audio(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(AUDIO_EXTENSIONS)


def default_tags(tags: DataFrame) -> DataFrame:
    """Ingest defaults: the file name as title, 'Unknown' artist and album, no genre."""
    return tags.withColumns({
        "title": F.coalesce(F.nullif(F.col("title"), F.lit("")), base_name(F.col("filepath"))),
        "artist": text_or(F.col("artist"), "Unknown Artist"),
        "album": text_or(F.col("album"), "Unknown Album"),
        "genre": text_or(F.col("genre"), ""),
    })


def song_response(songs: DataFrame) -> DataFrame:
    """What a client sees of a song, scored or not."""
    has = lambda c, t: F.col(c).cast(t) if c in songs.columns else F.lit(None).cast(t)
    return songs.select(
        "id", text_or(F.col("title"), "Unknown").alias("title"),
        text_or(F.col("artist"), "Unknown").alias("artist"),
        text_or(F.col("album"), "Unknown").alias("album"), text_or(F.col("genre"), "").alias("genre"),
        "filepath", "bpm", "energy", "valence", "arousal",
        F.coalesce(F.col("has_lyrics").cast("boolean"), F.lit(False)).alias("has_lyrics"),
        has("score", "double").alias("score"), has("semantic_score", "double").alias("semantic_score"),
        match_quality(has("score", "double")).alias("match_quality"),
    )


def score_band(score: Column) -> Column:
    """Colour band of a score in the player."""
    return (
        F.when(F.coalesce(score, F.lit(0.0)) == 0, "muted").when(score >= 70, "emerald")
        .when(score >= 50, "amber").when(score >= 35, "orange").otherwise("red")
    )


def percent_views(energy: Column, valence: Column) -> tuple[Column, Column]:
    """(energy %, mood %)."""
    return js_round(energy * 100.0), js_round((valence + 1.0) * 50.0)


def duration_text(seconds: Column) -> Column:
    """m:ss, or --:-- when unknown."""
    s = F.floor(seconds).cast("int")
    text = F.format_string("%d:%02d", F.floor(s / 60).cast("int"), s % 60)
    return F.when(F.coalesce(seconds, F.lit(0.0)) == 0, "--:--").otherwise(text)


def duration_text_long(seconds: Column) -> Column:
    """h:mm:ss from one hour on, else m:ss."""
    s = F.floor(F.coalesce(seconds, F.lit(0.0))).cast("int")
    hours = F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60)
    short = F.format_string("%d:%02d", F.floor(s / 60).cast("int"), s % 60)
    return F.when(s >= 3600, hours).otherwise(short)


def songs_in(songs: DataFrame, keys: DataFrame, on: str = "id") -> DataFrame:
    return songs.join(keys.select(on), on, "left_semi")


def without_lyrics(songs: DataFrame) -> DataFrame:
    """Candidates of the background lyrics pass."""
    return songs.filter(
        ~F.coalesce(F.col("has_lyrics"), F.lit(False)) & (F.coalesce("lyrics_text", F.lit("")) == "")
    )


def pending(songs: DataFrame) -> DataFrame:
    return songs.filter(~F.coalesce(F.col("lyrics_processed"), F.lit(True)))


def matches_text(query: str, columns=("title", "artist", "album", "genre")) -> Column:
    """Case-insensitive substring in any of the columns. The short view leaves genre out."""
    needle = F.lower(F.lit(query))
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), needle)
    return out


def stored_lyrics(songs: DataFrame) -> DataFrame:
    return songs.select("id", F.nullif(F.col("lyrics_text"), F.lit("")).alias("lyrics_text"))


def library_stats(songs: DataFrame, folders: DataFrame) -> DataFrame:
    """One row of counts: two column-pruned aggregations, one-row results put side by side."""
    s = songs.agg(
        F.count("*").alias("song_count"), F.count("clap_embedding").alias("clap_count"),
    ).withColumn("folder_count", folders.agg(F.count("*").alias("n")).scalar())
    return s.withColumn("is_empty", F.col("song_count") == 0)


def progress_counts(songs: DataFrame) -> DataFrame:
    return songs.agg(
        F.count("bpm").alias("with_audio"),
        F.count_if(F.coalesce(F.col("has_lyrics"), F.lit(False))).alias("with_lyrics"),
    )


def library_order(by: str, newest: str = "id") -> list[Column]:
    """By title, artist or album in locale order, or newest first; ids settle ties.

    ``newest`` is the column that grows with time: a serial id, or ``file_mtime`` of the stored
    catalog, whose ids are hashes.
    """
    if by == "recent":
        return [F.desc(newest), F.desc("id")]
    return [F.asc(F.expr(f"coalesce(`{by}`, '') COLLATE UNICODE")), F.asc("id")]


def sorted_library(songs: DataFrame, by: str, limit: int | None = None, newest: str = "id") -> DataFrame:
    """The library in :func:`library_order`. With a limit: a top-k."""
    out = songs.orderBy(*library_order(by, newest))
    return out.limit(limit) if limit else out


def with_rank(rows: DataFrame, order: list[Column], out: str = "rank", parts: int | None = None) -> DataFrame:
    """Add each row's place, from 1, in a total order of all rows, without a task that sees all of them.

    Rows are dealt by ranges of the order and sorted there; a range's place is the number of rows in the
    ranges before it. The dealt rows are a stored table, as ranges are drawn anew each time they are computed.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = settle(dealt.withColumns({"_part": F.spark_partition_id(), "_at": at}), "ranked")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    return placed.join(F.broadcast(starts), "_part").withColumn(out, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def list_songs(songs: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    return songs.orderBy("id").limit(limit)


def folder_list(folders: DataFrame) -> DataFrame:
    """Folders, the latest scan first, with the time as text and their ``rank`` in that order."""
    t = F.col("last_scan_time")
    known = F.coalesce(t, F.lit(0.0)) != 0
    text = F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd HH:mm")
    rows = folders.select(
        "path", "last_scan_time", F.when(known, text).otherwise("Unknown").alias("last_scan_formatted"),
        "song_count", "total_songs_in_db",
    )
    return with_rank(rows, [F.desc("last_scan_time"), F.asc("path")])


def folder_rollup(files: DataFrame) -> DataFrame:
    """Every directory with whether any file below it is audio.

    Each path opens into its ancestors; the flag is combined on the map side, so a root that is
    above every file costs no more than any other.
    """
    parts = F.split("filepath", "/")
    depth = F.size(parts) - 1
    above = F.transform(
        F.sequence(F.lit(1), F.greatest(depth, F.lit(1))),
        lambda n: F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, n), "/")),
    )
    rows = files.select(F.explode_outer(above).alias("path"), is_audio(F.col("filepath")).alias("audio"))
    return rows.groupBy("path").agg(F.bool_or("audio").alias("has_audio"))


def browse(files: DataFrame, directory: str) -> DataFrame:
    """Entries of one directory: folders first, then by name; dot names hidden."""
    prefix = directory.rstrip("/") + "/"
    inside = files.filter(F.col("filepath").startswith(prefix))
    rest = F.substring(F.col("filepath"), len(prefix) + 1, 1 << 30)
    name = F.substring_index(rest, "/", 1)
    entries = inside.select(
        name.alias("name"), F.contains(rest, F.lit("/")).alias("is_dir"), is_audio(F.col("filepath")).alias("audio")
    ).filter(~F.col("name").startswith("."))
    return (
        entries.groupBy("name", "is_dir")
        .agg((F.col("is_dir") & F.bool_or("audio")).alias("has_audio"))
        .select("name", F.concat(F.lit(prefix), "name").alias("path"), "is_dir", "has_audio")
        .orderBy(F.desc("is_dir"), F.lower("name"), "name")
    )
