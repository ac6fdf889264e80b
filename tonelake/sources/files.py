"""Listing audio files and reading sidecar lyrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.operators.library import is_audio
from tonelake.rules import AUDIO_EXTENSIONS


def _any_case(extensions: list[str]) -> str:
    either = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
    return "*.{" + ",".join(either(e) for e in extensions) + "}"


def _binary(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", _any_case(extensions)).load(root)
    )


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def base_path(path: Column) -> Column:
    """Path without the extension."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def list_audio(spark: SparkSession, root: str) -> DataFrame:
    """(filepath, file_mtime) of the audio files below ``root``; contents are not read."""
    rows = _binary(spark, root, AUDIO_EXTENSIONS).select(
        plain_path(F.col("path")).alias("filepath"),
        (F.unix_micros("modificationTime") / 1e6).alias("file_mtime"),
    )
    return rows.filter(is_audio(F.col("filepath")))


def listing(rows: DataFrame) -> DataFrame:
    """The same from a listing table with (filepath, file_mtime)."""
    return rows.select("filepath", F.col("file_mtime").cast("double").alias("file_mtime")).filter(
        is_audio(F.col("filepath"))
    )


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(base, source, text) of the .lrc and .txt files below ``root``."""
    rows = _binary(spark, root, ["lrc", "txt"]).select(
        plain_path(F.col("path")).alias("path"), F.col("content").cast("string").alias("text")
    )
    source = F.when(F.col("path").rlike(r"\.lrc$"), "sidecar_lrc").otherwise("sidecar_txt")
    return rows.filter(F.col("path").rlike(r"\.(lrc|txt)$")).select(
        base_path(F.col("path")).alias("base"), source.alias("source"), "text"
    )


def sidecar_candidates(songs: DataFrame, sidecars: DataFrame, key: str = "id") -> DataFrame:
    """Sidecars next to each song, as rows for the source resolution."""
    return songs.select(F.col(key).alias("song_id"), base_path(F.col("filepath")).alias("base")).join(
        sidecars, "base"
    ).select("song_id", "source", "text")
