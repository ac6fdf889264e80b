"""Keeping the catalog in step with the files: diff, merge, delete, refresh.

Each function maps DataFrames to DataFrames. :class:`tonelake.sources.catalog.Catalog` applies them
to the stored table, touching only the buckets that change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.operators.describe import describe_songs
from tonelake.operators.emotion import blend_valence
from tonelake.operators.lyrics import with_snippet

MTIME_SLACK = 1.0
VECTORS = ["embedding", "clap_embedding"]


def song_id(path: Column) -> Column:
    """Stable id of a path: a changed file keeps it."""
    return F.xxhash64(path)


def under(path: Column, folder: str) -> Column:
    """Inside the folder. '/music' does not hold '/music2/a.mp3'."""
    return path.startswith(folder.rstrip("/") + "/")


def diff_files(files: DataFrame, catalog: DataFrame, folder: str | None = None) -> DataFrame:
    """(filepath, status): new, modified, unchanged, deleted or out_of_scope.

    Only paths and times take part in the join. With ``folder``, catalog rows elsewhere stay.
    """
    disk = files.select("filepath", F.col("file_mtime").alias("disk_mtime"), F.lit(True).alias("on_disk"))
    known = catalog.select("filepath", F.col("file_mtime").alias("known_mtime"), F.lit(True).alias("in_catalog"))
    rows = disk.join(known, "filepath", "full_outer")
    same = (F.coalesce("known_mtime", F.lit(0.0)) != 0) & (
        F.abs(F.col("disk_mtime") - F.col("known_mtime")) < MTIME_SLACK
    )
    in_scope = under(F.col("filepath"), folder) if folder else F.lit(True)
    status = (
        F.when(F.col("in_catalog").isNull(), "new")
        .when(F.col("on_disk").isNull() & in_scope, "deleted")
        .when(F.col("on_disk").isNull(), "out_of_scope")
        .when(F.coalesce(same, F.lit(False)), "unchanged")
        .otherwise("modified")
    )
    return rows.select("filepath", "disk_mtime", "known_mtime", status.alias("status"))


def scan_totals(diff: DataFrame) -> DataFrame:
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return diff.agg(
        n("new", "modified", "unchanged").alias("found"), n("new", "modified").alias("to_process"),
        n("unchanged").alias("skipped"), n("deleted").alias("deleted"),
        n("new", "modified", "unchanged", "out_of_scope").alias("total_after"),
    )


def upsert(catalog: DataFrame, changes: DataFrame, key: str = "filepath") -> DataFrame:
    """Replace whole rows by key and add new ones. Columns a change lacks become NULL.

    Of several changes of a key the one with the latest ``file_mtime`` counts. One full outer join: each
    side is read and dealt by key once, and each row that stays comes from one of them.
    """
    new = one_per_key(changes, key, ["file_mtime"]).select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key])
    of_change = lambda c: F.col(f"_new_{c}") if c in changes.columns else F.lit(None)
    types = {f.name: f.dataType for f in catalog.schema}
    merged = [F.when(F.col("_hit"), of_change(c).cast(types[c])).otherwise(F.col(c)).alias(c) for c in catalog.columns if c != key]
    return catalog.join(new, key, "full_outer").select(key, *merged).select(catalog.columns)


def one_per_key(rows: DataFrame, key: str, first: list[str]) -> DataFrame:
    """One row of each key: the greatest by the columns ``first``, then by a hash of the whole row.

    Every task cuts its rows to one per key before any are dealt, so a key that comes often is no
    burden; rows that are dealt by key already stay where they are.
    """
    plain = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in rows.schema]
    order = [F.desc(c) for c in first if c in rows.columns] + [F.xxhash64(*plain)]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def fresh_rows(rows: DataFrame) -> DataFrame:
    """Rows as they enter the catalog: id from the path, nothing pending, vectors as the scan made them, else unset."""
    out = rows.withColumn("id", song_id(F.col("filepath"))).withColumn("lyrics_processed", F.lit(True))
    for v in VECTORS:
        made = F.col(v) if v in rows.columns else F.lit(None)
        out = out.withColumn(v, made.cast("array<float>"))
    return out


def delete_ids(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    return catalog.join(ids.select("id"), "id", "left_anti")


def delete_folder(catalog: DataFrame, folder: str) -> DataFrame:
    return catalog.filter(~under(F.col("filepath"), folder))


def clear_vectors(catalog: DataFrame, column: str) -> DataFrame:
    return catalog.withColumn(column, F.lit(None).cast("array<float>"))


def fill_vectors(
    catalog: DataFrame, vectorise: Callable[[Column], Column], text: str = "rich_description", out: str = "embedding"
) -> DataFrame:
    """Vectorise only rows without a vector; stored ones are reused. Narrow."""
    return catalog.withColumn(out, F.coalesce(F.col(out), vectorise(F.col(text))))


def apply_lyrics(catalog: DataFrame, found: DataFrame) -> DataFrame:
    """Merge found lyrics (id, lyrics_text, lyrics_emotion, lyrics_emotion_score,
    emotion_distribution, lyrics_valence, mood_words) and mark the rows pending.

    A neutral lyrics valence leaves the song's own. Of several results of an id the one with the
    highest emotion score counts.
    """
    found = one_per_key(found, "id", ["lyrics_emotion_score"])
    fields = ["lyrics_text", "lyrics_emotion", "lyrics_emotion_score", "emotion_distribution", "mood_words"]
    new = found.select("id", *[F.col(c).alias(f"_{c}") for c in fields], F.col("lyrics_valence").alias("_v"), F.lit(True).alias("_hit"))
    rows = catalog.join(new, "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    out = {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}
    out["has_lyrics"] = hit | F.coalesce(F.col("has_lyrics"), F.lit(False))
    out["valence"] = F.when(hit, blend_valence(F.col("valence"), F.col("_v"))).otherwise(F.col("valence"))
    out["lyrics_processed"] = F.when(hit, False).otherwise(F.col("lyrics_processed"))
    return rows.withColumns(out).select(catalog.columns)


def reprocess(pending: DataFrame, vectorise: Callable[[Column], Column]) -> DataFrame:
    """New sentence and vector for pending rows, marked done."""
    rows = describe_songs(with_snippet(pending))
    return rows.withColumn("embedding", vectorise(F.col("rich_description"))).withColumn(
        "lyrics_processed", F.lit(True)
    ).select(pending.columns)


def upsert_folder(registry: DataFrame, scans: DataFrame) -> DataFrame:
    """Latest scan per path, from the registry and new scans. Combines on the map side."""
    fields = ["last_scan_time", "song_count", "total_songs_in_db"]
    both = registry.select("path", *fields).unionByName(scans.select("path", *fields))
    latest = both.groupBy("path").agg(F.max_by(F.struct(*fields), F.struct(*fields)).alias("_b"))
    return latest.select("path", *[f"_b.{c}" for c in fields])


def forget_folder(registry: DataFrame, path: str) -> DataFrame:
    return registry.filter(F.col("path") != path)


def lyrics_outcomes(results: DataFrame) -> DataFrame:
    """found / not_found / errors / total of a lyrics pass, from rows with an ``outcome``."""
    n = lambda s: F.count_if(F.col("outcome") == s)
    return results.agg(
        n("found").alias("found"), n("not_found").alias("not_found"), n("error").alias("errors"),
        F.count_if(F.col("outcome").isin("found", "not_found", "error")).alias("total"),
    )
