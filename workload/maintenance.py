"""Diff, merge, delete, refresh; the stored catalog; streams and user models."""

from __future__ import annotations

import threading

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tonelake.functions.vectors import decode_float32, hashed_words, with_model_vectors
from tonelake.operators import maintenance as mt
from tonelake.session import work_path
from tonelake.sources import files as fl
from tonelake.sources.catalog import Catalog
from tonelake.sources.folders import open_path, read_folders, write_files
from tonelake.sources.registry import FolderRegistry
from tonelake.streaming import ingest as ing
from tonelake.streaming.progress import BatchCallback, estimates, observed, progress, progress_stream, short_item
from workload.lyrics import averages_sql
from workload.registry import q, query, r
from workload.views import duck

DIFF = f"""WITH {duck('files', 'catalog')},
d AS (SELECT coalesce(f.filepath, c.filepath) AS filepath, f.file_mtime AS disk, c.file_mtime AS known, c.title, c.id,
  CASE WHEN c.filepath IS NULL THEN 'new' WHEN f.filepath IS NULL THEN CASE WHEN c.filepath LIKE '/music/1%' AND split_part(c.filepath, '/', 3) = '1' THEN 'deleted' ELSE 'out_of_scope' END
    WHEN coalesce(c.file_mtime, 0) <> 0 AND abs(f.file_mtime - c.file_mtime) < 1 THEN 'unchanged' ELSE 'modified' END AS status
  FROM files f FULL JOIN catalog c ON f.filepath = c.filepath)"""
DIFF_ALL = DIFF.replace("CASE WHEN c.filepath LIKE '/music/1%' AND split_part(c.filepath, '/', 3) = '1' THEN 'deleted' ELSE 'out_of_scope' END", "'deleted'")


@query("I1_incremental_diff", DIFF_ALL + " SELECT filepath, status FROM d")
def i1(t):
    return mt.diff_files(t.files, t.catalog).select("filepath", "status")


@query("I1_incremental_diff_in_folder", DIFF + " SELECT filepath, status FROM d")
def i1_folder(t):
    return mt.diff_files(t.files, t.catalog, "/music/1").select("filepath", "status")


@query("A14_scan_totals", DIFF_ALL + """ SELECT count(*) FILTER (WHERE status <> 'deleted') AS found, count(*) FILTER (WHERE status IN ('new', 'modified')) AS to_process,
 count(*) FILTER (WHERE status = 'unchanged') AS skipped, count(*) FILTER (WHERE status = 'deleted') AS deleted, count(*) FILTER (WHERE status <> 'deleted') AS total_after FROM d""")
def a14(t):
    return mt.scan_totals(mt.diff_files(t.files, t.catalog))


@query("J4_new_files", DIFF_ALL + " SELECT filepath FROM d WHERE status = 'new'")
def j4(t):
    return t.files.join(t.catalog.select("filepath"), "filepath", "left_anti").select("filepath")


@query("J4_deleted_files", DIFF_ALL + " SELECT filepath FROM d WHERE status = 'deleted'")
def j4_deleted(t):
    return t.catalog.join(t.files.select("filepath"), "filepath", "left_anti").select("filepath")


@query("J5_mtime_match", DIFF_ALL + " SELECT filepath, id FROM d WHERE status = 'unchanged'")
def j5(t):
    known = t.catalog.select("filepath", "id", F.col("file_mtime").alias("known"))
    near = (F.col("known") != 0) & (F.abs(F.col("file_mtime") - F.col("known")) < mt.MTIME_SLACK)
    return t.files.join(known, "filepath").filter(near).select("filepath", "id")


@query("U1_path_difference", DIFF_ALL + " SELECT filepath, CASE WHEN known IS NULL AND title IS NULL THEN 'disk' ELSE 'catalog' END AS only_in FROM d WHERE status IN ('new', 'deleted')")
def u1(t):
    disk, known = t.files.select("filepath"), t.catalog.select("filepath")
    only = lambda a, b, side: a.join(b, "filepath", "left_anti").withColumn("only_in", F.lit(side))
    return only(disk, known, "disk").unionByName(only(known, disk, "catalog"))


@query("U3_merge_vectors", f"WITH {duck('songs')} SELECT id, {q('list_sum(list_transform(coalesce(clap_embedding, embedding), lambda x: x::DOUBLE))')} AS total FROM songs")
def u3(t):
    merged = mt.fill_vectors(t.songs, lambda _: F.col("embedding"), out="clap_embedding")
    return merged.select("id", r(F.aggregate("clap_embedding", F.lit(0.0), lambda a, x: a + x)).alias("total"))


def changes(t):
    """New and modified files as rows, each of them twice: an older one, and the one that counts."""
    diff = mt.diff_files(t.files, t.catalog).filter(F.col("status").isin("new", "modified"))
    ids = F.conv(F.substring(F.md5("filepath"), 1, 8), 16, 10).cast("long")
    age = F.explode(F.array(F.lit(0.0), F.lit(60.0))).alias("age")
    rows = diff.select("filepath", F.col("disk_mtime").alias("file_mtime"), ids.alias("id"), age)
    titles = F.when(F.col("age") == 0, "rescanned").otherwise("older")
    return rows.select("filepath", (F.col("file_mtime") - F.col("age")).alias("file_mtime"), titles.alias("title"), "id")


STUB = DIFF_ALL + " SELECT filepath, CASE WHEN status IN ('new', 'modified') THEN disk ELSE known END AS file_mtime, CASE WHEN status IN ('new', 'modified') THEN 'rescanned' ELSE title END AS title{0} FROM d"


@query("W1_upsert_by_path", STUB.format(", CASE WHEN status IN ('new', 'modified') THEN CAST('0x' || substr(md5(filepath), 1, 8) AS BIGINT) ELSE id END AS id"))
def w1(t):
    return mt.upsert(t.catalog, changes(t))


@query("W2_delete_by_ids", f"WITH {duck('catalog')} SELECT id, filepath FROM catalog WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def w2(t):
    gone = t.lineitem.filter(F.col("l_quantity") > 45).select(F.col("l_orderkey").alias("id"))
    return mt.delete_ids(t.catalog, gone).select("id", "filepath")


@query("W2_delete_folder", f"WITH {duck('catalog')} SELECT id, filepath FROM catalog WHERE NOT starts_with(filepath, '/music/12/')")
def w2_folder(t):
    return mt.delete_folder(t.catalog, "/music/12").select("id", "filepath")


@query("W3_clear_vectors", f"WITH {duck('songs')} SELECT id, false AS has_audio_vector, true AS has_text_vector FROM songs")
def w3(t):
    cleared = mt.clear_vectors(t.songs, "clap_embedding")
    return cleared.select("id", F.col("clap_embedding").isNotNull().alias("has_audio_vector"), F.col("embedding").isNotNull().alias("has_text_vector"))


@query("W3_clear_library", f"WITH {duck('songs')} SELECT count(*) AS before, CAST(0 AS BIGINT) AS after FROM songs")
def w3_all(t):
    store = Catalog(t.spark, work_path(t.spark, "catalog"), 8).create(t.songs)
    before = store.read().agg(F.count("*").alias("before"))
    store.clear()
    return before.withColumn("after", store.read().agg(F.count("*").alias("n")).scalar())


@query("W4_fill_missing_vectors", f"""WITH {duck('songs')}, tok AS (SELECT id, unnest(regexp_extract_all(lower(title), '[a-z'']+')) AS token FROM songs WHERE id % 5 = 0),
n AS (SELECT id, CAST('0x' || substr(md5(token), 1, 6) AS INT) % 64 AS slot, count(*)::DOUBLE AS n FROM tok GROUP BY 1, 2)
SELECT id, {q('sum(n / size)')} AS total FROM n JOIN (SELECT id, sqrt(sum(n * n)) AS size FROM n GROUP BY 1) USING (id) GROUP BY 1
UNION ALL SELECT id, {q('list_sum(list_transform(clap_embedding, lambda x: x::DOUBLE))')} FROM songs WHERE clap_embedding IS NOT NULL""")
def w4(t):
    filled = mt.fill_vectors(t.songs, hashed_words, "title", "clap_embedding")
    return filled.select("id", r(F.aggregate("clap_embedding", F.lit(0.0), lambda a, x: a + x)).alias("total"))


FOUND = f"WITH {duck('songs', 'chunk_scores')}, {averages_sql('chunk_scores')} "


def found(t):
    from tonelake.operators.emotion import average_emotions, summarise_emotions

    return summarise_emotions(average_emotions(t.chunk_scores)).withColumnRenamed("song_id", "id").withColumn("lyrics_text", F.lit("found text"))


@query("W5_lyrics_update", FOUND + f"""SELECT s.id, CASE WHEN w.song_id IS NULL THEN s.lyrics_text ELSE 'found text' END AS lyrics_text, w.song_id IS NOT NULL OR has_lyrics AS has_lyrics,
 w.song_id IS NULL AND lyrics_processed AS lyrics_processed, w.lyrics_emotion,
 {q('CASE WHEN coalesce(w.lyrics_valence, 0) <> 0 THEN coalesce(s.valence, 0) * 0.4e0 + w.lyrics_valence * 0.6e0 ELSE s.valence END')} AS valence
 FROM songs s LEFT JOIN wordy w ON w.song_id = s.id""")
def w5(t):
    none = {"lyrics_emotion": "string", "lyrics_emotion_score": "double", "mood_words": "array<string>"}
    songs = t.songs.withColumns({c: F.lit(None).cast(k) for c, k in none.items()})
    return mt.apply_lyrics(songs, found(t)).select(
        "id", "lyrics_text", "has_lyrics", "lyrics_processed", "lyrics_emotion", r(F.col("valence")).alias("valence")
    )


@query("W7_forget_folder", f"WITH {duck('folders')} SELECT path, song_count FROM folders WHERE path <> '/music/2/0'")
def w7(t):
    return mt.forget_folder(t.folders, "/music/2/0").select("path", "song_count")


@query("W8_force_rescan", f"WITH {duck('files')} SELECT filepath, 'new' AS status FROM files")
def w8(t):
    return mt.diff_files(t.files, t.catalog.limit(0)).select("filepath", "status")


# ---------------------------------------------------------------- stored tables


@query("S1_audio_listing", f"WITH {duck('tags')} SELECT filepath, seconds AS file_mtime FROM tags WHERE regexp_matches(lower(filepath), '\\.(mp3|flac|wav|m4a|ogg)$')")
def s1(t):
    return fl.listing(t.tags.withColumn("file_mtime", F.col("seconds")))


_FOLDER = f"""WITH {duck('tags')}, audio AS (SELECT filepath FROM tags WHERE regexp_matches(lower(filepath), '\\.(mp3|flac|wav|m4a|ogg)$')),
bases AS (SELECT filepath, regexp_replace(filepath, '\\.[^./]*$', '') AS base, CAST(regexp_extract(filepath, '/\\.?([0-9]+)[^/]*$', 1) AS BIGINT) AS doc_id FROM audio),
found AS (SELECT b.filepath, b.base, CASE WHEN b.doc_id % 3 = 2 THEN 'sidecar_txt' ELSE 'sidecar_lrc' END AS source, CASE WHEN b.doc_id % 3 = 2 THEN concat('txt ', text) ELSE text END AS text
  FROM bases b JOIN documents USING (doc_id))"""


def _written_folder(t) -> str:
    """The tags' files below a new folder, empty, and documents as lyrics beside them: .lrc, .txt or both."""
    root = work_path(t.spark, "music")
    name = F.regexp_replace("filepath", r"\.[^./]*$", "")
    number = F.regexp_extract("filepath", r"/\.?([0-9]+)[^/]*$", 1).cast("long")
    songs = t.tags.select("filepath", name.alias("base"), number.alias("doc_id"))
    texts = songs.join(t.documents.select("doc_id", "text"), "doc_id")
    lrc = texts.filter("doc_id % 3 < 2").select(F.concat("base", F.lit(".lrc")).alias("path"), "text")
    txt = texts.filter("doc_id % 3 > 0").select(F.concat("base", F.lit(".txt")).alias("path"), F.concat(F.lit("txt "), "text").alias("text"))
    empty = songs.select(F.col("filepath").alias("path"), F.lit("").alias("text"))
    write_files(empty.unionByName(lrc).unionByName(txt), root)
    return root


def _below(root: str, c: str):
    return F.substring(c, len(open_path(root)[1]) + 1, 1 << 30)


@query("S1_audio_files", _FOLDER + " SELECT filepath, true AS has_time, source FROM audio LEFT JOIN found USING (filepath)")
def s1_files(t):
    """The listing of a folder of real files."""
    root = _written_folder(t)
    rows = read_folders(t.spark, root, texts=False, folders=8)
    return rows.select(_below(root, "filepath").alias("filepath"), (F.col("file_mtime") > 1.6e9).alias("has_time"), "source")


@query("S5_sidecars_of_files", _FOLDER + " SELECT filepath, source, text FROM found")
def s5_files(t):
    root = _written_folder(t)
    rows = read_folders(t.spark, root, folders=64)
    return rows.filter(F.col("source").isNotNull()).select(_below(root, "filepath").alias("filepath"), "source", "text")


@query("S4_decoded_catalog", f"WITH {duck('songs')} SELECT id, CASE WHEN id % 10 <> 3 THEN {q('list_sum(list_transform(embedding, lambda x: x::DOUBLE))')} END AS total FROM songs")
def s4(t):
    """Vectors as raw bytes, one in ten cut short, read back as arrays."""

    @F.arrow_udf("binary")
    def encode(batch: pa.Array) -> pa.Array:
        return pa.array([np.asarray(v, dtype="<f4").tobytes() for v in batch.to_pylist()], type=pa.binary())

    raw = t.songs.select("id", encode("embedding").alias("raw"))
    cut = F.when(F.col("id") % 10 == 3, F.expr("substring(raw, 1, 9)")).otherwise(F.col("raw"))
    vectors = raw.select("id", decode_float32(cut).alias("v"))
    return vectors.select("id", r(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("S6_catalog_write", f"WITH {duck('songs')} SELECT id, filepath, title, bpm, {q('list_sum(list_transform(embedding, lambda x: x::DOUBLE))')} AS total FROM songs")
def s6(t):
    store = Catalog(t.spark, work_path(t.spark, "catalog"), 8).create(t.songs)
    return store.read().select("id", "filepath", "title", "bpm", r(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("total"))


REGISTRY = f"""WITH {duck('folders', 'scans')}, u AS (SELECT * FROM folders UNION ALL SELECT * FROM scans),
k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY last_scan_time DESC NULLS LAST, song_count DESC, total_songs_in_db DESC) AS n FROM u)
SELECT path, last_scan_time, song_count, total_songs_in_db FROM k WHERE n = 1"""


@query("S7_folder_registry", REGISTRY)
def s7(t):
    return mt.upsert_folder(t.folders, t.scans)


@query("S7_folder_registry_stored", REGISTRY + " AND path <> '/music/2/0'")
def s7_stored(t):
    registry = FolderRegistry(t.spark, work_path(t.spark, "registry")).create()
    registry.upsert(t.folders)
    registry.upsert(t.scans)
    registry.forget("/music/2/0")
    return registry.read()


# ---------------------------------------------------------------- streams


PROGRESS = f"""WITH {duck('progress_events')}, g AS (SELECT run_id, max(current) AS current, max(total) AS total, epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6 AS e FROM progress_events GROUP BY 1)
SELECT run_id, CAST(current AS BIGINT) AS current, total, {q('e', 1)} AS elapsed_seconds, {q('CASE WHEN e > 0 AND total <> current THEN (total - current) / (current / e) END', 1)} AS eta_seconds, {q('current / total * 100', 1)} AS percent FROM g"""


@query("R2_progress", PROGRESS)
def r2(t):
    return progress(t.progress_events.withColumn("current", F.col("current").cast("long")))


@query("R2_progress_stream", PROGRESS)
def r2_stream(t):
    """Events arrive in several files, some of them twice; the state of every run is kept in a table."""
    events, table = work_path(t.spark, "events"), work_path(t.spark, "run-states")
    rows = t.progress_events.select("run_id", "ts", F.col("current").cast("long").alias("current"), "total")
    rows.unionAll(rows.filter("current % 5 = 0")).repartition(3).write.parquet(events)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(events)
    progress_stream(stream, table, work_path(t.spark, "progress-checkpoint"), late="3650 days").awaitTermination()
    return estimates(t.spark.read.parquet(table))


_PARTS = f"WITH {duck('files')}, p AS (SELECT *, CAST(split_part(filepath, '/', 3) AS BIGINT) % 3 AS batch FROM files)"


@query("F2_progress_reports", _PARTS + """, b AS (SELECT batch, count(*) AS n_rows, count(*) FILTER (WHERE file_mtime > 8e8) AS failed, max(left(list_last(string_split(filepath, '/')), 50)) AS item FROM p GROUP BY 1)
SELECT batch, n_rows, failed, item, CAST(sum(n_rows) OVER (ORDER BY batch) AS BIGINT) AS current, CAST(sum(failed) OVER (ORDER BY batch) AS BIGINT) AS errors FROM b""")
def f2(t):
    """What the callback was told of every micro-batch of a listing that arrives in three files."""
    listings, done, seen = work_path(t.spark, "listings"), threading.Event(), []
    part = F.split("filepath", "/")[2].cast("long") % 3
    for k in range(3):  # files are read in the order of their times
        t.files.filter(part == k).coalesce(1).write.mode("append").parquet(listings)
    callback = BatchCallback(lambda report: done.set() if report["stage"] == "complete" else seen.append(report))
    t.spark.streams.addListener(callback)
    try:
        stream = t.spark.readStream.schema(ing.LISTING_SCHEMA).option("maxFilesPerTrigger", 1).parquet(listings)
        told = observed(stream, F.col("filepath"), F.col("file_mtime") > 8e8)
        sink = told.writeStream.format("parquet").option("path", work_path(t.spark, "listed"))
        sink.option("checkpointLocation", work_path(t.spark, "listed-checkpoint")).trigger(availableNow=True).start().awaitTermination()
        done.wait(60)
    finally:
        t.spark.streams.removeListener(callback)
    names = ["batch", "rows", "failed", "item", "current", "errors"]
    rows = [tuple(s[n] for n in names) for s in seen if s["stage"] == "scanning" and s["rows"]]
    return t.spark.createDataFrame(rows, "batch long, n_rows long, failed long, item string, current long, errors long")


@query("R2_current_file", f"WITH {duck('files')} SELECT filepath, left(list_last(string_split(filepath, '/')), 50) AS item FROM files")
def r2_item(t):
    return t.files.select("filepath", short_item(F.col("filepath")).alias("item"))


# ---------------------------------------------------------------- user models


def letter_model():
    """A toy model: length and number of 'e's."""
    return lambda texts: np.array([[len(x), x.count("e")] for x in texts], dtype="float32").reshape(-1, 2)


@query("F1_model_vectors", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS first, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS second FROM documents")
def f1(t):
    rows = with_model_vectors(t.documents.select("doc_id", "text"), "text", "v", letter_model)
    return rows.select("doc_id", F.get("v", F.lit(0)).cast("double").alias("first"), F.get("v", F.lit(1)).cast("double").alias("second"))


def vowel_model():
    """A toy classifier: shares of three vowels as scores of two known labels and an unknown one."""

    def classify(chunks: list[str]) -> list[dict[str, float]]:
        return [{"joy": c.count("a") / 1000, "sadness": c.count("e") / 1000, "boredom": 1.0} for c in chunks]

    return classify


@query("F1_model_emotions", f"""WITH c AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM documents)
SELECT doc_id AS song_id, {q("(length(body) - length(replace(body, 'a', ''))) / 1000")} AS joy, {q("(length(body) - length(replace(body, 'e', ''))) / 1000")} AS sadness FROM c WHERE length(body) >= 10""")
def f1_emotions(t):
    """One chunk per document here, so that the averages are plain counts."""
    from tonelake.functions.text import strip
    from tonelake.operators.emotion import average_emotions, model_scores

    body = strip(F.col("text"))
    chunks = t.documents.filter(F.length(body) >= 10).select(
        F.col("doc_id").alias("song_id"), F.lit(0).alias("chunk_idx"), F.lit(1).alias("n_chunks"), body.alias("chunk")
    )
    avg = average_emotions(model_scores(chunks, vowel_model))
    return avg.select("song_id", r(F.get("avg", F.lit(0))).alias("joy"), r(F.get("avg", F.lit(6))).alias("sadness"))
