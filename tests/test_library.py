"""Listing, browsing, diffing, the stored catalog, the registry and the streams."""

import os
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonelake.functions.vectors import hashed_words
from tonelake.operators import library as lib
from tonelake.operators import maintenance as mt
from tonelake.operators.emotion import lexicon_scores
from tonelake.plans.ranking import match_quality
from tonelake.session import shared_folder, work_path
from tonelake.sources import files as fl
from tonelake.sources import lyrics_cache as lc
from tonelake.sources.catalog import Catalog
from tonelake.sources.registry import FolderRegistry
from tonelake.streaming import ingest as ing
from tonelake.sources.folders import read_folders, write_files
from tonelake.streaming.progress import BatchCallback, estimates, observed, progress, progress_stream


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


FILES = "filepath string, file_mtime double"


# ---------------------------------------------------------------- projections


def test_default_tags(spark):
    rows = [("/m/a.b.flac", None, "", "A", None), ("/m/.hidden", "", "X", None, "pop"), ("/m/noext", None, None, "", "")]
    df = spark.createDataFrame(rows, "filepath string, title string, artist string, album string, genre string")
    got = [tuple(r)[1:] for r in lib.default_tags(df).collect()]
    assert got == [
        ("a.b", "Unknown Artist", "A", ""), (".hidden", "X", "Unknown Album", "pop"), ("noext", "Unknown Artist", "Unknown Album", ""),
    ]


@pytest.mark.parametrize("score,tier,band", [(60.0, "high", "amber"), (59.9, "medium", "amber"), (35.0, "medium", "orange"), (0.0, "low", "muted"), (None, "unknown", "muted"), (70.0, "high", "emerald"), (1.0, "low", "red")])
def test_tiers(spark, score, tier, band):
    assert one(spark, match_quality(F.col("x")), score, "double") == tier
    assert one(spark, lib.score_band(F.col("x")), score, "double") == band


@pytest.mark.parametrize("s,short,long", [(0.0, "--:--", "0:00"), (None, "--:--", "0:00"), (65.9, "1:05", "1:05"), (3725.0, "62:05", "1:02:05")])
def test_durations(spark, s, short, long):
    assert one(spark, lib.duration_text(F.col("x")), s, "double") == short
    assert one(spark, lib.duration_text_long(F.col("x")), s, "double") == long


def test_locale_sort_and_filter(spark):
    titles = ["b", "A", "a", "É", "B", None, "e"]
    df = spark.createDataFrame([(i, t, "x", None, "Rock") for i, t in enumerate(titles)], "id long, title string, artist string, album string, genre string")
    assert [r.title for r in lib.sorted_library(df, "title").collect()] == [None, "a", "A", "b", "B", "e", "É"]
    assert [r.id for r in lib.sorted_library(df, "recent", 2).collect()] == [6, 5]
    assert df.filter(lib.matches_text("ROC")).count() == 7
    assert df.filter(lib.matches_text("roc", ("title", "artist", "album"))).count() == 0


def test_browse_and_rollup(spark):
    paths = ["/m/B/x.mp3", "/m/a/deep/er/y.TXT", "/m/z.flac", "/m/.secret/q.mp3", "/n/t.ogg", "/m/A.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "filepath string")
    got = [(r.name, r.is_dir, r.has_audio) for r in lib.browse(df, "/m").collect()]
    assert got == [("a", True, False), ("B", True, True), ("A.txt", False, False), ("z.flac", False, False)]
    roll = {r.path: r.has_audio for r in lib.folder_rollup(df).collect()}
    assert roll["/"] and roll["/m"] and roll["/m/B"] and roll["/m/a/deep"] is False and "/m/z.flac" not in roll


def test_stats_of_an_empty_library(spark):
    songs = spark.createDataFrame([], "id long, clap_embedding array<float>, bpm double, has_lyrics boolean")
    folders = spark.createDataFrame([], "path string")
    assert lib.library_stats(songs, folders).first().asDict() == {"song_count": 0, "clap_count": 0, "folder_count": 0, "is_empty": True}
    assert tuple(lib.progress_counts(songs).first()) == (0, 0)


# ---------------------------------------------------------------- files


@pytest.fixture
def music(tmp_path):
    for name, text in {
        "a/one.MP3": "x", "a/two.flac": "x", "a/two.lrc": "[00:01.00] words of the song", "a/two.txt": "other", "b/three.ogg": "x",
        "b/three.txt": "plain", "b/cover.jpg": "x", "b/mp3": "x",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    os.utime(tmp_path / "a/two.flac", (1000, 1000.5))
    return str(tmp_path)


def test_listing_and_sidecars(spark, music):
    got = {r.filepath[len(music):]: r.file_mtime for r in fl.list_audio(spark, music).collect()}
    assert got.keys() == {"/a/one.MP3", "/a/two.flac", "/b/three.ogg"} and got["/a/two.flac"] == pytest.approx(1000.5)
    songs = fl.list_audio(spark, music).withColumn("id", mt.song_id(F.col("filepath")))
    side = fl.sidecar_candidates(songs, fl.read_sidecars(spark, music)).collect()
    assert sorted((r.source, r.text) for r in side) == [("sidecar_lrc", "[00:01.00] words of the song"), ("sidecar_txt", "other"), ("sidecar_txt", "plain")]
    plan = fl.list_audio(spark, music)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_cache(spark):
    songs = spark.createDataFrame([(1, "/a.mp3", "t", None, " new "), (2, "/b.mp3", None, "x", "  ")], "id long, filepath string, title string, artist string, text string")
    keys = [r.cache_key for r in lc.keyed(songs).orderBy("id").collect()]
    import hashlib

    assert keys == [hashlib.md5(k.encode()).hexdigest()[:16] for k in ("/a.mp3|t|None", "/b.mp3|None|x")]
    cache = spark.createDataFrame([(keys[1], " old\n")], "cache_key string, text string")
    assert {r.id: r.cached_text for r in lc.cached_lyrics(songs.drop("text"), cache).collect()} == {1: None, 2: "old"}
    assert [tuple(r) for r in lc.new_entries(songs, cache).collect()] == [(keys[0], " new ")]
    assert lc.cache_stats(cache.limit(0)).first().size_mb == 0.0


# ---------------------------------------------------------------- diff and merge


def test_diff_edges(spark):
    files = spark.createDataFrame([("/m/new", 5.0), ("/m/same", 10.5), ("/m/edge", 11.0), ("/m/null", 1.0), ("/m/zero", 0.5)], FILES)
    catalog = spark.createDataFrame([("/m/same", 10.0), ("/m/edge", 10.0), ("/m/null", None), ("/m/zero", 0.0), ("/m/gone", 1.0), ("/m2/far", 1.0)], FILES)
    got = {r.filepath: r.status for r in mt.diff_files(files, catalog, "/m").collect()}
    assert got == {
        "/m/new": "new", "/m/same": "unchanged", "/m/edge": "modified", "/m/null": "modified", "/m/zero": "modified",
        "/m/gone": "deleted", "/m2/far": "out_of_scope",
    }
    assert {r.filepath: r.status for r in mt.diff_files(files, catalog).collect()}["/m2/far"] == "deleted"


times = st.one_of(st.none(), st.sampled_from([0.0, 1.0, 1.5, 3.0]))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from("abcdef"), st.sampled_from([1.0, 2.0, 3.0])), st.dictionaries(st.sampled_from("abcdef"), times))
def test_diff_covers_every_path_once(spark, disk, known):
    diff = mt.diff_files(spark.createDataFrame(list(disk.items()), FILES), spark.createDataFrame(list(known.items()), FILES)).collect()
    got = {r.filepath: r.status for r in diff}
    assert len(diff) == len(got) and got.keys() == disk.keys() | known.keys()
    for p, status in got.items():
        if p not in known:
            assert status == "new"
        elif p not in disk:
            assert status == "deleted"
        else:
            assert (status == "unchanged") == bool(known[p] and abs(disk[p] - known[p]) < 1.0)


def test_folder_scope_needs_a_separator(spark):
    df = spark.createDataFrame([("/music/a",), ("/music2/a",), ("/mus_c/a",)], "filepath string")
    assert [r.filepath for r in mt.delete_folder(df, "/music/").collect()] == ["/music2/a", "/mus_c/a"]


# ---------------------------------------------------------------- stored catalog


def rows(spark, items):
    return spark.createDataFrame(items, "filepath string, file_mtime double, title string, rich_description string")


def titles(store):
    return {r.filepath: r.title for r in store.read().collect()}


def test_catalog_life(spark):
    store = Catalog(spark, work_path(spark, "cat"), 4).create()
    assert store.read().count() == 0
    store.upsert(rows(spark, [(f"/m/{i}", 1.0, f"t{i}", f"calm song {i}") for i in range(10)]))
    before = {r.filepath: r.id for r in store.read().collect()}
    snapshot = store.read()
    store.upsert(rows(spark, [("/m/3", 2.0, "changed", "new words"), ("/n/x", 1.0, "other", "text")]))
    assert titles(store)["/m/3"] == "changed" and len(titles(store)) == 11
    assert {r.filepath: r.id for r in store.read().collect()}["/m/3"] == before["/m/3"]  # stable id
    assert snapshot.count() == 10  # a reader keeps its snapshot
    store.fill_vectors(hashed_words)
    assert store.vectors().count() == 11
    store.upsert(rows(spark, [("/m/3", 3.0, "again", "w")]))
    assert store.vectors().count() == 10  # a replaced row loses its vectors
    store.clear("embedding")
    assert store.vectors().count() == 0
    store.delete_folder("/m")
    assert titles(store) == {"/n/x": "other"}
    store.delete_paths(spark.createDataFrame([("/n/x",)], "filepath string"))
    assert store.read().count() == 0
    store.upsert(rows(spark, [("/z", 1.0, "z", "z")]))
    store.clear()
    assert titles(store) == {}


def test_change_touches_only_its_buckets(spark):
    store = Catalog(spark, work_path(spark, "cat"), 16).create(mt.fresh_rows(rows(spark, [(f"/m/{i}", 1.0, "t", "d") for i in range(60)])))
    old = store._manifest()[1]
    store.upsert(rows(spark, [("/m/1", 2.0, "u", "d")]))
    new = store._manifest()[1]
    assert sum(new[b] != old[b] for b in old) == 1 and len(titles(store)) == 60


def test_sync(spark):
    store = Catalog(spark, work_path(spark, "cat"), 4).create()
    process = lambda changed: changed.withColumn("title", F.lit("p"))
    store.sync(spark.createDataFrame([("/m/a", 1.0), ("/m/b", 1.0), ("/n/c", 1.0)], FILES), process)
    diff = store.sync(spark.createDataFrame([("/m/a", 1.0), ("/m/d", 1.0)], FILES), process, folder="/m")
    assert mt.scan_totals(diff).first().asDict() == {"found": 2, "to_process": 1, "skipped": 1, "deleted": 1, "total_after": 3}
    assert set(titles(store)) == {"/m/a", "/m/d", "/n/c"}
    store.sync(spark.createDataFrame([("/q", 1.0)], FILES), process, force=True)
    assert set(titles(store)) == {"/q"}


def test_lyrics_then_reprocess(spark):
    store = Catalog(spark, work_path(spark, "cat"), 2).create()
    base = rows(spark, [("/a", 1.0, "A", "d"), ("/b", 1.0, "B", "d")]).withColumn("valence", F.lit(0.5)).withColumn("bpm", F.lit(100.0))
    store.upsert(base)
    ids = {r.filepath: r.id for r in store.read().collect()}
    text = "\n".join(["sad sad melancholy words again", "a different line here"] * 2)
    found = spark.createDataFrame([(ids["/a"], text)], "id long, lyrics_text string")
    store.apply_lyrics(ing.analyse_lyrics(found, lambda c: lexicon_scores(c, key="id")))
    r = store.read().filter("filepath = '/a'").first()
    assert (r.has_lyrics, r.lyrics_processed, r.lyrics_emotion) == (True, False, "sadness")
    assert r.valence == pytest.approx(0.4 * 0.5 + 0.6 * -0.7)
    assert lib.pending(store.read()).count() == 1
    store.reprocess(hashed_words)
    r = store.read().filter("filepath = '/a'").first()
    assert r.lyrics_processed and r.embedding is not None and "Lyrics: a different line here sad sad melancholy words again..." in r.rich_description
    assert store.read().filter("filepath = '/b'").first().rich_description == "d"


def test_neutral_lyrics_keep_the_valence(spark):
    songs = spark.createDataFrame([(1, 0.3, False, True)], "id long, valence double, has_lyrics boolean, lyrics_processed boolean").withColumns({
        c: F.lit(None).cast(k) for c, k in {"lyrics_text": "string", "lyrics_emotion": "string", "lyrics_emotion_score": "double", "emotion_distribution": "map<string,double>", "mood_words": "array<string>"}.items()
    })
    found = spark.sql("SELECT 1L id, 'x' lyrics_text, 'neutral' lyrics_emotion, 1D lyrics_emotion_score, map('neutral', 1D) emotion_distribution, 0D lyrics_valence, array('calm') mood_words")
    assert mt.apply_lyrics(songs, found).first().valence == 0.3


def test_registry(spark):
    registry = FolderRegistry(spark, work_path(spark, "reg")).create()
    scan = lambda *r: spark.createDataFrame(r, "path string, last_scan_time double, song_count long, total_songs_in_db long")
    registry.upsert(scan(("/a", 5.0, 1, 1), ("/b", None, 2, 3)))
    registry.upsert(scan(("/a", 90.0, 7, 9)))
    listed = lib.folder_list(registry.read()).collect()
    assert [(r.path, r.last_scan_formatted, r.song_count) for r in listed] == [("/a", "1970-01-01 00:01", 7), ("/b", "Unknown", 2)]
    registry.forget("/a")
    assert [r.path for r in registry.read().collect()] == ["/b"]


# ---------------------------------------------------------------- streams


def test_stream_equals_batch_and_survives_restart(spark):
    process = lambda changed: changed.withColumn("title", F.concat(F.lit("at "), F.col("file_mtime").cast("string")))
    listings, checkpoint = work_path(spark, "in"), work_path(spark, "cp")
    store = Catalog(spark, work_path(spark, "cat"), 4).create()
    first = spark.createDataFrame([(f"/m/{i}", 1.0) for i in range(6)], FILES)
    second = spark.createDataFrame([("/m/1", 1.2), ("/m/2", 5.0), ("/m/2", 4.0), ("/m/9", 1.0)], FILES)
    seen = []
    callback = BatchCallback(seen.append)
    spark.streams.addListener(callback)
    for part in (first, second):
        part.repartition(2).write.mode("append").parquet(listings)
        ing.ingest_stream(spark, listings, store, process, checkpoint, files_per_batch=10).awaitTermination()
    deadline = time.time() + 10
    while sum(e["stage"] == "complete" for e in seen) < 2 and time.time() < deadline:
        time.sleep(0.1)
    spark.streams.removeListener(callback)
    assert titles(store) == {**{f"/m/{i}": "at 1.0" for i in range(6)}, "/m/2": "at 5.0", "/m/9": "at 1.0"}
    assert sum(e.get("rows", 0) for e in seen) == 10


def test_repeated_batch_changes_nothing(spark):
    store = Catalog(spark, work_path(spark, "cat"), 2).create()
    batch = spark.createDataFrame([("/m/1", 1.0)], FILES)
    process = lambda changed: changed
    ing.ingest_batch(store, batch, process)
    snapshot = store._manifest()
    ing.ingest_batch(store, batch, process)
    assert store._manifest() == snapshot


GOOD = "\n".join(["some happy words of a song", "and more joy in a second line", "some happy words of a song"])


def lookups(spark, rows):
    """Rows of (id, source, text, failed)."""
    full = [(i, "T", "A", s, k, x, None, f) for k, (i, s, x, f) in enumerate(rows)]
    return spark.createDataFrame(full, ing.LOOKUPS)


def test_lyrics_pass_survives_failures_and_repeats(spark, monkeypatch):
    from tonelake.operators.emotion import lexicon_scores

    base = [(f"/m/{i}", 1.0, f"t{i}", None) for i in range(6)]
    store = Catalog(spark, work_path(spark, "cat"), 3).create()
    store.upsert(rows(spark, base).withColumns({"valence": F.lit(0.5), "lyrics_text": F.when(F.col("filepath") == "/m/5", "own"), "has_lyrics": F.col("filepath") == "/m/5"}))
    ids = {r.filepath: r.id for r in store.read().collect()}
    batch = lookups(spark, [
        (ids["/m/0"], "genius", GOOD, None), (ids["/m/0"], "lrclib", "bad", False), (ids["/m/1"], "genius", "bad", True), (ids["/m/1"], "ovh", "bad", False),
        (ids["/m/2"], "genius", "bad", None), (ids["/m/3"], "genius", GOOD, True), (ids["/m/3"], "ovh", GOOD, False), (ids["/m/5"], "genius", GOOD, None), (77, "genius", GOOD, None),
    ])
    score, log = (lambda chunks: lexicon_scores(chunks, key="id")), work_path(spark, "log")
    run = lambda: ing.lyrics_batch(store, batch, f"{log}/batch=0", score, hashed_words)
    with monkeypatch.context() as m:  # the change fails after the log is written
        m.setattr(Catalog, "update", lambda self, rows: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            run()
    for _ in range(3):
        run()
        got = {r.filepath: r for r in store.read().collect()}
        assert {p for p, r in got.items() if r.lyrics_text == GOOD} == {"/m/0", "/m/3"} and got["/m/5"].lyrics_text == "own"
        assert all(got[p].has_lyrics and got[p].lyrics_processed and len(got[p].embedding) == 64 and "Lyrics: some happy words" in got[p].rich_description for p in ("/m/0", "/m/3"))
        felt = {r.id: r.lyrics_valence for r in ing.lyrics_log(spark, log).collect()}[ids["/m/0"]]
        assert felt > 0 and got["/m/0"].valence == pytest.approx(0.5 * 0.4 + felt * 0.6) and got["/m/0"].lyrics_emotion == "joy"
        assert tuple(mt.lyrics_outcomes(ing.lyrics_log(spark, log)).first()) == (2, 1, 1, 4)
    assert {r.id: r.outcome for r in ing.lyrics_log(spark, log).collect()} == {ids["/m/0"]: "found", ids["/m/1"]: "error", ids["/m/2"]: "not_found", ids["/m/3"]: "found"}
    snapshot = store._manifest()
    run()
    assert store._manifest() == snapshot


def test_progress(spark):
    events = spark.sql("""SELECT * FROM VALUES ('a', timestamp_seconds(0), 0L, 10L), ('a', timestamp_seconds(8), 4L, 10L),
      ('b', timestamp_seconds(3), 0L, 0L), ('c', timestamp_seconds(1), 0L, 5L), ('c', timestamp_seconds(9), 0L, 5L), ('d', timestamp_seconds(0), 1L, 2L), ('d', timestamp_seconds(2), 2L, 2L) AS t(run_id, ts, current, total)""")
    got = {r.run_id: (r.elapsed_seconds, r.eta_seconds, r.percent) for r in progress(events).collect()}
    assert got == {"a": (8.0, 12.0, 40.0), "b": (0.0, None, 0.0), "c": (8.0, None, 0.0), "d": (2.0, None, 100.0)}


def test_progress_numbers_the_events_of_a_run_in_their_order(spark, tmp_path):
    """Event ids far from 1, one of them twice and a run without a name: a run's count is its number of events."""
    from datetime import datetime, timedelta

    from __spark_entry__ import queries

    rows = [(1000 + 7 * i, datetime(2024, 1, 1) + timedelta(seconds=10 * i), 1 + i % 2 if i < 9 else None, "click") for i in range(12)]
    spark.createDataFrame(rows + rows[-1:], "event_id long, ts timestamp, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    want = {1: (5, 80.0, 3120.0, 2.5), 2: (4, 60.0, 2940.0, 2.0), None: (4, 20.0, 980.0, 2.0)}
    got = queries()["R2_progress"](spark, str(tmp_path))
    assert got.schema["current"].dataType.simpleString() == "bigint"
    assert {r.run_id: (r.current, r.elapsed_seconds, r.eta_seconds, r.percent) for r in got.collect()} == want


def test_lookup_results_arrive_in_many_files(spark, tmp_path, monkeypatch):
    """No task of the background lyrics pass gathers the lookups; all of them reach the outcomes, in two batches."""
    from workload import scan
    from workload.registry import Tables

    spark.range(0, 40, 1, 4).selectExpr("id AS doc_id", "concat('some words of a text that is long enough. Number ', id, ' goes on and on for a while') AS text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(1, 40, 1, 2).selectExpr("id AS vec_id", "cast(id % 10 as int) AS label", "transform(sequence(1, 64), x -> cast((id * x) % 7 / 100 as float)) AS embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(scan, "work_path", lambda s, name: str(tmp_path / name))
    store, log = scan._lyrics_pass(Tables(spark, str(tmp_path)))
    assert len(list((tmp_path / "results").glob("*.parquet"))) > 2
    rows = ing.lyrics_log(spark, log).select("id", "batch").collect()
    assert {r.batch for r in rows} == {0, 1} and sorted(r.id for r in rows) == list(range(4, 40, 4))


EVENTS = "run_id string, ts timestamp, current long, total long"


def events_of(spark, rows):
    at = F.timestamp_seconds(F.col("ts") + 1_000_000)
    return spark.createDataFrame([(r, float(t), c, n) for r, t, c, n in rows], "run_id string, ts double, current long, total long").withColumn("ts", at)


def test_run_states_late_doubled_and_ended(spark):
    """Doubled events change nothing, events out of order count, those behind the watermark don't, silent runs end."""
    folder, table, checkpoint = (work_path(spark, n) for n in ("ev", "states", "cp"))
    batches = [
        [("a", 0, 0, 10), ("a", 8, 4, 10), ("b", 5, 1, 2)],
        [("a", 0, 0, 10), ("a", 8, 4, 10), ("a", 4, 2, 10), ("b", 2, 0, 2)],
        [("c", 5000, 1, 4)],
        [("a", 1, 9, 10), ("c", 5010, 2, 4)],
        [("b", 9000, 2, 2), ("c", 9000, 4, 4)],
    ]
    before = dict(spark.conf.getAll)
    for rows in batches:
        events_of(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
        progress_stream(stream, table, checkpoint, late="100 seconds", idle=600.0).awaitTermination()
    assert dict(spark.conf.getAll) == before
    states = spark.read.parquet(table)
    got = {r.run_id: (r.current, r.total, r.elapsed_seconds, r.eta_seconds) for r in estimates(states).collect()}
    assert got == {"a": (4, 10, 8.0, 12.0), "b": (2, 2, 8998.0, None), "c": (4, 4, 4000.0, None)}
    assert states.filter("run_id = 'a' AND NOT ended").count() == 1  # the second batch brought nothing new for it
    assert {r.run_id for r in states.filter("ended").collect()} >= {"a", "b"}


def test_reports_count_failures_and_name_the_item(spark):
    seen, folder = [], work_path(spark, "in")
    for rows in ([("/m/a.mp3", 1.0), ("/m/b.mp3", None)], [("/m/x/" + "y" * 80, 2.0)]):
        spark.createDataFrame(rows, FILES).coalesce(1).write.mode("append").parquet(folder)
    callback = BatchCallback(seen.append)
    spark.streams.addListener(callback)
    stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(folder)
    told = observed(stream, F.col("filepath"), F.col("file_mtime").isNull())
    told.writeStream.format("noop").option("checkpointLocation", work_path(spark, "cp")).trigger(availableNow=True).start().awaitTermination()
    deadline = time.time() + 10
    while not any(e["stage"] == "complete" for e in seen) and time.time() < deadline:
        time.sleep(0.1)
    spark.streams.removeListener(callback)
    rows = [e for e in seen if e["stage"] == "scanning" and e["rows"]]
    assert [(e["rows"], e["failed"], e["item"], e["current"], e["errors"]) for e in rows] == [(2, 1, "b.mp3", 2, 1), (1, 0, "y" * 50, 3, 1)]
    assert seen[-1] == {"stage": "complete", "current": 3, "errors": 1}


def test_shared_folder(spark, monkeypatch):
    import tonelake.session as ss

    class Stub:
        def __init__(self, folder, master):
            self.conf = type("C", (), {"get": staticmethod(lambda key, default: folder)})
            self.sparkContext = type("S", (), {"master": master})

    assert ss.shared_folder(Stub("/shared", "yarn")) == "/shared"
    assert os.path.isdir(ss.shared_folder(Stub(None, "local[2]")))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ss.shared_folder(Stub(None, "yarn"))
    assert shared_folder(spark) == ss.shared_folder(spark)


def test_merges_keep_one_row_per_key(spark):
    """Several changes of a path, or several results of an id, leave the row that counts last."""
    schema = "id long, filepath string, file_mtime double, title string, emotion_distribution map<string,double>"
    catalog = spark.createDataFrame([(1, "/a", 1.0, "old", {"joy": 1.0}), (2, "/b", 1.0, "b", None)], schema)
    changes = spark.createDataFrame([(1, "/a", 2.0, "first", None), (1, "/a", 3.0, "last", {"sad": 1.0}), (3, "/c", 1.0, "x", None), (3, "/c", 1.0, "y", None)], schema)
    changes = changes.unionByName(spark.createDataFrame([(4, "/d", 1.0, "m", {"joy": 0.1}), (4, "/d", 1.0, "m", {"joy": 0.9})], schema))
    seen = set()
    for parts in (1, 4, 7):
        got = {r.filepath: (r.title, str(r.emotion_distribution)) for r in mt.upsert(catalog, changes.repartition(parts)).collect()}
        assert got["/a"] == ("last", "{'sad': 1.0}") and got["/b"] == ("b", "None") and got["/c"][0] in ("x", "y") and len(got) == 4
        assert mt.upsert(catalog, changes.repartition(parts)).count() == 4
        seen.add((got["/c"], got["/d"]))
    assert len(seen) == 1  # rows that differ in a map only are told apart too


def test_merge_reads_and_deals_each_side_once(spark, tmp_path):
    catalog = spark.range(50).select(F.concat(F.lit("/"), "id").alias("filepath"), F.lit(1.0).alias("file_mtime"), F.lit("t").alias("title"))
    catalog.write.parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    files = spark.createDataFrame([(f"/{k}", 5.0) for k in range(40, 60)], FILES)
    diff = mt.diff_files(files, stored).filter("status IN ('new', 'modified')")
    merged = mt.upsert(stored, diff.select("filepath", F.col("disk_mtime").alias("file_mtime"), F.lit("u").alias("title")))
    assert merged.count() == 60 and merged.filter("title = 'u'").count() == 20
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Two for the diff, which is computed once, and one for each side of the merge.
    assert plan.count("Exchange hashpartitioning") == 4 and plan.count("FileScan") == 2 and plan.count("FullOuter") == 2


@pytest.mark.parametrize("folders", [1, 2, 3, 100])
def test_folders_with_sidecars_in_one_pass(spark, tmp_path, folders):
    root = str(tmp_path / "music")
    names = ["top.mp3", "top.txt", "a/x.FLAC", "a/x.lrc", "a/x.txt", "a/b/c/y.v2.ogg", "a/b/c/y.v2.lrc", "a/b/c/y.lrc", "a/b/z.wav", "d/.mp3", "d/.hid.m4a", "d/.hid.txt", "d/cover.jpg", "d/cover.lrc"]
    rows = spark.createDataFrame([(n, "" if n == "a/b/c/y.v2.lrc" else f"text of {n}") for n in names], "path string, text string")
    assert write_files(rows.repartition(3), root) == len(names)
    (tmp_path / "music" / "a" / "b" / "z.lrc").write_bytes(b"\xff\xfe")
    (tmp_path / "music" / "a" / "b" / "z.txt").write_text("é")
    got = {r.filepath.removeprefix(root + "/"): (r.base.removeprefix(root + "/"), r.source, r.text) for r in read_folders(spark, root, folders=folders).collect()}
    assert got == {
        "top.mp3": ("top", "sidecar_txt", "text of top.txt"), "a/x.FLAC": ("a/x", "sidecar_lrc", "text of a/x.lrc"),
        "a/b/c/y.v2.ogg": ("a/b/c/y.v2", "sidecar_lrc", ""), "a/b/z.wav": ("a/b/z", "sidecar_txt", "é"), "d/.hid.m4a": ("d/.hid", "sidecar_txt", "text of d/.hid.txt"),
    }
    listed = read_folders(spark, root, texts=False, folders=folders)
    assert listed.count() == 5 and listed.filter("text IS NOT NULL OR file_mtime < 1e9").count() == 0
    # The file source leaves out names that begin with a dot.
    assert {r.filepath for r in fl.list_audio(spark, root).collect()} == {r.filepath for r in listed.collect() if "/." not in r.filepath}


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_rank_without_one_task(spark, parts):
    rows = [(i, "tie" if i % 3 else None) for i in range(90)] + [(100, "Äb"), (101, "ab"), (102, "AB"), (103, "b")]
    df = spark.createDataFrame(rows, "id long, title string").repartition(5)
    got = [(r["rank"], r.id) for r in lib.with_rank(df, lib.library_order("title"), parts=parts).collect()]
    assert [i for _, i in sorted(got)] == [i for i in range(90) if not i % 3] + [101, 102, 100, 103] + [i for i in range(90) if i % 3]
    assert sorted(r for r, _ in got) == list(range(1, 95))
    assert lib.with_rank(df.limit(0), lib.library_order("title")).count() == 0


def test_release_removes_files(spark):
    import os

    from tonelake.session import release, settle

    df = settle(spark.range(3), "gone")
    assert os.path.isdir(df._settled) and df.count() == 3
    release(df)
    assert not os.path.exists(df._settled)


def test_scan_makes_full_rows_with_both_vectors(spark):
    from tonelake.plans.scan import scan_songs

    files = spark.createDataFrame([("/m/one.mp3", 5.0, 1), ("/m/two.mp3", 6.0, 2)], "filepath string, file_mtime double, song_id long")
    frames = spark.createDataFrame([(s, 0.2, 2500.0, 20.0, 0.1, 4000.0, 2000.0, 0.5, 1.0, [1.0] * 13) for s in (1, 1, 9)], "song_id long, rms double, centroid double, contrast double, zcr double, rolloff double, bandwidth double, harmonic_abs double, signal_abs double, mfcc array<double>")
    chroma = spark.createDataFrame([(1, p, float(p in (0, 4, 7))) for p in range(12)], "song_id long, pitch int, value double")
    tempo = spark.createDataFrame([(1, 120.0)], "song_id long, bpm double")
    tags = spark.createDataFrame([(1, "Song", "Band", None, "rock")], "song_id long, title string, artist string, album string, genre string")
    text = "\n".join(["sad sad melancholy words again", "a different line here"] * 2)
    lyrics = spark.createDataFrame([(1, text), (2, "  "), (9, "x")], "song_id long, lyrics_text string")
    audio = spark.createDataFrame([(1, [0.5, 0.5])], "song_id long, clap_embedding array<float>")
    store = Catalog(spark, work_path(spark, "cat"), 2).create()
    store.sync(files.drop("song_id"), lambda rows: scan_songs(rows.join(files.select("filepath", "song_id"), "filepath"), frames, chroma, tempo, tags, lyrics, None, hashed_words, audio))
    one, two = store.read().orderBy("filepath").collect()
    assert (one.title, one.artist, one.album, one.genre, one.bpm, one.mode) == ("Song", "Band", "Unknown Album", "rock", 120.0, "major")
    assert one.has_lyrics and one.lyrics_emotion == "sadness" and one.valence < 0 and "Lyrics: " in one.rich_description
    assert len(one.embedding) == 64 and one.clap_embedding == [0.5, 0.5] and one.lyrics_processed
    assert (two.title, two.artist, two.bpm, two.has_lyrics, two.clap_embedding) == ("two", "Unknown Artist", None, False, None)
    assert len(two.embedding) == 64


def test_flush_of_a_folder_takes_its_entry(spark):
    from tonelake.sources.registry import FolderRegistry

    store = Catalog(spark, work_path(spark, "cat"), 2).create()
    store.upsert(rows(spark, [("/a/x", 1.0, "x", "d"), ("/b/y", 1.0, "y", "d")]))
    registry = FolderRegistry(spark, work_path(spark, "reg")).create()
    registry.upsert(spark.createDataFrame([("/a", 1.0, 1, 2), ("/b", 1.0, 1, 2)], "path string, last_scan_time double, song_count long, total_songs_in_db long"))
    store.delete_folder("/a", registry)
    assert titles(store) == {"/b/y": "y"} and [r.path for r in registry.read().collect()] == ["/b"]


# ---------------------------------------------------------------- what a change keeps on disk


def test_settled_tables_leave_no_shuffle_files(spark):
    from tonelake.session import CLEANUP, settle

    def dealt():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before, setting = dealt(), spark.conf.get(CLEANUP)
    df = settle(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "counted")
    assert not dealt() - before
    assert df.count() == 7 and spark.conf.get(CLEANUP) == setting


@pytest.mark.parametrize("kind", ["long", "string", "int"])
def test_rows_of_keys_are_found_before_they_are_dealt(spark, kind):
    from tonelake.functions.keys import key_bits, likely_rows, rows_of_keys

    keys = spark.sql(f"SELECT cast(id * 7 AS {kind}) AS k FROM range(3000) UNION ALL SELECT NULL")
    rows = spark.sql(f"SELECT cast(id AS {kind}) AS k, id AS n FROM range(30000) UNION ALL SELECT NULL, -1 UNION ALL SELECT cast(-id AS {kind}), -2 FROM range(1, 30000)")
    table = key_bits(keys, "k")
    got = sorted(r.n for r in rows_of_keys(rows, keys, "k", table).collect())
    assert got == [7 * i for i in range(3000)]
    likely = likely_rows(rows, "k", table)
    assert 3000 <= likely.count() < 8000 and likely.join(keys, "k", "left_semi").count() == 3000
    assert "Exchange hashpartitioning" not in likely._jdf.queryExecution().executedPlan().toString()
    wide = keys.select(F.col("k").cast("double"))  # equal keys of other types have other hashes
    assert rows_of_keys(rows.filter("k is not null"), wide, "k", key_bits(wide, "k")).count() == 3000
    none = keys.limit(0)
    assert rows_of_keys(rows, none, "k", key_bits(none, "k")).count() == 0


def test_a_scan_deals_few_frames_of_other_songs(spark):
    from tonelake.plans.scan import scan_songs

    files = spark.createDataFrame([(f"/m/{i}.mp3", 5.0, i) for i in range(20)], "filepath string, file_mtime double, song_id long")
    frames = spark.range(20_000).selectExpr(
        "id % 5000 AS song_id", "0.2D AS rms", "25D AS centroid", "2D AS contrast", "0.1D AS zcr", "4D AS rolloff", "2D AS bandwidth", "0.5D AS harmonic_abs", "1D AS signal_abs", "array(1D) AS mfcc")
    rows = scan_songs(files, frames, frames.selectExpr("song_id", "1 AS pitch", "1D AS value"), spark.range(5000).selectExpr("id AS song_id", "120D AS bpm"))
    assert rows.count() == 20 and rows.filter("bpm = 120 AND energy = 0.2").count() == 20
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("getbit") >= 3  # frames, chroma, tempo


def stored_tables(spark, *names):
    folder = shared_folder(spark).removeprefix("file:")
    return {n for n in os.listdir(folder) if n.startswith(names)}


def test_a_change_of_many_buckets_goes_by_few_at_a_time(spark, monkeypatch):
    """The same catalog as in one go, in smaller jobs; tables of the change are gone afterwards."""
    from tonelake.sources import catalog as cat

    process = lambda changed: changed.withColumn("title", F.concat(F.lit("at "), F.col("file_mtime").cast("string")))
    listing = lambda *rows: spark.createDataFrame(rows, FILES)
    before, found = stored_tables(spark, "changes", "deleted"), []
    for size in (1 << 29, 1):
        monkeypatch.setattr(cat, "SLICE", size)
        store = Catalog(spark, work_path(spark, "cat"), 6).create(mt.fresh_rows(rows(spark, [(f"/m/{i}", 1.0, "t", "d") for i in range(40)])))
        written, write = [], store._write
        monkeypatch.setattr(store, "_write", lambda r: written.append(write(r)) or written[-1])
        store.sync(listing(*[(f"/m/{i}", 1.0 + 9 * (i % 3)) for i in range(5, 60)], (None, 4.0)), process)
        assert len(written) == (1 if size > 1 else 6) and len({b for w in written for b in w}) == 6
        store.delete_paths(listing(("/m/7", 0.0), ("/m/8", 0.0), ("/m/none", 0.0)))
        store.upsert(rows(spark, [("/m/9", 2.0, "new", "d"), ("/m/9", 3.0, "newer", "d"), ("/x", 1.0, "x", "d")]))
        found.append(sorted(map(str, titles(store).items())))
        assert store.read().count() == len(found[-1])
    assert found[0] == found[1] and "('/m/9', 'newer')" in found[0] and len(found[0]) == 55
    assert stored_tables(spark, "changes", "deleted") == before


def test_a_batch_leaves_no_tables_of_its_own(spark):
    store = Catalog(spark, work_path(spark, "cat"), 2).create()
    before = stored_tables(spark, "listing-", "changed-", "changes-")
    for time_ in (1.0, 1.0, 9.0):
        ing.ingest_batch(store, spark.createDataFrame([("/m/1", time_), ("/m/2", 1.0)], FILES), lambda changed: changed)
    assert stored_tables(spark, "listing-", "changed-", "changes-") == before
    assert {r.filepath: r.file_mtime for r in store.read().collect()} == {"/m/1": 9.0, "/m/2": 1.0}
