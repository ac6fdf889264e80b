"""Whole passes over the catalog: the scan of files, as a change and as a stream, and the background lyrics pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.functions.vectors import hashed_words
from tonelake.operators import maintenance as mt
from tonelake.operators.emotion import LABELS, lexicon_scores
from tonelake.operators.library import pending
from tonelake.plans.scan import scan_songs
from tonelake.session import work_path
from tonelake.sources.catalog import Catalog
from tonelake.streaming import ingest as ing
from workload.lyrics import ANALYSED, LEXICON, S, SNIPPET, averages_sql, lookup_rows_sql
from workload.maintenance import DIFF_ALL
from workload.media import FEATURES, sentence_sql, vectors_sql
from workload.registry import q, query, r
from workload.views import duck

VECTOR = "list_sum(list_transform({0}, lambda x: x::DOUBLE))"
NUMBERS = ["bpm", "energy", "brightness", "valence", "arousal", "spectral_rolloff", "spectral_bandwidth", "dynamic_range", "key_confidence", "harmonic_ratio", "lyrics_emotion_score"]


def emotions_cte(name: str, lyrics: str) -> str:
    """A CTE with emotions and snippet of lyrics(song_id, lyrics_text): song_id, lyrics_emotion, score, valence, words, shares, snippet."""
    return f"""
{name} AS (WITH lyrics AS (SELECT song_id, lyrics_text FROM {lyrics}), {ANALYSED}, {averages_sql('scored')},
  parts AS (SELECT song_id, string_agg(printf('%.4f', round(a, 4)), ',' ORDER BY emotion_ord) AS shares FROM av GROUP BY 1),
  snips AS (WITH lyrics AS (SELECT song_id, lyrics_text FROM {lyrics}), {SNIPPET})
  SELECT l.song_id, l.lyrics_text, w.lyrics_emotion, w.lyrics_emotion_score, w.lyrics_valence, CASE WHEN w.song_id IS NOT NULL THEN coalesce(w.mood_words, '') END AS mood_words, parts.shares, snips.snippet
  FROM lyrics l LEFT JOIN wordy w USING (song_id) LEFT JOIN parts USING (song_id) LEFT JOIN snips USING (song_id))"""


WORDS = "CASE WHEN coalesce(mood_words, '') = '' THEN []::VARCHAR[] ELSE string_split(mood_words, '|') END"
BLENDED = "CASE WHEN coalesce(e.lyrics_valence, 0) <> 0 THEN coalesce({0}, 0) * 0.4e0 + e.lyrics_valence * 0.6e0 ELSE {0} END"
#: Every changed file of the listing as a full row of the catalog, next to the rows that stay as they are.
SCANNED = DIFF_ALL + f""", {duck('tags', 'lyrics', 'songs')},
feats AS ({FEATURES} SELECT song_id, mode, {q('bpm', 1)} AS bpm, {q('energy', 4)} AS energy, {q('brightness', 1)} AS brightness, {q('valence', 2)} AS valence, {q('arousal', 2)} AS arousal,
  {q('rolloff', 1)} AS spectral_rolloff, {q('bandwidth', 1)} AS spectral_bandwidth, {q('dynamic_range', 2)} AS dynamic_range, {q('key_confidence', 2)} AS key_confidence, {q('harmonic_ratio', 2)} AS harmonic_ratio,
  array_to_string(list_transform(mfccs, lambda x: printf('%.4f', x)), ',') AS mfccs FROM f LEFT JOIN mfcc_lists USING (song_id)),
sung AS (SELECT song_id, lyrics_text FROM lyrics WHERE {S('lyrics_text')} <> ''), {emotions_cte('felt', 'sung')},
changed AS (SELECT filepath, disk AS file_mtime, CAST(regexp_extract(filepath, '/([0-9]+)[^/]*$', 1) AS BIGINT) AS id FROM d WHERE status IN ('new', 'modified')),
joined AS (SELECT c.filepath, c.file_mtime, c.id, coalesce(nullif(t.title, ''), regexp_extract(c.filepath, '([^/]*)[.][^.]*$', 1)) AS title, coalesce(nullif(t.artist, ''), 'Unknown Artist') AS artist,
  coalesce(nullif(t.album, ''), 'Unknown Album') AS album, coalesce(t.genre, '') AS genre, f.* EXCLUDE (song_id, valence), {BLENDED.format('f.valence')} AS valence,
  e.lyrics_text, e.lyrics_emotion, e.lyrics_emotion_score, e.mood_words AS word_text, {WORDS.replace('mood_words', 'e.mood_words')} AS mood_words, e.shares, coalesce(e.snippet, '') AS snippet, s.clap_embedding
  FROM changed c LEFT JOIN tags t ON t.id = c.id LEFT JOIN feats f ON f.song_id = c.id LEFT JOIN felt e ON e.song_id = c.id LEFT JOIN songs s ON s.id = c.id),
keyed AS (SELECT * REPLACE (row_number() OVER () AS id) FROM joined), {sentence_sql('keyed')}, {vectors_sql('sentences')},
totals AS (SELECT id, sum(weight) AS total FROM vectors GROUP BY 1),
scanned AS (SELECT k.filepath, file_mtime, title, artist, album, genre, mode, {', '.join(f"{q(c)} AS {c}" for c in NUMBERS)}, mfccs, lyrics_text IS NOT NULL AS has_lyrics, length(lyrics_text) AS n_chars,
  true AS lyrics_processed, lyrics_emotion, shares, word_text AS words, rich_description, {q('total')} AS text_total, {q(VECTOR.format('clap_embedding'))} AS audio_total, true AS own_id
  FROM keyed k JOIN sentences USING (id) LEFT JOIN totals USING (id)),
stayed AS (SELECT filepath, known AS file_mtime, title, NULL AS artist, NULL AS album, NULL AS genre, NULL AS mode, {', '.join(f"NULL::DOUBLE AS {c}" for c in NUMBERS)}, NULL AS mfccs, false AS has_lyrics,
  NULL::BIGINT AS n_chars, false AS lyrics_processed, NULL AS lyrics_emotion, NULL AS shares, NULL AS words, NULL AS rich_description, NULL::DOUBLE AS text_total, NULL::DOUBLE AS audio_total, false AS own_id
  FROM d WHERE status NOT IN ('new', 'modified'@GONE))
SELECT * FROM scanned UNION ALL SELECT * FROM stayed"""


def whole_rows(catalog: DataFrame) -> DataFrame:
    """All columns of the catalog in a form that can be compared."""
    total = lambda c: r(F.aggregate(c, F.lit(0.0), lambda a, x: a + x))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    decimals = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.4f", x)), ",")
    share = F.array(*[F.try_element_at("emotion_distribution", F.lit(e)) for e in LABELS])
    return catalog.select(
        "filepath", "file_mtime", "title", "artist", "album", "genre", "mode", *[r(F.col(c)).alias(c) for c in NUMBERS],
        decimals(F.filter("mfccs", lambda x: x.isNotNull())).alias("mfccs"), flag("has_lyrics"), F.length("lyrics_text").cast("long").alias("n_chars"), flag("lyrics_processed"), "lyrics_emotion",
        F.when(F.col("emotion_distribution").isNotNull(), decimals(share)).alias("shares"), F.array_join("mood_words", "|").alias("words"),
        "rich_description", total("embedding").alias("text_total"), total("clap_embedding").alias("audio_total"), (F.col("id") == mt.song_id(F.col("filepath"))).alias("own_id"),
    )


def scan(t):
    """``process`` of a sync or a stream: features from frames, tags, lyrics with their emotions, sentence, both vectors."""

    def process(rows: DataFrame) -> DataFrame:
        files = rows.withColumn("song_id", F.regexp_extract("filepath", "/([0-9]+)[^/]*$", 1).cast("long"))
        return scan_songs(
            files, t.frames, t.chroma, t.tempo, t.tags.withColumnRenamed("id", "song_id"), t.lyrics, lambda chunks: lexicon_scores(chunks, LEXICON),
            audio_vectors=t.songs.select(F.col("id").alias("song_id"), "clap_embedding"),
        )

    return process


@query("S6_catalog_change", SCANNED.replace("@GONE", ", 'deleted'"))
def s6_change(t):
    """A whole scan against the stored catalog: diff, delete, process, upsert."""
    store = Catalog(t.spark, work_path(t.spark, "catalog"), 8).create(t.catalog)
    store.sync(t.files, scan(t))
    return whole_rows(store.read())


@query("R1_continuous_ingest", SCANNED.replace("@GONE", ""))
def r1(t):
    """The listing arrives in several files; the stream brings the stored catalog up to date."""
    store = Catalog(t.spark, work_path(t.spark, "catalog"), 8).create(t.catalog)
    listings = work_path(t.spark, "listings")
    t.files.repartition(3).write.parquet(listings)
    stream = ing.ingest_stream(t.spark, listings, store, scan(t), work_path(t.spark, "ingest-checkpoint"), files_per_batch=2)
    stream.awaitTermination()
    return whole_rows(store.read())


# ---------------------------------------------------------------- lyrics that come later

_LATER = ["id", "has_lyrics", "lyrics_processed", "n_chars", "lyrics_emotion", "score", "valence", "shares", "words", "rich_description", "text_total"]


def _later_rows(rows: DataFrame) -> DataFrame:
    whole = whole_rows(rows).withColumnRenamed("lyrics_emotion_score", "score").select("filepath", *_LATER[1:])
    return rows.select("id", "filepath").join(whole, "filepath").drop("filepath")


@query("W6_reprocess_pending", f"""WITH {duck('songs', 'lyrics')}, waiting AS (SELECT s.* EXCLUDE (lyrics_text), l.lyrics_text, ['happy', 'dark'] AS mood_words FROM songs s LEFT JOIN lyrics l ON l.song_id = s.id WHERE NOT lyrics_processed),
snips AS ({SNIPPET.replace('ln AS (', 'WITH ln AS (', 1).strip()}), rows AS (SELECT w.*, coalesce(snippet, '') AS snippet FROM waiting w LEFT JOIN snips ON snips.song_id = w.id),
{sentence_sql('rows')}, {vectors_sql('sentences')}, totals AS (SELECT id, {q('sum(weight)')} AS text_total FROM vectors GROUP BY 1)
SELECT id, rich_description, text_total, true AS lyrics_processed FROM sentences LEFT JOIN totals USING (id)""")
def w6(t):
    """Songs whose lyrics came later, with documents as lyrics, so that sentences quote them."""
    songs = t.songs.drop("lyrics_text").join(t.lyrics.select(F.col("song_id").alias("id"), "lyrics_text"), "id", "left")
    songs = songs.withColumns({"rich_description": F.lit(None).cast("string"), "mood_words": F.array(F.lit("happy"), F.lit("dark"))})
    done = mt.reprocess(pending(songs), hashed_words)
    total = r(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x))
    return done.select("id", "rich_description", total.alias("text_total"), "lyrics_processed")


_LOOKUPS = f"""WITH {duck('songs', 'lookup_results')}, asked AS (SELECT l.*, ordinal % 7 = 0 AS failed FROM lookup_results l WHERE song_id IN (SELECT id FROM songs WHERE NOT has_lyrics AND coalesce(lyrics_text, '') = '')),
tried AS (SELECT * FROM asked WHERE NOT failed), {lookup_rows_sql('tried')}, good AS (SELECT song_id, text AS lyrics_text FROM k WHERE n = 1),
outcomes AS (SELECT a.song_id, CASE WHEN bool_or(g.song_id IS NOT NULL) THEN 'found' WHEN bool_or(failed) THEN 'error' ELSE 'not_found' END AS outcome FROM asked a LEFT JOIN good g USING (song_id) GROUP BY 1)"""


ALL_FILES = 2**31 - 1


def _lyrics_pass(t) -> tuple[Catalog, str]:
    """The background pass over lookup results that arrive twice, the lookups of a song at one time, in as many files as their table has splits."""
    store = Catalog(t.spark, work_path(t.spark, "catalog"), 8).create(t.songs)
    results, log, checkpoint = work_path(t.spark, "results"), work_path(t.spark, "lyrics-log"), work_path(t.spark, "lyrics-checkpoint")
    rows = t.lookup_results.withColumns({"id": F.col("song_id"), "failed": F.col("ordinal") % 7 == 0}).select(*[c.split(" ")[0] for c in ing.LOOKUPS.split(", ")])
    score = lambda chunks: lexicon_scores(chunks, LEXICON, "id")
    for half in range(2):  # each run of the stream takes what has arrived since the last one as one batch
        rows.filter(F.floor(F.col("id") / 4) % 2 == half).write.mode("append").parquet(results)
        ing.lyrics_stream(t.spark, results, store, log, score, hashed_words, checkpoint, ALL_FILES).awaitTermination()
    return store, log


@query("R3_background_lyrics", _LOOKUPS + f""", {emotions_cte('felt', 'good')},
joined AS (SELECT s.* EXCLUDE (lyrics_text, valence), {BLENDED.format('s.valence')} AS valence, e.snippet, e.lyrics_text, e.lyrics_emotion, e.lyrics_emotion_score, e.shares, e.mood_words AS words, {WORDS.replace('mood_words', 'e.mood_words')} AS mood_words
  FROM songs s JOIN felt e ON e.song_id = s.id), {sentence_sql('joined')}, {vectors_sql('sentences')}, totals AS (SELECT id, {q('sum(weight)')} AS text_total FROM vectors GROUP BY 1)
SELECT id, true AS has_lyrics, true AS lyrics_processed, length(lyrics_text) AS n_chars, lyrics_emotion, {q('lyrics_emotion_score')} AS score, {q('valence')} AS valence, shares, words, rich_description, text_total
  FROM joined JOIN sentences USING (id) LEFT JOIN totals USING (id)
UNION ALL SELECT id, has_lyrics, lyrics_processed, length(lyrics_text), NULL, NULL, {q('valence')},
  CASE WHEN emotion_distribution IS NOT NULL THEN array_to_string(list_transform(map_values(emotion_distribution), lambda x: printf('%.4f', x)), ',') END, NULL, NULL, {q(VECTOR.format('embedding'))}
  FROM songs WHERE id NOT IN (SELECT song_id FROM good)""")
def r3(t):
    """Found lyrics reach the songs that lack them, with emotions, valence, sentence and vector, in one change per batch."""
    store, _ = _lyrics_pass(t)
    return _later_rows(store.read())


@query("R3_lyrics_outcomes", _LOOKUPS + """ SELECT count(*) FILTER (WHERE outcome = 'found') AS found, count(*) FILTER (WHERE outcome = 'not_found') AS not_found, count(*) FILTER (WHERE outcome = 'error') AS errors,
 count(*) AS total, (SELECT count(*) FROM songs WHERE NOT lyrics_processed AND id NOT IN (SELECT song_id FROM good)) AS pending FROM outcomes""")
def r3_outcomes(t):
    """What the pass reports: outcome counts of all batches, and how many songs are pending after it."""
    store, log = _lyrics_pass(t)
    left = pending(store.read()).agg(F.count("*").alias("n")).scalar()
    return mt.lyrics_outcomes(ing.lyrics_log(t.spark, log)).withColumn("pending", left)
