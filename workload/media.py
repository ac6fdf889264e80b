"""Frames to features, and text about songs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.functions.vectors import hashed_words, l2_normalise, norm
from tonelake.operators import describe as ds
from tonelake.operators import emotion as em
from tonelake.operators import features as ft
from workload.lyrics import S as strip_sql, clean_title_sql
from workload.registry import q, query, r, rule
from workload.views import duck

FRAMES = f"WITH {duck('frames')}"
CHROMA = duck("chroma") + """,
means AS (SELECT s.song_id, p.pitch, coalesce(avg(c.value), 0) AS m FROM (SELECT DISTINCT song_id FROM chroma) s
  CROSS JOIN (SELECT unnest(range(0, 12)) AS pitch) p LEFT JOIN chroma c ON c.song_id = s.song_id AND c.pitch = p.pitch GROUP BY 1, 2),
profile AS (SELECT song_id, pitch, m / (sum(m) OVER (PARTITION BY song_id) + 1e-6) AS v FROM means)"""
KEYS = CHROMA + f""",
{rule('key_profiles')},
sums AS (SELECT song_id, shift, k.mode, mode_ord, sum(v) AS sx, sum(weight) AS sy, sum(v * weight) AS sxy, sum(v * v) AS sxx, sum(weight * weight) AS syy
  FROM profile JOIN key_profiles k USING (pitch) GROUP BY ALL),
cors AS (SELECT song_id, shift, mode, mode_ord, CASE WHEN 12 * sxx - sx * sx > 1e-18 THEN
    round((12 * sxy - sx * sy) / (sqrt(12 * sxx - sx * sx) * sqrt(12 * syy - sy * sy)), 9) END AS c FROM sums),
best AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY coalesce(c, -1) DESC, shift, mode_ord) AS n FROM cors),
keys AS (SELECT song_id, greatest(0e0, least(1e0, coalesce(c, -1))) AS key_confidence,
    CASE WHEN coalesce(c, -1) < 0.3 THEN 'unknown' ELSE ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][shift + 1] END AS key,
    CASE WHEN coalesce(c, -1) < 0.3 THEN 'unknown' ELSE mode END AS mode FROM best WHERE n = 1)"""
OCTAVE = "CASE WHEN bpm > 160 AND energy < 0.18 THEN bpm / 2 WHEN bpm < 55 THEN bpm * 2 ELSE bpm END"
VALENCE = """greatest(-1e0, least(1e0, CASE WHEN mode = 'major' THEN 1 ELSE -1 END * CASE WHEN key_confidence >= 0.65e0 THEN 0.3e0 * (key_confidence - 0.65e0) / (1e0 - 0.65e0) ELSE 0 END
 + CASE WHEN bpm > 0 THEN greatest(-0.2e0, least(0.2e0, (bpm - 100) / 100 * 0.2e0)) ELSE 0 END
 + CASE WHEN brightness > 0 THEN greatest(-0.15e0, least(0.15e0, (brightness - 2200) / 2000 * 0.15e0)) ELSE 0 END
 + greatest(-0.1e0, least(0.1e0, (contrast - 20) / 20 * 0.1e0)) - CASE WHEN zcr > 0.15 THEN 0.05e0 ELSE 0 END))"""
AROUSAL = """greatest(0e0, least(1e0, CASE WHEN bpm > 0 THEN greatest(-0.2e0, least(0.5e0, (bpm - 80) / 160e0)) ELSE 0 END
 + greatest(0e0, least(1e0, (energy - 0.05e0) / 0.35e0)) * 0.3e0))"""


@query("A3_frame_means", FRAMES + " SELECT song_id, " + ", ".join(f"{q(f'avg({c})')} AS {c}" for c in ("rms", "centroid", "contrast", "zcr", "rolloff", "bandwidth")) + " FROM frames GROUP BY 1")
def a3(t):
    cols = ["rms", "centroid", "contrast", "zcr", "rolloff", "bandwidth"]
    return ft.frame_means(t.frames, cols).select("song_id", *[r(F.col(c)).alias(c) for c in cols])


@query("A4_mfcc_means", FRAMES + f""", x AS (SELECT song_id, unnest(mfcc) AS v, generate_subscripts(mfcc, 1) AS i FROM frames)
 SELECT song_id, CAST(i AS INT) - 1 AS coefficient, {q('avg(v)')} AS mean FROM x GROUP BY 1, 2""")
def a4(t):
    return ft.mfcc_means(t.frames).select("song_id", F.posexplode("mfccs").alias("coefficient", "mean"))


@query("A5_harmonic_ratio", FRAMES + f" SELECT song_id, {q('avg(abs(harmonic_abs)) / (avg(abs(signal_abs)) + 1e-6)')} AS harmonic_ratio FROM frames GROUP BY 1")
def a5(t):
    return ft.harmonic_ratio(t.frames).select("song_id", r(F.col("harmonic_ratio")).alias("harmonic_ratio"))


_A6 = FRAMES + f" SELECT song_id, {q('ln(1 + quantile_cont(rms, 0.95) / (quantile_cont(rms, 0.05) + 1e-6))')} AS dynamic_range FROM frames GROUP BY 1"


@query("A6_dynamic_range", _A6)
def a6(t):
    return ft.dynamic_range(t.frames).select("song_id", r(F.col("dynamic_range")).alias("dynamic_range"))


@query("A6_dynamic_range_hot_songs", f"""WITH {duck('frames')}, few AS (SELECT CASE WHEN song_id % 3 = 0 THEN -1 ELSE song_id % 7 END AS song_id, rms FROM frames)
 SELECT song_id, {q('ln(1 + quantile_cont(rms, 0.95) / (quantile_cont(rms, 0.05) + 1e-6))')} AS dynamic_range FROM few GROUP BY 1""")
def a6_hot(t):
    """The same where one song has a third of all frames."""
    few = t.frames.select(F.when(F.col("song_id") % 3 == 0, F.lit(-1)).otherwise(F.col("song_id") % 7).alias("song_id"), "rms")
    return ft.dynamic_range(few).select("song_id", r(F.col("dynamic_range")).alias("dynamic_range"))


@query("A7_chroma_profile", f"WITH {CHROMA} SELECT song_id, CAST(pitch AS INT) AS pitch, {q('v')} AS share FROM profile")
def a7(t):
    return ft.chroma_profile(t.chroma).select("song_id", F.posexplode("chroma").alias("pitch", "share")).withColumn("share", r(F.col("share")))


@query("A8_key_detection", f"WITH {KEYS} SELECT song_id, key, mode, {q('key_confidence')} AS key_confidence FROM keys")
def a8(t):
    return ft.detect_key(ft.chroma_profile(t.chroma)).select("song_id", "key", "mode", r(F.col("key_confidence")).alias("key_confidence"))


@query("P6_octave_correction", f"WITH {duck('frames', 'tempo')}, e AS (SELECT song_id, {q('avg(rms)', 9)} AS energy FROM frames GROUP BY 1) SELECT song_id, {OCTAVE} AS bpm FROM tempo JOIN e USING (song_id)")
def p6(t):
    energy = ft.frame_means(t.frames, ["rms"])
    return t.tempo.join(energy, "song_id").select("song_id", ft.correct_octave(F.col("bpm"), r(F.col("rms"), 9)).alias("bpm"))


FEATURES = f"""WITH {duck('frames', 'tempo')}, {KEYS},
mfcc_rows AS (SELECT song_id, unnest(mfcc) AS v, generate_subscripts(mfcc, 1) AS i FROM frames),
mfcc_means AS (SELECT song_id, i, {q('avg(v)')} AS mean FROM mfcc_rows GROUP BY 1, 2),
mfcc_lists AS (SELECT song_id, list(mean ORDER BY i) AS mfccs FROM mfcc_means GROUP BY 1),
m AS (SELECT song_id, {q('avg(rms)', 9)} AS energy, {q('avg(centroid)', 9)} AS brightness, {q('avg(contrast)', 9)} AS contrast, {q('avg(zcr)', 9)} AS zcr, {q('avg(rolloff)', 9)} AS rolloff,
  {q('avg(bandwidth)', 9)} AS bandwidth, avg(abs(harmonic_abs)) / (avg(abs(signal_abs)) + 1e-6) AS harmonic_ratio,
  ln(1 + quantile_cont(rms, 0.95) / (quantile_cont(rms, 0.05) + 1e-6)) AS dynamic_range FROM frames GROUP BY 1),
j AS (SELECT m.* EXCLUDE (bpm), k.key, k.mode, k.key_confidence, {OCTAVE} AS bpm FROM (SELECT m.*, t.bpm FROM m JOIN tempo t USING (song_id)) m JOIN keys k USING (song_id)),
f AS (SELECT *, {VALENCE} AS valence, {AROUSAL} AS arousal FROM j)
"""


@query("P7_valence_estimate", FEATURES + f"SELECT song_id, {q('valence', 2)} AS valence FROM f")
def p7(t):
    return ft.song_features(t.frames, t.chroma, t.tempo).select("song_id", "valence")


@query("P8_arousal_estimate", FEATURES + f"SELECT song_id, {q('arousal', 2)} AS arousal FROM f")
def p8(t):
    return ft.song_features(t.frames, t.chroma, t.tempo).select("song_id", "arousal")


@query("A0_song_features", FEATURES + f"""SELECT song_id, key, mode, {q('bpm', 1)} AS bpm, {q('energy', 4)} AS energy, {q('brightness', 1)} AS brightness, {q('key_confidence', 2)} AS key_confidence,
 {q('valence', 2)} AS valence, {q('arousal', 2)} AS arousal, {q('contrast', 2)} AS spectral_contrast, {q('zcr', 4)} AS zero_crossing, {q('harmonic_ratio', 2)} AS harmonic_ratio,
 {q('rolloff', 1)} AS spectral_rolloff, {q('bandwidth', 1)} AS spectral_bandwidth, {q('dynamic_range', 2)} AS dynamic_range,
 array_to_string(list_transform(mfccs, lambda x: printf('%.4f', x)), ',') AS mfccs FROM f LEFT JOIN mfcc_lists USING (song_id)""")
def a0(t):
    """Cepstral means as text, missing ones left out."""
    mfccs = F.array_join(F.transform(F.filter("mfccs", lambda x: x.isNotNull()), lambda x: F.format_string("%.4f", x)), ",")
    return ft.song_features(t.frames, t.chroma, t.tempo).withColumn("mfccs", mfccs)


@query("P9_theory_label", f"""WITH {duck('songs')} SELECT id, concat_ws(', ',
 CASE WHEN bpm < 70 THEN 'Very Slow (Largo)' WHEN bpm < 100 THEN 'Slow (Adagio)' WHEN bpm < 120 THEN 'Moderate Tempo' WHEN bpm < 160 THEN 'Fast (Allegro)' ELSE 'Very Fast (Presto)' END,
 CASE WHEN energy < 0.05 THEN 'Quiet' WHEN energy > 0.12 THEN 'Intense' END, CASE WHEN mode = 'major' THEN 'Major Key' ELSE 'Minor Key' END,
 CASE WHEN valence > 0.3 THEN 'Happy/Uplifting' WHEN valence > 0.1 THEN 'Positive/Bright' WHEN valence < -0.3 THEN 'Sad/Melancholic' WHEN valence < -0.1 THEN 'Somber/Reflective' END,
 CASE WHEN arousal > 0.7 THEN 'High Energy' WHEN arousal < 0.3 THEN 'Calm/Relaxed' END,
 CASE WHEN brightness < 1500 THEN 'Dark Timbre' WHEN brightness > 3000 THEN 'Bright Timbre' END) AS label FROM songs""")
def p9(t):
    c = F.col
    return t.songs.select("id", ds.theory_label(c("bpm"), c("energy"), c("brightness"), c("mode"), c("valence"), c("arousal")).alias("label"))


def _flat(cases: list[tuple[str, list[str]]]) -> str:
    body = " ".join(f"WHEN {test} THEN [{', '.join(repr(w) for w in ws)}]" for test, ws in cases)
    return f"CASE {body} ELSE [] END"


MOODS = "list_concat(" * 6 + ", ".join([
    _flat([
        ("ar > 0.55 AND valence > 0.1", ["energetic", "upbeat", "powerful", "lively"]),
        ("ar > 0.55 AND valence < -0.1", ["intense", "dark", "aggressive", "fierce"]),
        ("ar < 0.45 AND valence > 0.1", ["calm", "peaceful", "gentle", "serene"]),
        ("ar < 0.45 AND valence < -0.1", ["sad", "melancholic", "somber", "mournful"]),
        ("ar > 0.55", ["driving", "energetic"]), ("ar < 0.45", ["relaxed", "mellow"]),
        ("valence > 0.1", ["positive", "cheerful"]), ("valence < -0.1", ["reflective", "contemplative"]),
        ("true", ["moderate", "steady"]),
    ]),
    _flat([("dynamic_range > 2.8", ["dramatic", "cinematic", "epic"]), ("dynamic_range < 1.2", ["ambient", "steady", "uniform"])]) + ")",
    "mood_words)",
    _flat([("key_confidence >= 0.65 AND mode = 'major'", ["bright"]), ("key_confidence >= 0.65 AND mode = 'minor'", ["dark"])]) + ")",
    _flat([("harmonic_ratio > 0.85", ["melodic", "smooth"]), ("harmonic_ratio < 0.55", ["percussive", "rhythmic"])]) + ")",
    _flat([("bpm >= 125", ["fast"]), ("bpm > 0 AND bpm <= 85", ["slow"])]) + ")",
    _flat([("brightness >= 3000", ["sharp"]), ("brightness > 0 AND brightness <= 1500", ["deep"])]) + ")",
])
SNIPPETS = "CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN 'too short' ELSE concat('la la la the chorus goes on ', id, chr(10), 'and on') END"


def sentence_sql(source: str) -> str:
    """CTEs up to ``sentences(id, rich_description)`` of a table with the columns of a song, its mood words and snippet."""
    zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("bpm", "energy", "brightness", "valence", "dynamic_range", "harmonic_ratio"))
    return f"""
s AS (SELECT * REPLACE ({zero}, coalesce(key_confidence, 0.5) AS key_confidence, coalesce(mode, '') AS mode, coalesce(mood_words, []) AS mood_words), coalesce(arousal, 0) AS ar,
   {clean_title_sql('title')} AS clean FROM {source}),
spoken AS (SELECT id, w, min(pos) AS pos FROM (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT id, {MOODS} AS ws FROM s)) GROUP BY 1, 2),
topwords AS (SELECT id, w, pos, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM spoken),
moods AS (SELECT id, string_agg(w, ', ' ORDER BY pos) AS m FROM topwords WHERE n <= 10 GROUP BY 1),
sentences AS (SELECT id, concat('A ', m, ' track',
 CASE WHEN bpm > 0 THEN concat(' at ', CAST(CAST(round_even(bpm, 0) AS INT) AS VARCHAR), ' BPM (', CASE WHEN bpm >= 160 THEN 'very fast' WHEN bpm >= 120 THEN 'moderately fast' WHEN bpm >= 90 THEN 'moderate tempo' WHEN bpm >= 70 THEN 'slow' ELSE 'very slow' END, ')') ELSE '' END,
 CASE WHEN key_confidence >= 0.65 AND mode <> '' THEN CASE WHEN mode = 'major' THEN ' in a major key' ELSE ' in a minor key' END ELSE '' END,
 CASE WHEN energy > 0.25 THEN ' with high intensity' WHEN energy < 0.1 THEN ' with gentle dynamics' ELSE '' END,
 CASE WHEN dynamic_range > 2.8 THEN ' and dramatic swells' WHEN dynamic_range < 1.2 THEN ' with steady volume' ELSE '' END,
 CASE WHEN lower(coalesce(genre, '')) IN ('', 'unknown') THEN '' ELSE concat('. ', genre, ' genre') END, CASE WHEN clean <> '' THEN concat('. ', clean) ELSE '' END,
 CASE WHEN length(snippet) > 20 THEN concat(' Lyrics: ', left({strip_sql("replace(snippet, chr(10), ' ')")}, 300), '...') ELSE '' END) AS rich_description
FROM s JOIN moods USING (id))"""


SENTENCES = f"WITH {duck('songs')}, with_words AS (SELECT *, CASE WHEN id % 2 = 0 THEN ['happy', 'dark'] ELSE [] END AS mood_words, {SNIPPETS} AS snippet FROM songs), {sentence_sql('with_words')}"


def vectors_sql(source: str) -> str:
    """CTE ``vectors(id, slot, weight)`` of the texts of source(id, rich_description)."""
    return f"""
tok AS (SELECT id, unnest(regexp_extract_all(lower(rich_description), '[a-z'']+')) AS token FROM {source}),
slots AS (SELECT id, CAST('0x' || substr(md5(token), 1, 6) AS INT) % 64 AS slot, count(*)::DOUBLE AS n FROM tok GROUP BY 1, 2),
sizes AS (SELECT id, sqrt(sum(n * n)) + 1e-8 AS size FROM slots GROUP BY 1),
vectors AS (SELECT id, slot, (n / size)::FLOAT::DOUBLE AS weight FROM slots JOIN sizes USING (id))"""


def described(t):
    songs = t.songs.withColumn("mood_words", F.when(F.col("id") % 2 == 0, F.array(F.lit("happy"), F.lit("dark"))).otherwise(F.array().cast("array<string>")))
    snippet = F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "too short").otherwise(
        F.concat(F.lit("la la la the chorus goes on "), F.col("id").cast("string"), F.lit("\nand on"))
    )
    return ds.describe_songs(songs.withColumn("snippet", snippet))


@query("P10_mood_sentence", SENTENCES + " SELECT id, rich_description FROM sentences")
def p10(t):
    return described(t).select("id", "rich_description")


@query("P11_valence_blend", f"WITH {duck('songs')} SELECT id, CASE WHEN lv <> 0 THEN {q('coalesce(valence, 0) * 0.4e0 + lv * 0.6e0')} ELSE {q('valence')} END AS valence FROM (SELECT id, valence, CASE WHEN id % 7 = 0 THEN 0e0 ELSE brightness / 4000 - 0.5e0 END AS lv FROM songs)")
def p11(t):
    lyrics = F.when(F.col("id") % 7 == 0, 0.0).otherwise(F.col("brightness") / 4000 - 0.5)
    return t.songs.select("id", r(em.blend_valence(F.col("valence"), lyrics)).alias("valence"))


@query("T13_text_vectors", SENTENCES + f", {vectors_sql('sentences')} SELECT id, CAST(slot AS INT) AS slot, {q('weight')} AS weight FROM vectors")
def t13(t):
    rows = described(t).select("id", F.posexplode(hashed_words(F.col("rich_description"))).alias("slot", "weight"))
    return rows.filter(F.col("weight") > 0).select("id", "slot", r(F.col("weight").cast("double")).alias("weight"))


@query("T14_l2_normalise", f"SELECT vec_id AS id, {q('sqrt(list_sum(list_transform(e, lambda x: (x / n) * (x / n))))')} AS size, {q('e[1] / n')} AS first FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 3 * x::DOUBLE * 3))) + 1e-8 AS n FROM embeddings)")
def t14(t):
    v = l2_normalise(F.transform("embedding", lambda x: x.cast("double") * 3))
    return t.embeddings.select(F.col("vec_id").alias("id"), v.alias("v")).select("id", r(norm(F.col("v"))).alias("size"), r(F.get("v", F.lit(0))).alias("first"))


@query("scan_new_files", FEATURES + f""", {duck('files')}, keyed AS (SELECT *, CAST(regexp_extract(filepath, '/([0-9]+)[^/]*$', 1) AS BIGINT) AS song_id FROM files)
SELECT filepath, file_mtime, regexp_extract(filepath, '([^/]*)[.][^.]*$', 1) AS title, 'Unknown Artist' AS artist, 'Unknown Album' AS album, '' AS genre, mode,
 {q('bpm', 1)} AS bpm, {q('energy', 4)} AS energy, {q('brightness', 1)} AS brightness, {q('valence', 2)} AS valence, {q('arousal', 2)} AS arousal,
 {q('rolloff', 1)} AS spectral_rolloff, {q('bandwidth', 1)} AS spectral_bandwidth, {q('dynamic_range', 2)} AS dynamic_range, {q('key_confidence', 2)} AS key_confidence,
 {q('harmonic_ratio', 2)} AS harmonic_ratio, false AS has_lyrics, true AS lyrics_processed, true AS has_text_vector, f.song_id IS NOT NULL AS described
FROM keyed LEFT JOIN f USING (song_id)""")
def scan_new_files(t):
    """Every file of the listing scanned: features from frames, defaults for missing tags, sentence, vector."""
    from tonelake.plans.scan import scan_songs

    files = t.files.withColumn("song_id", F.regexp_extract("filepath", "/([0-9]+)[^/]*$", 1).cast("long"))
    rows = scan_songs(files, t.frames, t.chroma, t.tempo)
    return rows.select(
        "filepath", "file_mtime", "title", "artist", "album", "genre", "mode", "bpm", "energy", "brightness", "valence", "arousal", "spectral_rolloff",
        "spectral_bandwidth", "dynamic_range", "key_confidence", "harmonic_ratio", "has_lyrics", "lyrics_processed",
        (F.size("embedding") == 64).alias("has_text_vector"), F.contains("rich_description", F.lit(" BPM (")).alias("described"),
    )
