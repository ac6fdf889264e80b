"""Features, percentiles, text cleaning, chunks, emotions, sentences."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonelake.functions import text as tx
from tonelake.functions.numbers import js_round, stable_round
from tonelake.sources import lyrics_cache as lc
from tonelake.functions.quantiles import double_of, exact_percentiles, ordered_bits
from tonelake.functions.vectors import decode_float32, hashed_words, l2_normalise, with_model_vectors
from tonelake.operators import describe as ds
from tonelake.operators import emotion as em
from tonelake.operators import features as ft
from tonelake.operators import lyrics as ly
from tonelake.rules import KEY_MINOR

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


# ---------------------------------------------------------------- percentiles

PROBS = {"a": 0.05, "b": 0.5, "c": 0.95}


def frame_rows(seed=1):
    rng = random.Random(seed)
    rows = [("hot", rng.choice([rng.gauss(5, 2), round(rng.random(), 1), 1e6])) for _ in range(3000)]
    rows += [(f"k{i % 40}", rng.random()) for i in range(400)] + [("flat", 2.0)] * 50 + [("single", -1.0)]
    return rows


@pytest.mark.parametrize("few,shifts", [(1 << 16, (44, 22, 0)), (20, (44, 22, 0)), (1, (44, 22, 0)), (20, (60, 50, 33, 7, 0))])
def test_percentiles_equal_numpy_for_any_passes(spark, few, shifts):
    rows = frame_rows() + [("signs", x) for x in (-1e300, -2.5, -0.0, 0.0, 5e-324, -5e-324, 1.0, 7e200, -3.0) for _ in range(4)]
    df = spark.createDataFrame(rows + [("k1", None), ("k1", float("nan"))], "k string, v double").repartition(4)
    got = {r.k: r for r in exact_percentiles(df, "k", "v", PROBS, few, shifts).collect()}
    keys = {k for k, _ in rows}
    assert got.keys() == keys
    for k in keys:
        values = [v for kk, v in rows if kk == k]
        for name, p in PROBS.items():
            assert got[k][name] == pytest.approx(np.percentile(values, p * 100), rel=1e-9)


def test_an_outlier_leaves_values_spread(spark):
    """One far value does not put all others into one bucket: leading bits tell small values apart as well as large ones."""
    df = spark.createDataFrame([("k", float(i)) for i in range(2000)] + [("k", 1e12)], "k string, v double")
    assert exact_percentiles(df, "k", "v", {"m": 0.5}, few=10).first().m == 1000.0
    codes = df.select(ordered_bits(F.col("v")).alias("u")).groupBy(F.shiftright("u", 44)).count()
    assert codes.count() > 1000 and codes.agg(F.max("count")).first()[0] <= 4


def test_bits_sort_as_doubles_do(spark):
    values = [-math.inf, -1e300, -2.0, -1.5, -5e-324, 0.0, 5e-324, 1e-300, 1.0, 1.5, 7e200, math.inf]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordered_bits(F.col("v")).alias("u"))
    got = rows.select("v", "u", double_of(F.col("u")).alias("back")).collect()
    assert [r.v for r in sorted(got, key=lambda r: r.u)] == values and all(r.v == r.back for r in got)


def test_no_values_are_sorted(spark):
    df = spark.createDataFrame(frame_rows(), "k string, v double")
    plan = exact_percentiles(df, "k", "v", PROBS)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan.replace("SortAggregate", "") and "Window" not in plan


def test_percentiles_known_values(spark):
    df = spark.createDataFrame([("k", v) for v in (1.0, 2.0, 3.0, 10.0)], "k string, v double")
    r = exact_percentiles(df, "k", "v", {"low": 0.05, "high": 0.95}).first()
    assert (r.low, r.high) == (pytest.approx(1.15), pytest.approx(8.95))


# ---------------------------------------------------------------- features


def test_key_detection(spark):
    minor_d = [KEY_MINOR[(p - 2) % 12] for p in range(12)]
    rows = [(1, p, minor_d[p]) for p in range(12)] + [(2, p, 1.0) for p in range(12)] + [(3, p, 0.0) for p in range(12)]
    chroma = spark.createDataFrame(rows, "song_id long, pitch int, value double")
    got = {r.song_id: r for r in ft.detect_key(ft.chroma_profile(chroma)).collect()}
    assert (got[1].key, got[1].mode) == ("D", "minor") and got[1].key_confidence == pytest.approx(1.0)
    for i in (2, 3):  # even and silent profiles correlate with nothing
        assert (got[i].key, got[i].mode, got[i].key_confidence) == ("unknown", "unknown", 0.0)


@pytest.mark.parametrize("bpm,energy,expected", [(170.0, 0.1, 85.0), (170.0, 0.2, 170.0), (50.0, 0.3, 100.0), (0.0, 0.3, 0.0), (120.0, 0.1, 120.0)])
def test_octave(spark, bpm, energy, expected):
    assert one(spark, ft.correct_octave(F.lit(bpm), F.lit(energy))) == expected


def test_valence_and_arousal_bounds(spark):
    lit = lambda *xs: [F.lit(x) for x in xs]
    v = ft.estimate_valence(*lit(300.0, 9000.0), F.lit("major"), *lit(80.0, 0.0, 1.0))
    assert one(spark, v) == pytest.approx(0.30 + 0.20 + 0.15 + 0.10)
    v = ft.estimate_valence(*lit(0.0, 0.0), F.lit("unknown"), *lit(20.0, 0.2, 0.825))
    assert one(spark, v) == pytest.approx(-0.15 - 0.05)
    assert one(spark, ft.estimate_arousal(F.lit(400.0), F.lit(1.0))) == pytest.approx(0.8)
    assert one(spark, ft.estimate_arousal(F.lit(10.0), F.lit(0.0))) == 0.0


def test_song_features_of_a_silent_song(spark):
    frames = spark.createDataFrame(
        [(1, *[0.0] * 8, [0.0] * 13)] * 3,
        "song_id long, rms double, centroid double, contrast double, zcr double, rolloff double, bandwidth double, harmonic_abs double, signal_abs double, mfcc array<double>",
    )
    chroma = spark.createDataFrame([(1, p, 0.0) for p in range(12)], "song_id long, pitch int, value double")
    tempo = spark.createDataFrame([(1, 0.0)], "song_id long, bpm double")
    r = ft.song_features(frames, chroma, tempo).first()
    assert (r.bpm, r.mode, r.dynamic_range, r.harmonic_ratio, r.arousal) == (0.0, "unknown", 0.0, 0.0, 0.0)
    assert r.mfccs == [0.0] * 13 and r.valence == -0.1


def test_rounding(spark):
    assert one(spark, stable_round(F.lit(0.12625 - 1e-15), 4)) == 0.1263
    assert one(spark, js_round(F.lit(2.5))) == 3 and one(spark, js_round(F.lit(-2.5))) == -2


# ---------------------------------------------------------------- text

LYRICS = """[Verse 1]
[ar:Somebody]
[00:12.34] First line of it
[00:13] tiny
  Second line of it\t
(Translation:) gone
Written by Nobody
Hey

[Pre-Chorus 2]
Third [01:02.345] line here
[not a header] stays"""


def test_clean_lyrics(spark):
    want = "First line of it\nSecond line of it\nThird  line here\n[not a header] stays"
    assert one(spark, tx.clean_lyrics(F.col("x")), LYRICS) == want
    assert one(spark, tx.clean_lyrics(F.col("x")), None) == ""


@few
@given(st.lists(st.text(alphabet="ab [](:)\tcrede", max_size=30), max_size=12))
def test_clean_lyrics_is_idempotent(spark, lines):
    once = one(spark, tx.clean_lyrics(F.col("x")), "\n".join(lines))
    assert one(spark, tx.clean_lyrics(F.col("x")), once) == once


@pytest.mark.parametrize("raw,clean", [
    ("01. Song (Official Video) [HQ]", "Song"), ('Tune (From "A Film") (Live)', "Tune (Live)"), (" 2 -  The   End ", "The End"),
    ("12", "12"), (None, ""), ("Ode [from The Movie]", "Ode"), ("Air (lyrics)", "Air"),
])
def test_clean_title(spark, raw, clean):
    assert one(spark, tx.clean_title(F.col("x")), raw) == clean


@pytest.mark.parametrize("raw,clean", [("Band - Topic", "Band"), ("BandVEVO", "Band"), ("Band (UK) ", "Band"), ("Band – topic", "Band"), (None, "")])
def test_clean_artist(spark, raw, clean):
    assert one(spark, tx.clean_artist(F.col("x")), raw) == clean


@pytest.mark.parametrize("raw,clean", [("A feat. B", "A"), ("A & B", "A"), ("Song (Music Video) ft. X", "Song"), ("X/Y; Z", "X"), ("most", "most")])
def test_clean_lookup(spark, raw, clean):
    assert one(spark, tx.clean_lookup(F.col("x")), raw) == clean


def test_lrc_and_quality(spark):
    assert one(spark, tx.strip_lrc(F.col("x")), "[ti:x]\n[00:01.00] a\n[00:02.000]\n[1:02.00] b") == "a\n[1:02.00] b"
    good = "\n".join(["some words of a song"] * 3)
    for text, ok in [(good, True), (good[:49], False), (good.replace("\n", " "), False), ("Instrumental\n" + good, False), ("x" * 200 + "instrumental\n" + good, True), (None, False)]:
        assert one(spark, tx.is_valid_lyrics(F.col("x")), text) is ok
    assert one(spark, tx.is_instrumental_artist(F.col("x")), "Ghost Band") is True  # 'ost' inside
    assert one(spark, tx.is_instrumental_artist(F.col("x")), None) is False


def snippet(spark, text):
    return ly.with_snippet(spark.createDataFrame([(1, text)], "id long, lyrics_text string")).first().snippet


def test_snippet(spark):
    assert snippet(spark, None) == "" and snippet(spark, "short") == ""
    chorus = ["intro goes here", "early twice line", "early twice line", "middle chorus line", "other words here", "middle chorus line", "bridge of song", "final words now"]
    # mean places: early (1+2)/2/8 = .19, chorus (3+5)/2/8 = .5
    assert snippet(spark, "\n".join(chorus)) == "middle chorus line early twice line"
    plain = [f"line number {i}" for i in range(7)]
    assert snippet(spark, "\n".join(plain)) == " ".join(plain[1:6])
    assert snippet(spark, "\n".join(["only one line that is long"])) == "only one line that is long"
    long = "\n".join(["w" * 250 + str(i % 4) for i in range(8)])
    assert len(snippet(spark, long)) == 600


def chunks(spark, text):
    return one(spark, ly.chunk_text(F.col("x")), text)


def test_chunks_of_paragraphs_and_lines(spark):
    para = lambda c, n: c * n
    assert chunks(spark, "  short text ") == ["short text"]
    text = "\n\n".join([para("a", 1000), para("b", 1000), para("c", 1000)])
    assert [len(c) for c in chunks(spark, text)] == [2002, 1000]
    text = para("a", 100) + "\n\n" + "\n".join([para("b", 1200)] * 3) + "\n\n" + para("c", 50)
    got = chunks(spark, text)
    assert [c[0] for c in got] == ["a", "b", "b"] and [len(c) for c in got] == [100, 2401, 1252]
    assert [len(c) for c in chunks(spark, para("a", 3000))] == [3000]  # a single line stays whole
    assert chunks(spark, "\n".join([para("x", 20), para("y", 2600)]))[0] == para("y", 2600)  # short piece dropped


@few
@given(st.integers(0, 10**6))
def test_chunks_keep_the_text(spark, seed):
    rng = random.Random(seed)
    text = "".join(
        rng.choice("abcdefgh") * rng.randint(30, 900) + rng.choice(["\n", "\n\n", "\n\n\n", " \n"]) for _ in range(rng.randint(3, 14))
    )
    got = chunks(spark, text)
    assert all(len(c) <= ly.MAX_CHUNK for c in got)
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(got)) == squeeze(text)


def test_source_resolution(spark):
    rows = [
        (1, "tag", "t"), (1, "stored", "s"), (2, "sidecar_txt", "txt"), (2, "sidecar_lrc", ""), (3, "cache", "  "), (3, "online", "o"),
        (4, "stored", ""), (4, "cache", " c "), (5, "sidecar_lrc", "[00:01.00] long line here"), (6, "stored", None),
    ]
    got = {r.song_id: (r.source, r.lyrics_text) for r in ly.resolve_sources(spark.createDataFrame(rows, "song_id long, source string, text string")).collect()}
    assert got == {1: ("stored", "s"), 2: ("sidecar_lrc", None), 3: ("online", "o"), 4: ("cache", "c"), 5: ("sidecar_lrc", "long line here")}


def test_no_text_is_shuffled_before_its_song_is_settled(spark, tmp_path):
    rows = [(k % 5, s, k, f"text {k}") for k, s in enumerate(["tag", "online", "cache", "sidecar_lrc"] * 10)]
    spark.createDataFrame(rows + rows, "song_id long, source string, ordinal long, text string").write.parquet(str(tmp_path / "c"))
    picked = ly.resolve_sources(spark.read.parquet(str(tmp_path / "c")), ordinal="ordinal")
    assert picked.count() == 5 and picked.filter("source = 'sidecar_lrc'").count() == 5
    plan = picked._jdf.queryExecution().optimizedPlan().toString()
    reduced = plan[plan.index("Aggregate [song_id") :] if plan.index("Aggregate [song_id") > plan.index("LeftSemi") else plan
    aggregate = next(x for x in reduced.splitlines() if "min(struct" in x)
    assert "text#" not in aggregate.split("min(struct")[1].split("_h")[0]


def test_texts_are_written_back(spark):
    songs = spark.createDataFrame(
        [(1, "/a.mp3", "T", "A", "own"), (2, "/b.mp3", "T", "A", ""), (3, "/c.mp3", None, "A", None), (4, "/d.mp3", "T", "A", None), (5, "/e.mp3", "T", "A", None), (6, "/f.mp3", "T", "A", None)],
        "id long, filepath string, title string, artist string, lyrics_text string",
    )
    key = {r.id: r.cache_key for r in lc.keyed(songs).collect()}
    cache = spark.createDataFrame([(key[2], " kept "), (key[1], "unused"), (key[5], "  ")], "cache_key string, text string")
    rows = [(1, "tag", "no"), (2, "tag", "later"), (3, "online", "net"), (3, "tag", "tagged"), (4, "sidecar_txt", ""), (4, "tag", "hidden"), (5, "sidecar_txt", "beside"), (6, "stored", "x"), (6, "cache", "y")]
    found = lc.song_lyrics(songs, spark.createDataFrame(rows, "id long, source string, text string"), cache)
    assert {(r.id, r.source, r.lyrics_text) for r in found.collect()} == {(1, "stored", "own"), (2, "cache", "kept"), (3, "tag", "tagged"), (5, "sidecar_txt", "beside")}
    texts = {r.id: r.lyrics_text for r in lc.write_back(songs, found).collect()}
    assert texts == {1: "own", 2: "kept", 3: "tagged", 4: None, 5: "beside", 6: None}
    assert {(r.cache_key, r.text) for r in lc.cache_additions(songs, found, cache).collect()} == {(key[3], "tagged")}


def test_lookup_fallback(spark):
    good = "\n".join(["some words of a song"] * 3)
    lrc = "\n".join(["[00:01.00] some words of a song"] * 3)
    rows = [
        (1, "T", "A", "genius", good, None), (1, "T", "A", "lrclib", "bad", lrc), (2, "T", "Ghost", "genius", good, None), (3, "T", "", "ovh", good, None),
        (3, "T", "", "genius_title", good, None), (4, "T", "A", "lrclib", "bad", None), (4, "T", "A", "musixmatch", good + "*******footer", None), (5, "", "A", "genius", good, None),
    ]
    df = spark.createDataFrame(rows, "song_id long, title string, artist string, source string, text string, synced string")
    got = {r.song_id: (r.source, r.lyrics_text) for r in ly.resolve_lookup(df).collect()}
    assert got == {1: ("lrclib", good), 4: ("musixmatch", good)}


# ---------------------------------------------------------------- emotions


def test_emotion_summary(spark):
    rows = [
        (1, 0, 2, "joy", 0.6), (1, 1, 2, "joy", 0.2), (1, 0, 2, "sadness", 0.6), (1, 1, 2, "sadness", 0.2), (1, 0, 2, "boredom", 9.0),
        (2, 0, 1, "fear", 0.5), (2, 0, 1, "anger", 0.2), (3, 0, 1, "boredom", 1.0),
    ]
    df = spark.createDataFrame(rows, "song_id long, chunk_idx int, n_chunks int, label string, score double")
    got = {r.song_id: r for r in em.summarise_emotions(em.average_emotions(df)).collect()}
    assert got[1].lyrics_emotion == "joy" and got[1].lyrics_emotion_score == pytest.approx(0.4)  # label order on a tie
    assert got[1].mood_words == ["happy", "joyful", "sad"] and got[1].lyrics_valence == pytest.approx(0.4 * 0.1)
    assert got[2].mood_words == ["scared", "fearful"]  # a second share of exactly 0.2 adds nothing
    assert got[2].emotion_distribution["fear"] == 0.5 and len(got[2].emotion_distribution) == 7
    assert got[3].lyrics_emotion == "joy" and got[3].lyrics_valence == 0.0


def test_lexicon_and_model_scores_agree(spark):
    chunks = spark.createDataFrame([(1, 0, 1, "happy sad happy xx")], "song_id long, chunk_idx int, n_chunks int, chunk string")
    lexicon = {r.label: r.score for r in em.lexicon_scores(chunks).collect()}
    assert lexicon["joy"] == pytest.approx(2 / 3) and lexicon["fear"] == 0.0

    def load():
        return lambda texts: [{"joy": 2 / 3, "sadness": 1 / 3} for _ in texts]

    model = em.average_emotions(em.model_scores(chunks, load)).first().avg
    assert model == [pytest.approx(x, abs=1e-9) for x in em.average_emotions(em.lexicon_scores(chunks)).first().avg]


def test_json_and_blend(spark):
    assert one(spark, em.decode_distribution(F.col("x")), '{"joy": 0.5}') == {"joy": 0.5}
    assert one(spark, em.decode_distribution(F.col("x")), "{oops") is None
    assert one(spark, em.decode_coefficients(F.col("x")), "[1.5, -2]") == [1.5, -2.0]
    assert one(spark, em.blend_valence(F.lit(0.5), F.lit(-0.5))) == pytest.approx(-0.1)
    assert one(spark, em.blend_valence(F.lit(0.5), F.lit(0.0))) == 0.5


# ---------------------------------------------------------------- sentences and vectors


def sentence(spark, **kw):
    base = dict(
        title="01. Song (Official Audio)", genre="Pop", bpm=122.5, energy=0.3, brightness=3100.0, valence=0.5, mode="major", arousal=0.7,
        key_confidence=0.8, harmonic_ratio=0.9, dynamic_range=3.0,
    )
    base.update(kw)
    words = base.pop("mood_words", None)
    text = base.pop("snippet", "")
    kinds = ", ".join(f"{k} {'string' if k in ('title', 'genre', 'mode') else 'double'}" for k in base)
    df = spark.createDataFrame([(*base.values(), words, text)], kinds + ", mood_words array<string>, snippet string")
    return ds.describe_songs(df).first().rich_description


def test_sentences(spark):
    assert sentence(spark) == (
        "A energetic, upbeat, powerful, lively, dramatic, cinematic, epic, bright, melodic, smooth track at 122 BPM (moderately fast)"
        " in a major key with high intensity and dramatic swells. Pop genre. Song"
    )
    plain = dict(bpm=0.0, energy=0.05, brightness=0.0, valence=0.0, mode="unknown", arousal=0.5, key_confidence=0.7, harmonic_ratio=0.7, dynamic_range=1.0, genre="Unknown", title="")
    assert sentence(spark, **plain) == "A moderate, steady, ambient, uniform track in a minor key with gentle dynamics with steady volume"
    text = "one two three\nfour five six seven"
    got = sentence(spark, **{**plain, "mood_words": ["sad", "steady"], "snippet": text, "key_confidence": None})
    assert got == "A moderate, steady, ambient, uniform, sad track with gentle dynamics with steady volume Lyrics: one two three four five six seven..."


def test_vectors(spark):
    v = one(spark, hashed_words(F.col("x"), 32), "night drive Night")
    assert len(v) == 32 and math.isclose(sum(x * x for x in v), 1.0, abs_tol=1e-5)
    assert one(spark, hashed_words(F.col("x"), 8), "") == [0.0] * 8
    assert one(spark, l2_normalise(F.col("x")), [3.0, 4.0], "array<double>") == pytest.approx([0.6, 0.8], abs=1e-6)
    raw = np.array([1.5, -2.0], "<f4").tobytes()
    assert one(spark, decode_float32(F.col("x")), raw, "binary") == [1.5, -2.0]
    assert one(spark, decode_float32(F.col("x")), raw[:5], "binary") is None


def test_model_vectors_with_prefix(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id long, t string")

    def load():
        return lambda texts: [[len(t)] if len(t) > 7 else None for t in texts]

    got = {r.id: r.v for r in with_model_vectors(df, "t", "v", load, "query: ").collect()}
    assert got == {1: [9.0], 2: None}


def test_chunks_are_computed_once(spark):
    df = spark.createDataFrame([(1, "text " * 10)], "song_id long, lyrics_text string")
    plan = ly.explode_chunks(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "size(transform" not in plan and plan.count("posexplode") == 1


FRAMES = "song_id long, rms double, centroid double, contrast double, zcr double, rolloff double, bandwidth double, harmonic_abs double, signal_abs double, mfcc array<double>"


def _frames(spark):
    loud = [0.1, 0.4, None, float("nan"), 0.2, 0.9, 0.3]
    rows = [(song, loud[(i + (song or 3)) % 7], i * 1.5, 2.0, 0.1, 5.0, None, -1.0 * i, 2.0, [float(i)] * 13) for song in (1, 2, 3, None) for i in range(3 * (song or 2))]
    return spark.createDataFrame([*rows, (4, None, None, None, None, None, None, None, None, None)], FRAMES).repartition(3)


def test_frame_features_of_few_and_many_frames(spark):
    """Songs that are combined on the map side have the same features as those whose frames are dealt as they are."""
    frames = _frames(spark)
    rows = lambda df: sorted((str(r) for r in df.collect()))
    dealt = ft.frame_features(frames)
    assert rows(dealt) == rows(ft.frame_features(frames, few=4)) == rows(ft.frame_features(frames, few=0))
    ranges = {r.song_id: r.dynamic_range for r in ft.dynamic_range(frames).collect()}
    assert {r.song_id: r.dynamic_range for r in dealt.collect()} == {None: None, 4: None, **{k: v for k, v in ranges.items() if k}}


def test_frames_are_dealt_once_as_they_are(spark):
    """Partial sums of songs whose frames lie apart are larger than the frames, so none of them is moved."""
    frames = _frames(spark)
    plan = ft.frame_features(frames)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(song_id") == 1 and "percentile(" not in plan
    whole = ft.song_features(frames, spark.createDataFrame([], "song_id long, pitch int, value double"), spark.createDataFrame([], "song_id long, bpm double"))
    assert "percentile(" not in whole._jdf.queryExecution().executedPlan().toString()


def test_word_vectors_count_slots_without_a_filter_for_each(spark):
    import hashlib
    import re

    texts = ["", "one two two three", "It's A test; a TEST of it's words " * 9, None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", hashed_words(F.col("text")).alias("v"))
    got = {r.id: r.v for r in df.collect()}
    for i, text in enumerate(texts[:3]):
        n = np.zeros(64)
        for w in re.findall("[a-z']+", text.lower()):
            n[int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % 64] += 1
        assert np.allclose(got[i], n / (np.sqrt((n * n).sum()) + 1e-8), atol=1e-6)
    assert "filter(" not in df._jdf.queryExecution().executedPlan().toString()
