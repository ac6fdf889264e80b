"""Signals and ranking against brute force on small catalogs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.plans import ranking as rk
from tonelake.plans import signals as sig
from tonelake.plans.prompt import plan_prompts, prompt_table
from tonelake.rules import default_rulebook

RULES = default_rulebook()
SCHEMA = (
    "id long, artist string, genre string, bpm double, energy double, valence double, arousal double, mode string, "
    "brightness double, dynamic_range double, spectral_rolloff double, spectral_bandwidth double, mfccs array<double>, "
    "has_lyrics boolean, emotion_distribution map<string,double>, embedding array<float>, clap_embedding array<float>"
)


def song(i, embedding=(1.0, 0.0), clap=None, **kw):
    base = dict(
        id=i, artist="A", genre="", bpm=120.0, energy=0.2, valence=0.2, arousal=0.5, mode="major", brightness=2500.0,
        dynamic_range=1.5, spectral_rolloff=4000.0, spectral_bandwidth=2000.0, mfccs=[100.0, -5.0], has_lyrics=True,
        emotion_distribution={"joy": 0.5}, embedding=list(embedding) if embedding else None, clap_embedding=clap,
    )
    return tuple({**base, **kw}.values())


def plans(spark, prompts, vectors, clap=None, limit=None):
    df = plan_prompts(prompt_table(spark, prompts, limit))
    vec = spark.createDataFrame(
        [(i, v, (clap or {}).get(i)) for i, v in enumerate(vectors)], "query_id int, query_vec array<float>, clap_vec array<float>"
    )
    return df.join(vec, "query_id")


def value(spark, expression, **columns):
    row = spark.createDataFrame([song(1, **columns)], SCHEMA)
    return row.select(F.expr(expression).alias("x")).first().x


def match(spark, feature, target, **columns):
    values = np.array([value(spark, sig.feature_value(feature), **columns)])
    return sig.matches(feature, values, np.array([target]))[0, 0]


@pytest.mark.parametrize("feature,columns,target,expected", [
    ("valence", {"valence": 0.05}, -0.55, 0.0111), ("valence", {"valence": -0.50}, -0.55, 0.9692),
    ("valence", {"valence": -0.30}, -0.55, 0.4578), ("arousal", {"arousal": 0.75}, 0.82, 0.8825),
    ("arousal", {"arousal": 0.0}, 0.5, 1.0), ("arousal", {"arousal": None}, 0.5, 1.0),
    ("bpm", {"bpm": 0.0}, 5.0, 0.0), ("bpm", {"bpm": None}, 5.0, 0.0), ("bpm", {"bpm": 135.0}, 120.0, math.exp(-0.5)),
    ("mfcc2", {}, -5.0, 0.0), ("mfcc3", {}, 5.0, 0.0), ("mode_major", {"mode": "unknown"}, 0.0, 1.0),
    ("mode_major", {"mode": None}, 1.0, 0.0), ("energy", {"energy": float("nan")}, 0.2, 0.0),
    ("valence", {"valence": 0.3}, -0.2, math.exp(-0.25 / 0.08) * 0.15), ("arousal", {"arousal": 0.2}, 0.6, math.exp(-0.16 / 0.0392) * 0.2),
])
def test_feature_match(spark, feature, columns, target, expected):
    assert match(spark, feature, target, **columns) == pytest.approx(expected, abs=1e-4)


def expected_scores(songs, prompt_vectors, clap_vectors, plan_rows):
    """Plain loops over pairs, in the order of the definition."""
    out = {}
    names = SCHEMA.replace("<string,double>", "").split(", ")
    names = [n.split(" ")[0] for n in names]
    rows = [dict(zip(names, s)) for s in songs]
    for q, plan in plan_rows.items():
        with_vec = [s for s in rows if s["embedding"]]
        v = np.array(prompt_vectors[q])
        sims = {s["id"]: float(np.dot(s["embedding"], v) / (np.linalg.norm(s["embedding"]) * np.linalg.norm(v))) for s in with_vec}
        lo, hi = min(sims.values()), max(sims.values())
        c = clap_vectors.get(q)
        claps = {s["id"]: float(np.dot(s["clap_embedding"], c)) for s in with_vec if c is not None and s["clap_embedding"]}

        def score_profile(s, profile):
            total = weight = 0.0
            for f, (t, w) in profile.items():
                weight += w
                if f == "mode_major":
                    m = 1.0 if (s["mode"] == "major") == (t == 1.0) else 0.0
                else:
                    if f.startswith("mfcc"):
                        k = int(f[4]) - 1
                        x = s["mfccs"][k] if s["mfccs"] and k < len(s["mfccs"]) else 0.0
                    else:
                        x = s[f] or (0.5 if f == "arousal" else 0.0)
                    sigma = {"bpm": 15, "energy": .06, "brightness": 400, "arousal": .14, "valence": .2, "dynamic_range": .5, "spectral_rolloff": 800, "spectral_bandwidth": 350}.get(f, 8)
                    m = math.exp(-((x - t) ** 2) / (2 * sigma**2))
                    if f == "valence":
                        m *= 0.15 if (t < -.1 and x > .1) or (t > .1 and x < -.1) else 1
                    elif f == "arousal":
                        m *= 0.2 if (t > .5 and x < .3) or (t < .3 and x > .5) else 1
                    elif x <= 0:
                        m = 0.0
                total += m * w
            return total / weight if weight else 0.0

        profile = {f: (p["target"], p["weight"]) for f, p in plan["profile"].items() if p}
        emotions = {e: w for e, w in plan["emotions"].items() if w is not None}
        w = {"s": .22, "c": .30 * plan["emotion_boost"] if claps else 0, "f": .25 * plan["acoustic_boost"] if profile else 0,
             "g": .10 if plan["genres"] else 0, "e": .13 * plan["emotion_boost"] if emotions else 0}
        total_w = sum(w.values())
        for s in with_vec:
            norm = (sims[s["id"]] - lo) / max(hi - lo, .08)
            clap = 0.0
            if s["id"] in claps:
                clap = (claps[s["id"]] - min(claps.values())) / max(max(claps.values()) - min(claps.values()), .08)
            text = [(s["genre"] or "").lower(), (s["artist"] or "").lower()]
            genre = sum(any(k in x for k in RULES.genres[g] for x in text) for g in plan["genres"]) / max(len(plan["genres"]), 1)
            emotion = 0.0
            if emotions and s["has_lyrics"] and s["emotion_distribution"]:
                emotion = max(0.0, 1 - sum(abs(s["emotion_distribution"].get(e, 0) - t) for e, t in emotions.items()) / len(emotions))
            known = [m for m in plan["negated"] if m in RULES.profiles]
            penalty = sum(.2 * score_profile(s, RULES.profiles[m]) for m in known) / len(known) if known else 0.0
            x = (w["s"] * norm + w["c"] * clap + w["f"] * score_profile(s, profile) + w["g"] * genre + w["e"] * emotion) / total_w - penalty
            out[q, s["id"]] = min(100.0, max(0.0, 100 * x))
    return out


def test_scores_equal_plain_loops(spark):
    songs = [
        song(1), song(2, (0.6, 0.8), [1.0, 0.0], valence=-0.7, mode="minor", genre="Trap", arousal=0.0),
        song(3, (0.0, 1.0), [0.0, 1.0], has_lyrics=False, genre=None, artist="Underscore"),
        song(4, (0.8, -0.6), [0.6, 0.8], bpm=None, emotion_distribution=None, mfccs=None, arousal=None),
        song(5, None), song(6, (0.7, 0.7), None, emotion_distribution={}, mode="unknown", energy=0.31, arousal=0.82, bpm=141.0),
    ]
    prompts = ["happy but not energetic", "rap score", "sad angry not happy happy loud", "peaceful breeze"]
    vectors = [[1.0, 0.0], [0.5, 0.5], [0.1, 0.9], [-1.0, 0.2]]
    clap = {0: [1.0, 0.0], 1: [0.0, 1.0], 2: None, 3: [0.6, 0.8]}
    df = plans(spark, prompts, vectors, clap)
    got = {
        (r.query_id, r.song_id): r.score
        for r in rk.score_batch(spark.createDataFrame(songs, SCHEMA), rk.Batch(df), RULES).collect()
    }
    plan_rows = {r.query_id: r.asDict(recursive=True) for r in df.collect()}
    want = expected_scores(songs, vectors, clap, plan_rows)
    assert got.keys() == want.keys() and len(got) == 20
    for k, x in want.items():
        assert got[k] == pytest.approx(x, abs=2e-4), k


def test_ties_limits_and_many_batches(spark):
    songs = spark.createDataFrame([song(i) for i in range(1, 31)], SCHEMA).repartition(3)
    df = plans(spark, ["peaceful breeze"] * 9, [[1.0, 0.0]] * 9, limit=4)
    one = rk.rank_prompts(songs, df).collect()
    assert [(r.song_id, r["rank"]) for r in one if r.query_id == 0] == [(30, 1), (29, 2), (28, 3), (27, 4)]
    assert len(one) == 36
    batched = rk.rank_prompts(songs, df, max_batch=3)
    assert sorted(map(tuple, batched.collect())) == sorted(map(tuple, one))


def test_batch_is_bounded(spark):
    df = plans(spark, ["sad"] * 4, [[1.0, 0.0]] * 4)
    with pytest.raises(ValueError, match="more than 3"):
        rk.Batch(df, 3)


def test_plan_shape(spark):
    songs = spark.createDataFrame([song(i, clap=[1.0, 0.0]) for i in range(8)], SCHEMA)
    ranked = rk.rank_prompts(songs, plans(spark, ["sad"], [[1.0, 0.0]], {0: [1.0, 0.0]}))
    text = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("MapInArrow") == 1
    assert "Sort" not in text[text.index("MapInArrow"):]  # pairs are not sorted: tasks hand on a prompt's limit at most


def test_tasks_hand_on_the_limit_and_change_no_setting(spark):
    rng = np.random.default_rng(6)
    rows = [song(i, tuple(rng.normal(size=2).tolist()), valence=float(rng.uniform(-1, 1)), bpm=float(rng.integers(60, 180))) for i in range(900)]
    songs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = plans(spark, ["sad", "happy but not energetic", "hype workout"], [[1.0, 0.0], [0.2, 1.0], [-1.0, 0.5]], limit=7)
    before = dict(spark.conf.getAll)
    best = rk.best_in_tasks(songs, rk.Batch(df), RULES)
    assert best.groupBy(F.spark_partition_id(), "query_id").count().agg(F.max("count")).first()[0] == 7
    assert dict(spark.conf.getAll) == before
    everything = {}
    for r in rk.score_batch(songs, rk.Batch(df), RULES).collect():
        everything.setdefault(r.query_id, []).append((r.score, r.song_id))
    got = {}
    for r in rk.rank_prompts(songs, df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.song_id))
    assert got == {k: sorted(v, reverse=True)[:7] for k, v in everything.items()}


def test_songs_below_the_ceiling_are_not_scored(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([song(i, tuple(rng.normal(size=2).tolist())) for i in range(500)], SCHEMA)
    scorer = rk.Scorer(rows, rk.Batch(plans(spark, ["xyz"], [[1.0, 0.0]], limit=3)), RULES)
    full = []
    complete = scorer.complete
    scorer.complete = lambda block, at, found: full.append(len(at)) or complete(block, at, found)
    scorer.rows, best, scores = 50, rk.Best(scorer.limits), []
    for block in scorer.blocks(scorer.inputs(rows, RULES).toArrow().to_batches()):
        at, found = scorer.similarities(block)
        scores += complete(block, at, found)["score"][:, 0].tolist()
        assert (scorer.ceiling(found)[:, 0] >= scores[-len(at) :]).all()
        open_ = (scorer.ceiling(found) >= best.least).any(axis=1)
        out = scorer.complete(block, at[open_], {c: v[open_] for c, v in found.items()})
        best.add(0, out["score"][:, 0], rk._song_ids(block)[at[open_]], out["semantic_score"][:, 0])
    assert sum(full) < 400 and sorted(best.rows[0][0]) == sorted(scores)[-3:]


def test_hydrate_drops_missing_songs(spark):
    ranked = spark.createDataFrame([(0, 1, 1), (0, 2, 99)], "query_id int, rank int, song_id long")
    songs = spark.createDataFrame([(1, "x")], "id long, title string")
    assert [r.title for r in rk.hydrate(ranked, songs, ["title"]).collect()] == ["x"]


@pytest.mark.parametrize("limit", [20, 1001])
def test_any_limit_takes_the_same_way(spark, limit):
    songs = spark.createDataFrame([song(i) for i in range(1500)], SCHEMA)
    ranked = rk.rank_prompts(songs, plans(spark, ["sad"], [[1.0, 0.0]], limit=limit))
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, limit + 1))


def test_flawed_vectors(spark):
    nan = float("nan")
    songs = [song(1, (0.1, 1.0), [0.2, 0.1]), song(2, (1.0, 0.0), [nan, 0.0]), song(3, (nan, 1.0), [9.0, 9.0]), song(4, (0.5, 0.5), None), song(5, (0.6, 0.1), [1.0, 0.0])]
    prompt = lambda **kw: plans(spark, ["peaceful breeze"], [[1.0, 0.0]], {0: [1.0, 0.0]}, **kw)
    want = {(r.song_id, r.score) for r in rk.rank_prompts(spark.createDataFrame([s if s[0] != 2 else song(2) for s in songs if s[0] != 3], SCHEMA), prompt()).collect()}
    for parts in (1, 5):
        got = rk.rank_prompts(spark.createDataFrame(songs, SCHEMA).repartition(parts), prompt()).collect()
        assert {(r.song_id, r.score) for r in got} == want and all(0 <= r.score <= 100 for r in got)
    with pytest.raises(Exception, match="length 3"):
        rk.rank_prompts(spark.createDataFrame([*songs, song(6, (1.0, 0.0, 0.0))], SCHEMA), prompt()).collect()


def test_prompts_need_own_ids_and_vectors(spark):
    songs = spark.createDataFrame([song(1)], SCHEMA)
    twice = plans(spark, ["sad"], [[1.0, 0.0]])
    with pytest.raises(ValueError, match="more than once"):
        rk.rank_prompts(songs, twice.unionByName(twice))
    with pytest.raises(ValueError, match="more than once"):
        rk.rank_prompts(songs, twice.unionByName(twice).unionByName(twice), max_batch=2)
    for vector in (None, [float("inf"), 0.0]):
        with pytest.raises(ValueError, match="query_vec"):
            rk.rank_prompts(songs, plans(spark, ["sad", "calm"], [[1.0, 0.0], vector]))


def test_vectors_may_be_computed_on_the_fly(spark):
    from tonelake.functions.vectors import hashed_words

    df = spark.createDataFrame([song(i, artist=a) for i, a in enumerate(["night drive", "sad rain"])], SCHEMA)
    songs = df.withColumn("embedding", hashed_words(F.col("artist")))
    prompts = plan_prompts(prompt_table(spark, ["sad rain"])).withColumn("query_vec", hashed_words(F.col("clean_query")))
    best = rk.rank_prompts(songs, prompts).filter("rank = 1").first()
    assert best.song_id == 1 and best.semantic_score == pytest.approx(100.0)
