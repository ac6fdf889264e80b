"""From frames to song features: means, percentiles, key, valence, arousal."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions.numbers import clip, stable_round
from tonelake.functions.quantiles import FEW, exact_percentiles, interpolated, keys_of_many
from tonelake.functions.vectors import as_input, vector_matrix
from tonelake.rules import KEY_MAJOR, KEY_MINOR, PITCH_NAMES

MFCC_COUNT = 13
EPSILON = 1e-6
KEY_FLOOR = 0.3
KEY_CONFIDENCE = 0.65


def frame_means(frames: DataFrame, columns: list[str], key: str = "song_id") -> DataFrame:
    return frames.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns])


def mfcc_means(frames: DataFrame, column: str = "mfcc", key: str = "song_id") -> DataFrame:
    """Mean of each coefficient, one partial aggregation instead of an explode."""
    means = [F.avg(F.get(column, F.lit(i))) for i in range(MFCC_COUNT)]
    return frames.groupBy(key).agg(
        F.array(*[stable_round(m, 4) for m in means]).alias("mfccs")
    )


def harmonic_ratio(frames: DataFrame, key: str = "song_id") -> DataFrame:
    ratio = F.avg(F.abs("harmonic_abs")) / (F.avg(F.abs("signal_abs")) + F.lit(EPSILON))
    return frames.groupBy(key).agg(ratio.alias("harmonic_ratio"))


def dynamic_range(frames: DataFrame, value: str = "rms", key: str = "song_id") -> DataFrame:
    """Log of the ratio of loud to quiet frames (95th to 5th percentile)."""
    q = exact_percentiles(frames, key, value, {"_p5": 0.05, "_p95": 0.95})
    return q.select(key, _range(F.col("_p5"), F.col("_p95")).alias("dynamic_range"))


def chroma_profile(chroma: DataFrame, key: str = "song_id") -> DataFrame:
    """Mean strength per pitch class, normalised over the twelve."""
    means = chroma.groupBy(key).agg(*[
        F.coalesce(F.avg(F.when(F.col("pitch") == p, F.col("value"))), F.lit(0.0)).alias(f"_m{p}")
        for p in range(12)
    ])
    total = " + ".join(f"_m{p}" for p in range(12))
    means = means.withColumn("_t", F.expr(f"{total} + {EPSILON}D"))
    return means.select(key, F.array(*[F.col(f"_m{p}") / F.col("_t") for p in range(12)]).alias("chroma"))


def _templates() -> np.ndarray:
    """24 rotated key templates, centred and scaled to length 1, in tie order: C major, C minor, ..."""
    turned = np.array([np.roll(base, shift) for shift in range(12) for base in (KEY_MAJOR, KEY_MINOR)])
    centred = turned - turned.mean(axis=1, keepdims=True)
    return centred / np.linalg.norm(centred, axis=1, keepdims=True)


def best_template(chroma: Column) -> Column:
    """Struct (template, corr): the best correlated template of each profile, first of equal ones.

    One matrix product per Arrow batch. Correlations are compared as whole billionths; an even
    profile correlates with nothing and gives NULL.
    """
    templates = _templates()

    @F.arrow_udf("struct<template:int,corr:double>")
    def pick(batch: pa.Array) -> pa.Array:
        rows, good = vector_matrix(batch, 12)
        centred = rows - rows.mean(axis=1, keepdims=True)
        size = np.linalg.norm(centred, axis=1)
        known = size > 1e-12
        steps = np.floor(centred @ templates.T / np.where(known, size, 1.0)[:, None] * 1e9 + 0.5)
        at = steps.argmax(axis=1) if len(rows) else np.zeros(0, int)
        best = np.zeros(len(good), int)
        corr = np.zeros(len(good))
        none = np.ones(len(good), bool)
        best[good], corr[good], none[good] = at, steps[np.arange(len(rows)), at] / 1e9, ~known
        fields = [pa.array(best.astype("int32"), mask=none), pa.array(corr, mask=none)]
        return pa.StructArray.from_arrays(fields, names=["template", "corr"])

    return pick(as_input(chroma))


def detect_key(profiles: DataFrame, key: str = "song_id") -> DataFrame:
    """Key, mode and confidence of each chroma profile; a weak match gives unknown."""
    found = profiles.select(key, best_template(F.col("chroma")).alias("_b"))
    confidence = clip(F.coalesce("_b.corr", F.lit(0.0)), 0.0, 1.0)
    known = confidence >= KEY_FLOOR
    shift = F.floor(F.col("_b.template") / 2).cast("int")
    mode = F.when(F.col("_b.template") % 2 == 0, "major").otherwise("minor")
    return found.select(
        key,
        F.when(known, F.get(F.lit(PITCH_NAMES), shift)).otherwise("unknown").alias("key"),
        F.when(known, mode).otherwise("unknown").alias("mode"),
        confidence.alias("key_confidence"),
    )


def correct_octave(bpm: Column, energy: Column) -> Column:
    """Halve a very fast tempo on a quiet track; double a very slow one."""
    return F.when((bpm > 160) & (energy < 0.18), bpm / 2).when(bpm < 55, bpm * 2).otherwise(bpm)


def estimate_valence(
    bpm: Column, brightness: Column, mode: Column, contrast: Column, zcr: Column, confidence: Column
) -> Column:
    span = F.lit(0.30) * (confidence - F.lit(KEY_CONFIDENCE)) / F.lit(1.0 - KEY_CONFIDENCE)
    weight = F.when(confidence >= KEY_CONFIDENCE, span).otherwise(0.0)
    v = F.when(mode == "major", weight).otherwise(-weight)
    v = v + F.when(bpm > 0, clip((bpm - 100.0) / 100.0 * 0.20, -0.20, 0.20)).otherwise(0.0)
    v = v + F.when(brightness > 0, clip((brightness - 2200.0) / 2000.0 * 0.15, -0.15, 0.15)).otherwise(0.0)
    v = v + clip((contrast - 20.0) / 20.0 * 0.10, -0.10, 0.10)
    v = v - F.when(zcr > 0.15, 0.05).otherwise(0.0)
    return clip(v, -1.0, 1.0)


def estimate_arousal(bpm: Column, energy: Column) -> Column:
    tempo = F.when(bpm > 0, clip((bpm - 80.0) / 160.0, -0.2, 0.5)).otherwise(0.0)
    return clip(tempo + clip((energy - 0.05) / 0.35, 0.0, 1.0) * 0.30, 0.0, 1.0)


# name -> decimals of the stored value
ROUNDING = {
    "bpm": 1, "energy": 4, "brightness": 1, "key_confidence": 2, "valence": 2, "arousal": 2,
    "spectral_contrast": 2, "zero_crossing": 4, "harmonic_ratio": 2, "spectral_rolloff": 1,
    "spectral_bandwidth": 1, "dynamic_range": 2,
}


def _means() -> list[Column]:
    # thresholds decide on these means, so they must not depend on the order of partial sums
    mean = lambda c: stable_round(F.avg(c), 9)
    return [
        mean("rms").alias("energy"), mean("centroid").alias("brightness"),
        mean("contrast").alias("spectral_contrast"), mean("zcr").alias("zero_crossing"),
        mean("rolloff").alias("spectral_rolloff"), mean("bandwidth").alias("spectral_bandwidth"),
        (F.avg(F.abs("harmonic_abs")) / (F.avg(F.abs("signal_abs")) + F.lit(EPSILON))).alias("harmonic_ratio"),
        F.array(*[stable_round(F.avg(F.get("mfcc", F.lit(i))), 4) for i in range(MFCC_COUNT)]).alias("mfccs"),
    ]


def _range(quiet: Column, loud: Column) -> Column:
    return F.log1p(loud / (quiet + F.lit(EPSILON)))


def frame_features(frames: DataFrame, few: int = FEW) -> DataFrame:
    """Means and dynamic range of each song: ``song_id, energy, ... mfccs, dynamic_range``.

    Songs have a few frames each, which may lie far apart, so partial sums would be as many as frames and larger.
    Frames are dealt by song as they are, once, and ordered by loudness there. Songs with more than ``few`` frames
    are combined on the map side.
    """
    v = F.col("rms").cast("double")
    large = keys_of_many(frames, "song_id", few).select(F.col("song_id").alias("_song"))
    same = F.col("song_id").eqNullSafe(F.col("_song"))
    parts = None
    if not large.isEmpty():
        hot = frames.join(large, same, "left_semi")
        parts = hot.groupBy("song_id").agg(*_means()).join(dynamic_range(hot), "song_id", "left")
        frames = frames.join(large, same, "left_anti")
    song = Window.partitionBy("song_id").orderBy(F.col("_v").asc_nulls_last())
    rows = frames.withColumn("_v", F.when(~F.isnan(v), v))
    rows = rows.withColumns({"_at": F.row_number().over(song) - 1, "_n": F.count("_v").over(song.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    place = lambda p: F.lit(p) * (F.col("_n") - 1)
    value = lambda rank: F.max(F.when(F.col("_at") == rank, F.col("_v")))
    ends = {f"_{side}{p}": value(end(place(p / 100))) for p in (5, 95) for side, end in (("low", F.floor), ("high", F.ceil))}
    out = rows.groupBy("song_id").agg(*_means(), F.max("_n").alias("_n"), *[c.alias(n) for n, c in ends.items()])
    at = lambda p: interpolated(place(p / 100), F.col(f"_low{p}"), F.col(f"_high{p}"))
    # frames without a song count for no song
    out = out.withColumn("dynamic_range", F.when(F.col("song_id").isNotNull(), _range(at(5), at(95)))).drop("_n", *ends)
    return out if parts is None else out.unionByName(parts)


def song_features(frames: DataFrame, chroma: DataFrame, tempo: DataFrame) -> DataFrame:
    """All stored features of each song.

    ``frames(song_id, rms, centroid, contrast, zcr, rolloff, bandwidth, harmonic_abs, signal_abs,
    mfcc)``, ``chroma(song_id, pitch, value)``, ``tempo(song_id, bpm)``. Frames are dealt by song once,
    and the joins reuse that.
    """
    keys = detect_key(chroma_profile(chroma))
    df = frame_features(frames).join(keys, "song_id", "left").join(tempo, "song_id", "left")
    df = df.withColumn("bpm", correct_octave(F.coalesce("bpm", F.lit(0.0)), F.col("energy")))
    df = df.withColumn("mode", F.coalesce("mode", F.lit("unknown"))).withColumn(
        "key", F.coalesce("key", F.lit("unknown"))
    ).withColumn("key_confidence", F.coalesce("key_confidence", F.lit(0.0)))
    df = df.withColumn(
        "valence",
        estimate_valence(
            F.col("bpm"), F.col("brightness"), F.col("mode"), F.col("spectral_contrast"),
            F.col("zero_crossing"), F.col("key_confidence"),
        ),
    ).withColumn("arousal", estimate_arousal(F.col("bpm"), F.col("energy")))
    return df.select(
        "song_id", "key", "mode", "mfccs",
        *[stable_round(F.col(c), d).alias(c) for c, d in ROUNDING.items()],
    )
