"""The five signals of (song, prompt) pairs, in blocks.

What depends on the song alone is a row of numbers, made in the JVM. Prompts repeat each other: a
batch sets few distinct targets, so every distinct (feature, target) pair is numbered once and matched
once per song. A signal of all pairs of a block is then one product of that table with a matrix of
weights.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions.numbers import let
from tonelake.rules import (
    AROUSAL_CONTRADICTION,
    FEATURE_SIGMA,
    NEGATION_SCALE,
    RANGE_FLOOR,
    VALENCE_CONTRADICTION,
    Rulebook,
    literal,
)

SCALARS = [
    "bpm", "energy", "valence", "arousal", "mode", "brightness", "dynamic_range",
    "spectral_rolloff", "spectral_bandwidth", "mfccs",
]


def feature_value(feature: str) -> str:
    """The song's value of a feature, as a number: missing is 0, for arousal 0.5 (as is a true 0)."""
    if feature == "mode_major":
        return "CASE WHEN mode = 'major' THEN 1D ELSE 0D END"
    if feature == "arousal":
        return "coalesce(nullif(nanvl(cast(arousal AS double), 0D), 0D), 0.5D)"
    if feature.startswith("mfcc") and len(feature) == 5:
        return f"coalesce(nanvl(cast(get(mfccs, {int(feature[4]) - 1}) AS double), 0D), 0D)"
    if feature in FEATURE_SIGMA and feature != "mfcc":
        return f"coalesce(nanvl(cast({feature} AS double), 0D), 0D)"
    return "0D"


def song_inputs(rules: Rulebook) -> list[Column]:
    """Per song: f_<feature> numbers and e_<emotion> shares; shares are NULL without usable lyrics."""
    usable = "coalesce(has_lyrics, false) AND coalesce(size(emotion_distribution), 0) > 0"
    shares = [
        f"CASE WHEN {usable} THEN coalesce(try_element_at(emotion_distribution, '{e}'), 0D) END AS e_{e}"
        for e in rules.emotions
    ]
    values = [f"{feature_value(f)} AS f_{f}" for f in rules.features]
    return [F.expr(x) for x in values + shares]


def song_genres(rules: Rulebook, genre: str = "genre", artist: str = "artist") -> Column:
    """Numbers of the rule genres with a keyword inside the song's genre or artist text."""
    table = literal(
        [{"number": k, "words": w} for k, w in enumerate(rules.genres.values())],
        "array<struct<number:int,words:array<string>>>",
    )
    lowered = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    named = let(
        F.struct(lowered(genre).alias("g"), lowered(artist).alias("a")),
        lambda s: F.filter(
            table,
            lambda r: F.exists(r["words"], lambda w: F.contains(s["g"], w) | F.contains(s["a"], w)),
        ),
    )
    return F.transform(named, lambda r: r["number"])


def matches(feature: str, values: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """How well each value meets each target, 0 to 1: values x targets."""
    v, t = values[:, None], targets[None, :]
    if feature == "mode_major":
        return (v == t).astype(float)
    sigma = FEATURE_SIGMA.get("mfcc" if feature.startswith("mfcc") else feature)
    if sigma is None:
        return np.zeros((len(values), len(targets)))
    curve = np.exp(-(v - t) * (v - t) / (2 * sigma * sigma))
    if feature == "valence":
        return np.where(((t < -0.1) & (v > 0.1)) | ((t > 0.1) & (v < -0.1)), curve * VALENCE_CONTRADICTION, curve)
    if feature == "arousal":
        return np.where(((t > 0.5) & (v < 0.3)) | ((t < 0.3) & (v > 0.5)), curve * AROUSAL_CONTRADICTION, curve)
    return np.where(v > 0, curve, 0.0)


class Targets:
    """Distinct (name, target) pairs, numbered as they come; pairs of a name lie together in the end."""

    def __init__(self, pairs: Iterable[tuple[str, float]]):
        by_name: dict[str, dict[float, None]] = {}
        for name, target in pairs:
            by_name.setdefault(name, {})[target] = None
        self.by_name = {name: np.array(list(ts)) for name, ts in by_name.items()}
        self.number = {pair: k for k, pair in enumerate((name, float(t)) for name, ts in self.by_name.items() for t in ts)}

    def __len__(self) -> int:
        return len(self.number)

    def weights(self, rows: list[dict[str, tuple[float, float]]]) -> np.ndarray:
        """Targets x rows, from each row's name -> (target, weight)."""
        out = np.zeros((len(self), len(rows)))
        for k, row in enumerate(rows):
            for name, (target, weight) in row.items():
                out[self.number[name, float(target)], k] = weight
        return out

    def table(self, columns: dict[str, np.ndarray], match) -> np.ndarray:
        """Songs x targets by ``match(name, values, targets)``."""
        n = len(next(iter(columns.values())))
        return np.hstack([match(name, columns[name], ts) for name, ts in self.by_name.items()] or [np.zeros((n, 0))])


def shares(total: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Columns divided by their weight, 0 where there is none."""
    whole = weights.sum(axis=0)
    return np.divide(total, whole, out=np.zeros_like(total), where=whole > 0)


class SongSignals:
    """The signals of a batch's plans that do not come from vectors, for blocks of songs."""

    def __init__(self, plans: list[dict], rules: Rulebook):
        set_ = lambda struct: {k: v for k, v in (struct or {}).items() if v is not None}
        profiles = [{f: (p["target"], p["weight"]) for f, p in set_(plan["profile"]).items()} for plan in plans]
        emotions = [set_(plan["emotions"]) for plan in plans]
        negated = [[w for w in plan["negated"] or [] if w in rules.profiles] for plan in plans]
        self.moods = list(dict.fromkeys(w for ws in negated for w in ws))
        moods = [rules.profiles[m] for m in self.moods]
        self.features = Targets((f, t) for row in [*profiles, *moods] for f, (t, _) in row.items())
        self.profile_weights, self.mood_weights = self.features.weights(profiles), self.features.weights(moods)
        self.mood_shares = np.zeros((len(self.moods), len(plans)))
        for k, ws in enumerate(negated):
            for w in ws:
                self.mood_shares[self.moods.index(w), k] += NEGATION_SCALE / len(ws)
        self.emotions = Targets(pair for row in emotions for pair in row.items())
        self.emotion_weights = self.emotions.weights([{e: (t, 1.0) for e, t in row.items()} for row in emotions])
        self.genres = np.zeros((len(rules.genres), len(plans)))
        at = {g: k for k, g in enumerate(rules.genres)}
        for k, plan in enumerate(plans):
            for g in plan["genres"] or []:
                self.genres[at[g], k] = 1.0

    def of(self, values: dict[str, np.ndarray], emotions: dict[str, np.ndarray], genres: np.ndarray) -> dict[str, np.ndarray]:
        """Songs x prompts of each signal. ``genres``: songs x rule genres of 0 and 1."""
        match = self.features.table(values, matches)
        away = self.emotions.table(emotions, lambda _, v, t: np.abs(v[:, None] - t[None, :]))
        distance = shares(away @ self.emotion_weights, self.emotion_weights)
        near = np.maximum(0.0, 1.0 - distance)
        wanted = self.emotion_weights.any(axis=0) if len(self.emotions) else np.zeros(self.emotion_weights.shape[1], bool)
        return {
            "features": shares(match @ self.profile_weights, self.profile_weights),
            "genre": shares(genres @ self.genres, self.genres),
            "emotion": np.where(wanted & ~np.isnan(near), near, 0.0),
            "penalty": shares(match @ self.mood_weights, self.mood_weights) @ self.mood_shares,
        }


def min_max(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Position between the lowest and highest value, with a floor on the range; missing -> 0."""
    return np.nan_to_num((values - low) / np.maximum(high - low, RANGE_FLOOR), nan=0.0)


def mood_matches(songs: DataFrame, features: list[str], rules: Rulebook) -> DataFrame:
    """``song_id, mood, feature, match``: every song against every mood that sets one of the features."""
    wanted = [(m, f, t) for m, profile in rules.profiles.items() for f, (t, _) in profile.items() if f in features]
    targets = Targets((f, t) for _, f, t in wanted)
    numbers = np.array([targets.number[f, float(t)] for _, f, t in wanted], np.int64)
    moods, names = pa.array([m for m, _, _ in wanted], pa.string()), pa.array([f for _, f, _ in wanted], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                block = batch.slice(at, 1024)
                n = block.num_rows
                table = targets.table({f: block.column(f"f_{f}").to_numpy() for f in targets.by_name}, matches)
                row = pa.array(np.tile(np.arange(len(wanted)), n))
                columns = [block.column("song_id").take(pa.array(np.repeat(np.arange(n), len(wanted)))), moods.take(row), names.take(row), pa.array(table[:, numbers].ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["song_id", "mood", "feature", "match"])

    inputs = songs.select(F.col("id").alias("song_id"), *[F.expr(f"{feature_value(f)} AS f_{f}") for f in targets.by_name])
    return inputs.mapInArrow(run, f"song_id {inputs.schema['song_id'].dataType.simpleString()}, mood string, feature string, match double")
