"""Rule tables: the words, targets and constants that decide how a prompt is read and scored.

The tables are small and fixed in size, independent of the data, so every use embeds them as a
literal or broadcasts them. A caller may pass a ``Rulebook`` of its own, read from a folder of
text files in the same form.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------------
# They must equal the published behaviour for the results to be right.

NEGATION_WORDS = [
    "not", "no", "without", "but", "except", "don't", "doesn't", "didn't", "won't", "wouldn't",
    "can't", "cannot", "never", "neither", "nor",
]
EMOTION_DOMINANT = [
    "angry", "sad", "happy", "romantic", "love", "heartbreak", "depressing", "melancholy", "moody",
    "bittersweet", "nostalgic",
]
ACOUSTIC_DOMINANT = [
    "epic", "cinematic", "dramatic", "bright", "calm", "chill", "relaxing", "intense", "sleep",
    "study",
]
# label order is also the tie order of the dominant emotion
EMOTION_VALENCE = {
    "joy": 0.8, "surprise": 0.3, "neutral": 0.0, "anger": -0.4, "disgust": -0.5, "fear": -0.3,
    "sadness": -0.7,
}
EMOTION_WORDS = {
    "joy": ["happy", "joyful", "cheerful", "delighted", "ecstatic"],
    "surprise": ["unexpected", "surprising", "shocking"],
    "neutral": ["calm", "steady", "balanced"],
    "anger": ["angry", "furious", "rage", "mad", "intense"],
    "disgust": ["gross", "sick", "repulsed"],
    "fear": ["scared", "fearful", "terrified", "anxious", "dark"],
    "sadness": ["sad", "melancholy", "somber", "grief", "heartbroken", "depressed"],
}
SIGNAL_WEIGHTS = {"semantic": 0.22, "clap": 0.30, "features": 0.25, "genre": 0.10, "emotion": 0.13}
FEATURE_SIGMA = {
    "bpm": 15.0, "energy": 0.06, "brightness": 400.0, "arousal": 0.14, "valence": 0.20,
    "dynamic_range": 0.5, "spectral_rolloff": 800.0, "spectral_bandwidth": 350.0, "mfcc": 8.0,
}
VALENCE_CONTRADICTION = 0.15
AROUSAL_CONTRADICTION = 0.20
RANGE_FLOOR = 0.08
NEGATION_SCALE = 0.20
KEY_MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
KEY_MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
PITCH_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
AUDIO_EXTENSIONS = ["mp3", "flac", "wav", "m4a", "ogg"]
INSTRUMENTAL_ARTISTS = ["ost", "soundtrack", "instrumental", "bgm", "orchestra"]
BAD_LYRICS = [
    "lyrics not available", "we don't have the lyrics", "no lyrics found", "instrumental",
]
# ----------------------------------------------------------------------------------------------

_HERE = Path(__file__).parent / "rulebook"


def _entries(path: Path) -> dict[str, list[str]]:
    rows = [r for r in path.read_text(encoding="utf-8").splitlines() if r and not r.startswith("#")]
    return {key: rest.split(", ") for key, rest in (r.split(": ", 1) for r in rows)}


@dataclass(frozen=True)
class Rulebook:
    synonyms: dict[str, list[str]]
    genres: dict[str, list[str]]
    profiles: dict[str, dict[str, tuple[float, float]]]
    emotion_targets: dict[str, dict[str, float]]

    @classmethod
    def read(cls, folder: str | Path = _HERE) -> "Rulebook":
        folder = Path(folder)
        number = {"true": 1.0, "false": 0.0}
        profiles = {}
        for mood, cells in _entries(folder / "profiles.txt").items():
            split = (c.split(" ") for c in cells)
            profiles[mood] = {f: (number.get(t) if t in number else float(t), float(w)) for f, t, w in split}
        targets = {
            mood: {e: float(w) for e, w in (c.split(" ") for c in cells)}
            for mood, cells in _entries(folder / "emotion_targets.txt").items()
        }
        return cls(
            _entries(folder / "synonyms.txt"), _entries(folder / "genres.txt"), profiles, targets
        )

    @property
    def features(self) -> list[str]:
        """Feature names in order of first use."""
        return list(dict.fromkeys(f for p in self.profiles.values() for f in p))

    @property
    def emotions(self) -> list[str]:
        return list(EMOTION_VALENCE)

    def rows(self, table: str) -> tuple[list[tuple], str]:
        """Rows and schema of one rule table, with the ordinals that decide ties."""
        if table == "synonyms":
            return [
                (t, i, k, j)
                for i, (t, ks) in enumerate(self.synonyms.items())
                for j, k in enumerate(ks)
            ], "term string, term_ord int, keyword string, kw_ord int"
        if table == "genre_keywords":
            return [
                (g, i, k, j)
                for i, (g, ks) in enumerate(self.genres.items())
                for j, k in enumerate(ks)
            ], "genre string, genre_ord int, keyword string, kw_ord int"
        if table == "profiles":
            return [
                (m, f, t, w) for m, p in self.profiles.items() for f, (t, w) in p.items()
            ], "mood string, feature string, target double, weight double"
        if table == "emotion_targets":
            return [
                (m, e, w) for m, p in self.emotion_targets.items() for e, w in p.items()
            ], "mood string, emotion string, share double"
        if table == "negation_words":
            return [(w,) for w in NEGATION_WORDS], "word string"
        if table == "emotion_valence":
            return [
                (e, i, v) for i, (e, v) in enumerate(EMOTION_VALENCE.items())
            ], "emotion string, emotion_ord int, valence double"
        if table == "emotion_words":
            return [
                (e, j, w) for e, ws in EMOTION_WORDS.items() for j, w in enumerate(ws)
            ], "emotion string, word_ord int, word string"
        if table == "key_profiles":
            return [
                (shift, mode, m, pitch, base[(pitch - shift) % 12])
                for shift in range(12)
                for m, (mode, base) in enumerate((("major", KEY_MAJOR), ("minor", KEY_MINOR)))
                for pitch in range(12)
            ], "shift int, mode string, mode_ord int, pitch int, weight double"
        if table == "dominant":
            return [(k, "emotion") for k in EMOTION_DOMINANT] + [
                (k, "acoustic") for k in ACOUSTIC_DOMINANT
            ], "keyword string, kind string"
        if table == "instrumental_artists":
            return [(w,) for w in INSTRUMENTAL_ARTISTS], "token string"
        if table == "bad_lyrics":
            return [(w,) for w in BAD_LYRICS], "token string"
        if table == "signal_weights":
            return list(SIGNAL_WEIGHTS.items()), "signal string, weight double"
        raise KeyError(table)

    def frame(self, spark: SparkSession, table: str) -> DataFrame:
        rows, schema = self.rows(table)
        return spark.createDataFrame(rows, schema)


RULE_TABLES = [
    "synonyms", "genre_keywords", "profiles", "emotion_targets", "negation_words",
    "emotion_valence", "emotion_words", "key_profiles", "dominant", "instrumental_artists",
    "bad_lyrics", "signal_weights",
]


@lru_cache(maxsize=1)
def default_rulebook() -> Rulebook:
    return Rulebook.read()


def literal(value, schema: str) -> Column:
    """A nested constant as a column; Catalyst folds it into one literal."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def words(values) -> Column:
    return F.lit(list(values))
