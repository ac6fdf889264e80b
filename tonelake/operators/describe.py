"""Text about a song: a label from music theory and the mood sentence that is vectorised."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonelake.functions.text import clean_title, strip
from tonelake.operators.features import KEY_CONFIDENCE

MAX_WORDS = 10

# The words and thresholds of labels and sentences below are what users know, in their order.


def theory_label(
    bpm: Column, energy: Column, brightness: Column, mode: Column, valence: Column, arousal: Column
) -> Column:
    tempo = (
        F.when(bpm < 70, "Very Slow (Largo)").when(bpm < 100, "Slow (Adagio)")
        .when(bpm < 120, "Moderate Tempo").when(bpm < 160, "Fast (Allegro)")
        .otherwise("Very Fast (Presto)")
    )
    mood = (
        F.when(valence > 0.3, "Happy/Uplifting").when(valence > 0.1, "Positive/Bright")
        .when(valence < -0.3, "Sad/Melancholic").when(valence < -0.1, "Somber/Reflective")
    )
    return F.concat_ws(
        ", ",
        tempo,
        F.when(energy < 0.05, "Quiet").when(energy > 0.12, "Intense"),
        F.when(mode == "major", "Major Key").otherwise("Minor Key"),
        mood,
        F.when(arousal > 0.7, "High Energy").when(arousal < 0.3, "Calm/Relaxed"),
        F.when(brightness < 1500, "Dark Timbre").when(brightness > 3000, "Bright Timbre"),
    )


def _words(*cases: tuple[Column, list[str]]) -> Column:
    """Words of the first case that holds, else none."""
    out = F.array().cast("array<string>")
    for test, values in reversed(cases):
        out = F.when(test, F.lit(values)).otherwise(out)
    return out


def mood_list(
    bpm: Column, brightness: Column, valence: Column, mode: Column, arousal: Column,
    key_confidence: Column, harmonic_ratio: Column, dynamic_range: Column, lyric_words: Column,
) -> Column:
    """At most ten distinct mood words, in order of mention."""
    lively, quiet = arousal > 0.55, arousal < 0.45
    glad, gloomy = valence > 0.1, valence < -0.1
    quadrant = _words(
        (lively & glad, ["energetic", "upbeat", "powerful", "lively"]),
        (lively & gloomy, ["intense", "dark", "aggressive", "fierce"]),
        (quiet & glad, ["calm", "peaceful", "gentle", "serene"]),
        (quiet & gloomy, ["sad", "melancholic", "somber", "mournful"]),
        (lively, ["driving", "energetic"]),
        (quiet, ["relaxed", "mellow"]),
        (glad, ["positive", "cheerful"]),
        (gloomy, ["reflective", "contemplative"]),
        (F.lit(True), ["moderate", "steady"]),
    )
    sure = key_confidence >= KEY_CONFIDENCE
    parts = F.concat(
        quadrant,
        _words((dynamic_range > 2.8, ["dramatic", "cinematic", "epic"]),
               (dynamic_range < 1.2, ["ambient", "steady", "uniform"])),
        F.coalesce(lyric_words, F.array().cast("array<string>")),
        _words((sure & (mode == "major"), ["bright"]), (sure & (mode == "minor"), ["dark"])),
        _words((harmonic_ratio > 0.85, ["melodic", "smooth"]),
               (harmonic_ratio < 0.55, ["percussive", "rhythmic"])),
        _words((bpm >= 125, ["fast"]), ((bpm > 0) & (bpm <= 85), ["slow"])),
        _words((brightness >= 3000, ["sharp"]), ((brightness > 0) & (brightness <= 1500), ["deep"])),
    )
    return F.slice(F.array_distinct(parts), 1, MAX_WORDS)


def mood_sentence(
    title: Column, genre: Column, bpm: Column, energy: Column, brightness: Column, valence: Column,
    mode: Column, arousal: Column, key_confidence: Column, harmonic_ratio: Column,
    dynamic_range: Column, lyric_words: Column, snippet: Column,
) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    bpm, energy, brightness = zero(bpm), zero(energy), zero(brightness)
    valence, arousal, dynamic_range = zero(valence), zero(arousal), zero(dynamic_range)
    key_confidence = F.coalesce(key_confidence, F.lit(0.5))
    harmonic_ratio, mode = zero(harmonic_ratio), F.coalesce(mode, F.lit(""))
    moods = mood_list(
        bpm, brightness, valence, mode, arousal, key_confidence, harmonic_ratio, dynamic_range, lyric_words
    )
    tempo = (
        F.when(bpm >= 160, "very fast").when(bpm >= 120, "moderately fast")
        .when(bpm >= 90, "moderate tempo").when(bpm >= 70, "slow").otherwise("very slow")
    )
    name = clean_title(title)
    genre = F.coalesce(genre, F.lit(""))
    part = lambda test, text: F.when(test, text).otherwise("")
    said = F.substring(strip(F.replace(snippet, F.lit("\n"), F.lit(" "))), 1, 300)
    return F.concat(
        F.lit("A "), F.array_join(moods, ", "), F.lit(" track"),
        part(bpm > 0, F.format_string(" at %.0f BPM (%s)", F.bround(bpm, 0), tempo)),
        part(
            (key_confidence >= KEY_CONFIDENCE) & (mode != ""),
            F.when(mode == "major", " in a major key").otherwise(" in a minor key"),
        ),
        F.when(energy > 0.25, " with high intensity").when(energy < 0.10, " with gentle dynamics").otherwise(""),
        F.when(dynamic_range > 2.8, " and dramatic swells").when(dynamic_range < 1.2, " with steady volume").otherwise(""),
        part(~F.lower(genre).isin("", "unknown"), F.concat(F.lit(". "), genre, F.lit(" genre"))),
        part(name != "", F.concat(F.lit(". "), name)),
        part(F.length(F.coalesce(snippet, F.lit(""))) > 20, F.concat(F.lit(" Lyrics: "), F.coalesce(said, F.lit("")), F.lit("..."))),
    )


def describe_songs(songs, snippet: str = "snippet"):
    """``rich_description`` from a catalog's own columns."""
    c = F.col
    words = c("mood_words") if "mood_words" in songs.columns else F.lit(None).cast("array<string>")
    text = c(snippet) if snippet in songs.columns else F.lit("")
    sentence = mood_sentence(
        c("title"), c("genre"), c("bpm"), c("energy"), c("brightness"), c("valence"), c("mode"),
        c("arousal"), c("key_confidence"), c("harmonic_ratio"), c("dynamic_range"), words, text,
    )
    return songs.withColumn("rich_description", sentence)
