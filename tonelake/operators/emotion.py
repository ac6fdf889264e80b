"""Emotion shares of lyrics: scoring chunks, averaging, and what follows from the average."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions.numbers import stable_round
from tonelake.rules import EMOTION_VALENCE, EMOTION_WORDS, literal, words

LABELS = list(EMOTION_VALENCE)
SECOND_EMOTION = 0.2


def lexicon_scores(chunks: DataFrame, lexicon: dict[str, list[str]] | None = None, key: str = "song_id") -> DataFrame:
    """(key, chunk_idx, n_chunks, label, score) from word counts; a stand-in that needs no model."""
    lexicon = lexicon or EMOTION_WORDS
    labels_of: dict[str, list[int]] = {}
    for i, label_words in enumerate(lexicon.values()):
        for w in label_words:
            labels_of.setdefault(w, []).append(i)
    table = literal(labels_of, "map<string,array<int>>")
    tokens = F.regexp_extract_all(F.lower("chunk"), F.lit("[a-z']+"), F.lit(0))
    # one lookup per token; the counts then run over the few tokens that carry a label
    found = F.filter(F.transform(tokens, lambda t: F.try_element_at(table, t)), lambda x: x.isNotNull())
    df = chunks.select(key, "chunk_idx", "n_chunks", F.flatten(found).alias("_l"))

    def count(i: int) -> Column:
        return F.size(F.filter("_l", lambda x: x == i))

    df = df.select(key, "chunk_idx", "n_chunks", F.array(*[count(i) for i in range(len(lexicon))]).alias("_n"))
    total = F.aggregate("_n", F.lit(0), lambda a, x: a + x)
    df = df.withColumn("_all", total)
    rows = [
        F.struct(F.lit(label).alias("label"), F.coalesce(F.try_divide(F.get("_n", F.lit(i)), F.col("_all")), F.lit(0.0)).alias("score"))
        for i, label in enumerate(lexicon)
    ]
    return df.select(key, "chunk_idx", "n_chunks", F.inline(F.array(*rows)))


def model_scores(
    chunks: DataFrame, load: Callable[[], Callable[[list[str]], list[dict[str, float]]]], key: str = "song_id"
) -> DataFrame:
    """Scores from a user's classifier, loaded once per Python worker task.

    The classifier maps a list of chunks to one {label: score} each. Labels it does not know of
    are left out downstream.
    """
    key_type = chunks.schema[key].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify = None
        for pdf in batches:
            classify = classify or load()
            marked = pdf[[key, "chunk_idx", "n_chunks"]].assign(scores=classify(list(pdf["chunk"])))
            marked["items"] = [list(s.items()) for s in marked.pop("scores")]
            rows = marked.explode("items").dropna(subset=["items"])
            rows["label"] = [i[0] for i in rows["items"]]
            rows["score"] = [float(i[1]) for i in rows["items"]]
            yield rows.drop(columns="items")

    return chunks.select(key, "chunk_idx", "n_chunks", "chunk").mapInPandas(
        score, f"`{key}` {key_type}, chunk_idx int, n_chunks int, label string, score double"
    )


def average_emotions(scores: DataFrame, key: str = "song_id") -> DataFrame:
    """(key, avg): mean score per label over the song's chunks, in label order.

    One aggregation by song with a conditional sum per label; other labels are ignored. Divided by
    the number of chunks, not of rows.
    """
    sums = [F.sum(F.when(F.col("label") == e, F.col("score")).otherwise(0.0)) for e in LABELS]
    return scores.groupBy(key).agg(
        F.array(*[F.round(s / F.max("n_chunks"), 9) for s in sums]).alias("avg")
    )


def _by_strength(avg: Column) -> Column:
    """Labels from strongest to weakest; label order decides a tie."""
    labels = words(LABELS)
    items = F.transform(
        avg, lambda x, i: F.struct((-x).alias("neg"), i.alias("ord"), F.get(labels, i).alias("label"))
    )
    return F.array_sort(items)


def emotion_valence(avg: Column) -> Column:
    terms = F.zip_with(avg, F.lit(list(EMOTION_VALENCE.values())), lambda a, v: a * v)
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def mood_words(top: Column, second: Column, second_score: Column) -> Column:
    """Two words of the strongest emotion, one of the next if it is above 0.2."""
    table = literal(EMOTION_WORDS, "map<string,array<string>>")
    extra = F.when(second_score > SECOND_EMOTION, F.slice(F.try_element_at(table, second), 1, 1)).otherwise(
        F.array().cast("array<string>")
    )
    return F.concat(F.slice(F.try_element_at(table, top), 1, 2), extra)


def summarise_emotions(averages: DataFrame, key: str = "song_id") -> DataFrame:
    """Dominant emotion, its score, valence, mood words and the rounded distribution."""
    df = averages.withColumn("_o", _by_strength(F.col("avg")))
    first, second = F.get("_o", F.lit(0)), F.get("_o", F.lit(1))
    return df.select(
        key,
        first["label"].alias("lyrics_emotion"), (-first["neg"]).alias("lyrics_emotion_score"),
        second["label"].alias("second_emotion"), (-second["neg"]).alias("second_score"),
        stable_round(emotion_valence(F.col("avg")), 9).alias("lyrics_valence"),
        mood_words(first["label"], second["label"], -second["neg"]).alias("mood_words"),
        F.map_from_arrays(words(LABELS), F.transform("avg", lambda x: F.round(x, 4))).alias("emotion_distribution"),
    )


def blend_valence(audio: Column, lyrics: Column) -> Column:
    """Lyrics weigh more; without a lyrics valence the audio one stays."""
    return F.when(
        F.coalesce(lyrics, F.lit(0.0)) != 0,
        F.coalesce(audio, F.lit(0.0)) * 0.4 + lyrics * 0.6,
    ).otherwise(audio)


def decode_distribution(text: Column) -> Column:
    """JSON object of label shares; malformed text counts as absent."""
    return F.from_json(text, "map<string,double>")


def decode_coefficients(text: Column) -> Column:
    return F.from_json(text, "array<double>")
