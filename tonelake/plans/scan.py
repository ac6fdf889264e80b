"""The scan: from files and what was read from them to full catalog rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions.keys import key_bits, rows_of_keys
from tonelake.functions.text import strip
from tonelake.functions.vectors import hashed_words
from tonelake.operators.describe import describe_songs
from tonelake.operators.emotion import blend_valence, lexicon_scores
from tonelake.operators.features import song_features
from tonelake.operators.library import default_tags
from tonelake.operators.lyrics import with_snippet
from tonelake.operators.maintenance import fresh_rows
from tonelake.session import settle
from tonelake.sources.catalog import conform
from tonelake.streaming.ingest import analyse_lyrics

TAGS = ["title", "artist", "album", "genre"]
EMOTIONS = {
    "lyrics_text": "string", "lyrics_emotion": "string", "lyrics_emotion_score": "double", "lyrics_valence": "double",
    "mood_words": "array<string>", "emotion_distribution": "map<string,double>",
}


def scan_songs(
    files: DataFrame, frames: DataFrame, chroma: DataFrame, tempo: DataFrame, tags: DataFrame | None = None,
    lyrics: DataFrame | None = None, score: Callable[[DataFrame], DataFrame] | None = None,
    vectorise: Callable[[Column], Column] = hashed_words, audio_vectors: DataFrame | None = None,
) -> DataFrame:
    """Catalog rows of ``files`` (filepath, file_mtime, song_id), as ``process`` of a sync or a stream.

    The other tables hold what was read from the files, by ``song_id``: signal tables as
    :func:`song_features` takes them, tags, resolved lyrics (lyrics_text) and audio vectors
    (clap_embedding). Only rows of these songs are worked on, and few others are dealt. A song without frames, tags, lyrics or audio
    vector gets the defaults of ingest; a lyrics valence blends into the song's own; the sentence sees all
    that, and its vector is the text vector.
    """
    wanted = settle(files.select("song_id").distinct(), "wanted-songs")
    table = key_bits(wanted, "song_id")
    of = lambda df: rows_of_keys(df, wanted, "song_id", table)
    rows = files.select("filepath", "file_mtime", "song_id")
    if tags is not None:
        rows = rows.join(of(tags).select("song_id", *TAGS), "song_id", "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in TAGS})
    rows = default_tags(rows).join(song_features(of(frames), of(chroma), of(tempo)), "song_id", "left")
    if lyrics is not None:
        found = of(lyrics).filter(strip(F.col("lyrics_text")) != "").select("song_id", "lyrics_text")
        scorer = score or (lambda chunks: lexicon_scores(chunks, key="song_id"))
        rows = rows.join(analyse_lyrics(found, scorer, "song_id").select("song_id", *EMOTIONS), "song_id", "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in EMOTIONS.items()})
    rows = rows.withColumn("has_lyrics", F.col("lyrics_text").isNotNull())
    rows = rows.withColumn("valence", blend_valence(F.col("valence"), F.col("lyrics_valence")))
    rows = describe_songs(with_snippet(rows))
    rows = rows.withColumn("embedding", vectorise(F.col("rich_description")))
    if audio_vectors is not None:
        rows = rows.join(of(audio_vectors).select("song_id", "clap_embedding"), "song_id", "left")
    return conform(fresh_rows(rows))
