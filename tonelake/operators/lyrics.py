"""Lyrics: choosing a source, the chorus snippet, chunks for a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions.numbers import let
from tonelake.functions.text import (
    clean_lookup,
    clean_lyrics,
    is_instrumental_artist,
    is_valid_lyrics,
    lyric_lines,
    strip,
    strip_lrc,
)

MAX_SNIPPET = 600
MAX_CHUNK = 2500
MIN_CHUNK = 30
SOURCE_PRIORITY = {"stored": 0, "sidecar_lrc": 1, "sidecar_txt": 2, "cache": 3, "tag": 4, "online": 5}
LOOKUP_PRIORITY = {"lrclib": 0, "genius": 1, "ovh": 2, "musixmatch": 3, "genius_title": 4}


def with_snippet(songs: DataFrame, text: str = "lyrics_text", out: str = "snippet") -> DataFrame:
    """Add the chorus: repeated lines nearest the middle, else the middle lines.

    One narrow pass per row. Sorting (line, position) puts equal lines side by side, so one fold
    finds the repeated ones with their mean position. Distance from the middle is compared as
    |2 * sum of positions - count * lines| / count: whole numbers, so ties are real ties.
    """
    df = songs.withColumn("_clean", F.when(F.length(strip(F.col(text))) >= 20, lyric_lines(F.col(text))))
    df = df.withColumn("_m", F.filter("_clean", lambda x: F.length(x) > 8))
    df = df.withColumn(
        "_s", F.array_sort(F.transform("_m", lambda x, i: F.struct(x.alias("line"), i.alias("pos"))))
    )
    n = F.size("_m").cast("long")
    run_type = "array<struct<key:double,first:int,line:string>>"
    start = F.struct(
        F.lit("").alias("line"), F.lit(0).cast("long").alias("cnt"), F.lit(0).cast("long").alias("sum"),
        F.lit(0).alias("first"), F.array().cast(run_type).alias("runs"),
    )

    def closed(a: Column) -> Column:
        key = F.abs(a["sum"] * 2 - a["cnt"] * n).cast("double") / a["cnt"]
        run = F.struct(key.alias("key"), a["first"].alias("first"), a["line"].alias("line"))
        return F.when(a["cnt"] > 1, F.concat(a["runs"], F.array(run))).otherwise(a["runs"])

    def step(a: Column, x: Column) -> Column:
        same = (a["cnt"] > 0) & (a["line"] == x["line"])
        more = F.struct(
            a["line"].alias("line"), (a["cnt"] + 1).alias("cnt"), (a["sum"] + x["pos"]).alias("sum"),
            a["first"].alias("first"), a["runs"].alias("runs"),
        )
        new = F.struct(
            x["line"].alias("line"), F.lit(1).cast("long").alias("cnt"), x["pos"].cast("long").alias("sum"),
            x["pos"].alias("first"), closed(a).alias("runs"),
        )
        return F.when(same, more).otherwise(new)

    df = df.withColumn("_r", F.aggregate("_s", start, step, closed))
    top = F.transform(F.slice(F.array_sort("_r"), 1, 5), lambda r: r["line"])
    middle = F.floor(F.size("_m") / 2).cast("int")
    fallback = F.slice("_m", F.greatest(middle - 1, F.lit(1)), F.least(middle + 3, F.size("_m")) - F.greatest(middle - 2, F.lit(0)))
    picked = F.when(F.size("_r") > 0, top).otherwise(fallback)
    joined = F.substring(F.array_join(picked, " "), 1, MAX_SNIPPET)
    usable = F.length(F.array_join("_clean", "\n")) >= 20
    keep = [c for c in songs.columns if c != out]
    return df.select(*keep, F.when(usable, joined).otherwise("").alias(out))


def chunk_text(text: Column) -> Column:
    """Pack paragraphs, and lines of oversized paragraphs, into chunks of at most 2500 chars.

    A fold over the pieces with (finished chunks, open chunk) as its state.
    """
    piece = "array<struct<s:string,sep:string,cost:int,flush:boolean>>"

    def pieces(p: Column) -> Column:
        split = F.transform(
            F.split(p, "\n"),
            lambda x, i: F.struct(x.alias("s"), F.lit("\n").alias("sep"), F.lit(1).alias("cost"), (i == 0).alias("flush")),
        )
        whole = F.array(
            F.struct(p.alias("s"), F.lit("\n\n").alias("sep"), F.lit(2).alias("cost"), F.lit(False).alias("flush"))
        )
        return F.when(F.length(p) > MAX_CHUNK, split).otherwise(whole).cast(piece)

    add = lambda chunks, c: F.when(c == "", chunks).otherwise(F.concat(chunks, F.array(strip(c))))

    def step(a: Column, x: Column) -> Column:
        chunks = F.when(x["flush"], add(a["chunks"], a["open"])).otherwise(a["chunks"])
        opened = F.when(x["flush"], F.lit("")).otherwise(a["open"])
        fits = F.length(opened) + F.length(x["s"]) + x["cost"] <= MAX_CHUNK
        grown = F.when(opened == "", x["s"]).otherwise(F.concat(opened, x["sep"], x["s"]))
        return F.when(
            fits, F.struct(chunks.alias("chunks"), grown.alias("open"))
        ).otherwise(F.struct(add(chunks, opened).alias("chunks"), x["s"].alias("open")))

    def pack(body: Column) -> Column:
        items = F.flatten(F.transform(F.split(body, "\n\n"), pieces))
        start = F.struct(F.array().cast("array<string>").alias("chunks"), F.lit("").alias("open"))
        packed = F.aggregate(items, start, step, lambda a: add(a["chunks"], strip(a["open"])))
        cut = F.array(F.substring(body, 1, MAX_CHUNK))
        return let(
            F.filter(packed, lambda c: F.length(c) >= MIN_CHUNK),
            lambda kept: F.when(F.size(kept) > 0, kept).otherwise(cut),
        )

    return let(
        strip(F.coalesce(text, F.lit(""))),
        lambda body: F.when(F.length(body) <= MAX_CHUNK, F.array(body)).otherwise(pack(body)),
    )


def explode_chunks(songs: DataFrame, text: str = "lyrics_text", key: str = "song_id") -> DataFrame:
    """(key, chunk_idx, n_chunks, chunk). Texts under 10 chars have no chunk."""
    usable = songs.filter(F.length(strip(F.col(text))) >= 10)
    rows = usable.select(key, chunk_text(F.col(text)).alias("_c"))
    # outer, though there is always a chunk: a plain posexplode makes the optimizer compute the
    # chunks once more as a filter
    return rows.select(
        key, F.size("_c").alias("n_chunks"), F.posexplode_outer("_c").alias("chunk_idx", "chunk")
    )


def analysis_text(text: Column) -> Column:
    """What the emotion step reads: the cleaned lyrics, or the raw ones if nothing is left."""
    return let(clean_lyrics(text), lambda c: F.when(c == "", text).otherwise(c))


def priority_of(source: Column, order: dict[str, int]) -> Column:
    """A source's place, NULL for an unknown one."""
    place = F.lit(None).cast("int")
    for name, at in order.items():
        place = F.when(source == name, at).otherwise(place)
    return place


PLACE = ["_p", "_o", "_h"]


def with_place(candidates: DataFrame, order: dict[str, int], ordinal: str | None, *texts: str) -> DataFrame:
    """Add a candidate's place within its key: its source's, its ordinal, a hash of its texts (unless it has one)."""
    place = {"_p": priority_of(F.col("source"), order), "_o": F.col(ordinal) if ordinal else F.lit(0)}
    if "_h" not in candidates.columns:
        place["_h"] = F.xxhash64(*texts)
    return candidates.withColumns(place)


def first_of_key(placed: DataFrame, usable: Column, key: str) -> DataFrame:
    """The rows of ``placed`` with the least place among the usable ones of their key.

    Places alone are reduced, on the map side first. Texts move only in the join that fetches the winners,
    dealt by key and place, so a key with many candidates is no single task's; equal rows lie together there.
    """
    rows = placed.filter(F.col("_p").isNotNull() & usable)
    least = rows.groupBy(key).agg(F.min(F.struct(*PLACE)).alias("_least")).select(key, *[f"_least.{c}" for c in PLACE])
    return rows.join(least, [key, *PLACE], "left_semi").dropDuplicates([key, *PLACE])


def resolve_sources(candidates: DataFrame, key: str = "song_id", ordinal: str | None = None) -> DataFrame:
    """First filled source by priority, from rows (key, source, text).

    Of several rows of a source the least ``ordinal`` counts, then the least hash of the text. A sidecar
    file that exists settles the matter even when it is empty.
    """
    source, text = F.col("source"), F.col("text")
    filled = F.when(source == "cache", strip(text)).otherwise(text) != ""
    usable = source.startswith("sidecar") | F.coalesce(filled, F.lit(False))
    picked = first_of_key(with_place(candidates, SOURCE_PRIORITY, ordinal, "text"), usable, key)
    found = F.when(source == "cache", strip(text)).when(source == "sidecar_lrc", clean_lyrics(text)).otherwise(text)
    return picked.select(key, "source", F.nullif(found, F.lit("")).alias("lyrics_text"))


def lookup_text(source: Column, text: Column, synced: Column) -> Column:
    """Text of one lookup result, by the habits of its source."""
    plain = F.when(F.length(text) > 20, strip(text)).otherwise(strip_lrc(synced))
    cut = strip(F.get(F.split(text, r"\*{7}"), F.lit(0)))
    return F.when(source == "lrclib", plain).when(source == "musixmatch", cut).otherwise(strip(text))


def resolve_lookup(candidates: DataFrame, key: str = "song_id", ordinal: str | None = None) -> DataFrame:
    """First good result by source order, from rows (key, title, artist, source, text, synced).

    Instrumental artists get none; sources that need an artist are skipped without one. Of several
    rows of a source the least ``ordinal`` counts, then the least hash of the texts.
    """
    artist = F.coalesce("artist", F.lit(""))
    needs_artist = F.col("source").isin("ovh", "genius_title")
    asked = candidates.filter(
        (F.coalesce("title", F.lit("")) != "")
        & ~is_instrumental_artist(F.col("artist"))
        & (~needs_artist | (clean_lookup(artist) != ""))
    ).select(key, "source", "text", "synced", *([ordinal] if ordinal else []))
    found = lookup_text(F.col("source"), F.col("text"), F.col("synced"))
    picked = first_of_key(with_place(asked, LOOKUP_PRIORITY, ordinal, "text", "synced"), is_valid_lyrics(found), key)
    return picked.select(key, "source", found.alias("lyrics_text"))
