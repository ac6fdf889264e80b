"""Text cleaning as narrow column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonelake.functions.numbers import let
from tonelake.rules import BAD_LYRICS, INSTRUMENTAL_ARTISTS, words

# --- Fixed values: the patterns decide what counts as noise -----------------------------------
TRACK_NUMBER = r"^(\d+[\.\)\-\s]+)\s*"
TITLE_TAGS = [
    r"(?i)\s*\(\s*(?:Official\s*)?(?:Audio|Video|Lyrics?|Visual|Visualizer)\s*\)",
    r"(?i)\s*\[\s*(?:Official\s*)?(?:Audio|Video|Lyrics?|Visual|Visualizer)\s*\]",
    r"(?i)\s*\(\s*(?:HD|HQ|High\s*Quality|4K|1080p)\s*\)",
    r"(?i)\s*\[\s*(?:HD|HQ|High\s*Quality|4K|1080p)\s*\]",
    r'(?i)\s*\(\s*(?:From\s+"[^"]+"|From\s+[^)]+)\s*\)',
    r'(?i)\s*\[\s*(?:From\s+"[^"]+"|From\s+[^\]]+)\s*\]',
]
ARTIST_TAGS = [r"(?i)\s*[-–]\s*Topic$", r"(?i)\s*Topic$", r"(?i)\s*VEVO$", r"\s*\(.*?\)\s*$"]
LOOKUP_TAGS = [
    r"(?i)\((?:Official\s*)?(?:Audio|Video|Lyric\s*Video|Visualizer|Music\s*Video|HD|HQ|4K)\)",
    r"(?i)\[(?:Official\s*)?(?:Audio|Video|Lyric\s*Video|Visualizer|Music\s*Video|HD|HQ|4K)\]",
    r"(?i)\b(?:feat\.|ft\.|featuring|cv:|ost).*",
]
LOOKUP_SPLIT = r"[;/&,]"
SECTION_HEADER = (
    r"(?i)^\[(?:Verse|Chorus|Hook|Bridge|Intro|Outro|Pre-Chorus|Refrain|Interlude|Instrumental"
    r"|Solo|Break|Skit|Spoken|Ad[- ]?lib)\s*\d*\]$"
)
TIMESTAMP = r"\[\d{1,2}:\d{2}(?:\.\d{2,3})?\]"
LINE_NOISE = [
    r"(?i)^\[(?:ar|ti|al|by|offset):",
    r"(?i)^\((?:Translation|Romanization|Romaji|English|Japanese)\s*:?\s*\)",
    r"(?i)^(?:Written by|Produced by|Lyrics by|Composed by|Music by)",
]
LRC_METADATA = r"(?i)^\[(ar|ti|al|by|offset):.*\]"
LRC_TIMESTAMP = r"\[\d{2}:\d{2}\.\d{2,3}\]"
# ----------------------------------------------------------------------------------------------

WHITESPACE = " \t\n\r\f\x0b"


def strip(text: Column) -> Column:
    """Trim all ASCII whitespace."""
    return F.btrim(text, F.lit(WHITESPACE))


def _drop(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), patterns, text)


def clean_title(title: Column) -> Column:
    t = _drop(strip(F.coalesce(title, F.lit(""))), [TRACK_NUMBER, *TITLE_TAGS])
    return strip(F.regexp_replace(t, r"\s+", " "))


def clean_artist(artist: Column) -> Column:
    return strip(_drop(F.coalesce(artist, F.lit("")), ARTIST_TAGS))


def clean_lookup(text: Column) -> Column:
    """Title or artist as sent to a lyrics lookup: no media tags, no guests, first name only."""
    t = _drop(F.coalesce(text, F.lit("")), LOOKUP_TAGS)
    return strip(F.get(F.split(t, LOOKUP_SPLIT), F.lit(0)))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def lyric_lines(text: Column) -> Column:
    """Lines worth analysing: no headers, stamps, metadata, credits, nor lines under 5 chars."""
    kept = F.filter(
        F.transform(lines(F.coalesce(text, F.lit(""))), strip),
        lambda x: (x != "") & ~F.rlike(x, F.lit(SECTION_HEADER)),
    )
    bare = F.transform(kept, lambda x: strip(F.regexp_replace(x, TIMESTAMP, "")))
    noise = lambda x: reduce(lambda a, p: a | F.rlike(x, F.lit(p)), LINE_NOISE, F.lit(False))
    return F.filter(bare, lambda x: (F.length(x) >= 5) & ~noise(x))


def clean_lyrics(text: Column) -> Column:
    return F.array_join(lyric_lines(text), "\n")


def strip_lrc(text: Column) -> Column:
    """Plain text of a synced lyrics file."""
    kept = F.filter(lines(text), lambda x: ~F.rlike(x, F.lit(LRC_METADATA)))
    bare = F.transform(kept, lambda x: strip(F.regexp_replace(x, LRC_TIMESTAMP, "")))
    return F.array_join(F.filter(bare, lambda x: x != ""), "\n")


def is_valid_lyrics(text: Column) -> Column:
    """At least 50 chars and 3 filled lines, and no 'not found' phrase at the start."""
    t = F.coalesce(text, F.lit(""))
    filled = F.size(F.filter(lines(t), lambda x: strip(x) != ""))
    bad = let(
        F.substring(F.lower(t), 1, 200),
        lambda start: F.exists(words(BAD_LYRICS), lambda p: F.contains(start, p)),
    )
    return (F.length(t) >= 50) & (filled >= 3) & ~bad


def is_instrumental_artist(artist: Column) -> Column:
    return let(
        F.lower(F.coalesce(artist, F.lit(""))),
        lambda a: F.exists(words(INSTRUMENTAL_ARTISTS), lambda t: F.contains(a, t)),
    )
