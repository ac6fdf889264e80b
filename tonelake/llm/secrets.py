"""Secret scans: fixed formats, and windows of high entropy inside long strings.

A candidate is a run of 20 or more of the characters that keys are made of. For each character class
a window slides over the candidate's runs of that class; its Shannon entropy follows from counts that
change by one character in and one out. Windows at or above the class's bound join to one span.
An allow-list suppresses what is known to be harmless. Spans of the fixed formats always stay.

Defined results: null is the empty text, which has no spans; a repeated row is scanned again and
gives the same spans; an empty table gives an empty table; other columns of the input are not read.
Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm.common import documents, map_batches, texts

KINDS = ["assign", "access", "hex", "entropy"]
_KEY = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")


@dataclass(frozen=True)
class CharClass:
    """``chars``: inside of a bracket expression; ``window`` characters with ``bits`` of entropy are suspect."""

    chars: str
    window: int
    bits: float

    @property
    def pattern(self) -> re.Pattern:
        return re.compile(f"[{self.chars}]{{{self.window},}}")


CLASSES = (CharClass("0-9a-fA-F", 20, 3.0), CharClass("A-Za-z0-9+/_-", 20, 3.7))
#: Strings that look random and are not secret.
ALLOWED = (
    r"[^0-9]*", r"[^A-Za-z]*", r".*(example|sample|dummy|placeholder|changeme).*", r"(.)\1*",
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"(https?:|www\.|/?(usr|home|var|etc)/).*",
    r"([A-Za-z]+[-_./=+])*[A-Za-z]+[-_./=+]?[0-9]{1,4}", r"([0-9]+[-_./:T])+[0-9]+Z?",
)


def entropy_windows(run: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Joined windows of ``run`` with at least ``bits`` of Shannon entropy, as start and end."""
    if len(run) < window:
        return []
    weight = [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, bound = 0.0, window * (math.log2(window) - bits) + 1e-9
    spans: list[tuple[int, int]] = []
    for end, char in enumerate(run, 1):
        start = end - window
        if start > 0:
            gone = run[start - 1]
            n = counts[gone]
            counts[gone] = n - 1
            total += weight[n - 1] - weight[n]
        n = counts.get(char, 0)
        counts[char] = n + 1
        total += weight[n + 1] - weight[n]
        if start >= 0 and total <= bound:
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((start, end))
    return spans


class SecretScanner:
    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED):
        self.classes = [(c.pattern, c.window, c.bits) for c in classes]
        self.allowed = re.compile("|".join(f"(?:{a})" for a in allowed), re.IGNORECASE | re.ASCII)

    @staticmethod
    def candidates(text: str) -> list[tuple[int, str]]:
        """Start and string of the runs that can hold a key; short words are passed over without a pattern."""
        out, at = [], 0
        for word in text.split():
            if len(word) >= 20:
                at = text.find(word, at)
                out += [(at + m.start(), m.group()) for m in _TOKEN.finditer(word)]
                at += len(word)
        return out

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end), sorted."""
        found = set()
        lower = text.lower()
        if any(name in lower for name in _NAMES):
            found |= {(m.start(), 0, m.end()) for m in _KEY.finditer(text) if len(m.group(2)) >= 6}
        for at, run in self.candidates(text):
            found |= {(at + m.start(), 1, at + m.end()) for m in _ACCESS.finditer(run) if len(m.group()) >= 20}
            found |= {(at + m.start(), 2, at + m.end()) for m in _HEX.finditer(run) if len(m.group()) >= 24}
            if self.allowed.fullmatch(run):
                continue
            spans: list[tuple[int, int]] = []
            for pattern, window, bits in self.classes:
                for m in pattern.finditer(run):
                    spans += [(m.start() + a, m.start() + b) for a, b in entropy_windows(m.group(), window, bits) if not self.allowed.fullmatch(run, m.start() + a, m.start() + b)]
            found |= {(at + a, 3, at + b) for a, b in joined(spans)}
        return sorted(found)


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """One row per input row: ``doc_id`` and ``secrets``, an array of (kind, start, end) by start.

    Offsets count code points, the end is exclusive. One pass over the texts, no shuffle.
    """
    ids = docs.schema[id_col].dataType.simpleString()
    scanner = SecretScanner(classes, allowed)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scanner.scan(t)] for t in texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "secrets"])

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return map_batches(source, scan, f"doc_id {ids}, secrets array<struct<kind string, start int, end int>>")


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with every secret's value replaced by ``mask``; all rows and columns stay."""
    scanner, at = SecretScanner(), docs.columns.index(text_col)

    def redact(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column(at).to_pylist():
            for a, b in reversed(joined([(a, b) for a, _, b in scanner.scan(text)]) if text else []):
                text = text[:a] + mask + text[b:]
            out.append(text)
        columns = batch.columns
        columns[at] = pa.array(out, pa.string())
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_batches(docs, redact, docs.schema)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))
    base = F.filter("secrets", lambda s: s.kind != "entropy")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"))
