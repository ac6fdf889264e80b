"""Exact duplicates by composable polynomial fingerprints, with a chunkwise comparison.

A text is read with each run of white space as one space. Its fingerprint is its UTF-8 as a polynomial
over four primes, with its length. Fingerprints compose: that of two parts in a row is the first's times
the base to the second's length, plus the second's; a space that both parts share at their border is
taken out. So a text longer than a chunk is cut into chunks of bytes, which are dealt to tasks, hashed
side by side and combined; a short text is one chunk and stays where it is.

Rows of equal fingerprints are then compared chunk by chunk: the texts are read again, those whose
fingerprint stands alone are left out by a bit table of bounded size, and the chunks of the others stream
through an aggregation whose key holds the chunk's bytes. So a chunk is set byte for byte against those in
the same place of the others, copies meet in the task that reads them, and no task holds whole groups.
Where a place has several contents, the fingerprint was shared by chance, and its rows are told apart by
their contents.

Defined results: null is the empty text; texts of white space only are one space and equal each other,
the empty text is none of them; of repeated rows one stays; rows without id are compared too, and one of
them stays only if no equal text has an id; an empty table gives an empty table; other columns are not
read unless carried, and a carried column may have any name that is not one of the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm.common import documents, settle

#: The largest primes below 2**31: a byte times a power, summed over a chunk, stays below 2**63.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
CHUNK = 1 << 16
#: Rows of an Arrow batch that are worked on at once, and bytes of them.
ROWS, BYTES = 256, 1 << 22
_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def bases(primes: tuple[int, ...] = PRIMES) -> list[int]:
    rng = np.random.default_rng(11)
    return [int(rng.integers(p // 2, p - 1)) if p > 1000 else 2 + k for k, p in enumerate(primes)]


def single_spaces(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of parts in a row with each run of white space inside a part as one space, and the parts' new starts."""
    space = _SPACE[data]
    again = np.zeros(len(data), bool)
    again[1:] = space[1:] & space[:-1]
    inner = starts[starts < len(data)]
    again[inner] = False
    kept = np.concatenate([[0], np.cumsum(~again)])
    return np.where(space, np.uint8(0x20), data)[~again], kept[starts]


class Polynomial:
    """Fingerprints of parts, and the fingerprint of two parts in a row."""

    def __init__(self, primes: tuple[int, ...] = PRIMES, chunk: int = CHUNK):
        self.primes, self.bases = primes, bases(primes)
        self.powers = []
        for p, b in zip(primes, self.bases):
            table = np.ones(1, np.int64)
            while len(table) < chunk:
                table = np.concatenate([table, table * pow(b, len(table), p) % p])
            self.powers.append(table[:chunk])

    def of_parts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row per part (``starts`` has one more, the end): the value modulo each prime. No part is longer than a chunk."""
        out = np.zeros((len(starts) - 1, len(self.primes)), np.int64)
        full = np.flatnonzero(starts[1:] > starts[:-1])
        if not len(full):
            return out
        exponent = np.repeat(starts[1:], np.diff(starts)) - 1 - np.arange(len(data))
        for k, (p, powers) in enumerate(zip(self.primes, self.powers)):
            out[full, k] = np.add.reduceat(data * powers[exponent], starts[full]) % p
        return out

    def combine(self, parts: list[tuple]) -> tuple[list[int], int]:
        """The value and length of parts in a row, each (values, length, begins with a space, ends with one)."""
        total, length, open_ = [0] * len(self.primes), 0, False
        for values, n, begins, ends in parts:
            if not n:
                continue
            shared = open_ and begins
            n -= shared
            for k, (p, b) in enumerate(zip(self.primes, self.bases)):
                value = values[k] - (0x20 * pow(b, n, p) if shared else 0)
                total[k] = (total[k] * pow(b, n, p) + value) % p
            length, open_ = length + n, ends
        return total, length


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches of bounded rows and bytes, but at least one row."""
    for batch in batches:
        ends = np.cumsum([len(v.as_buffer()) for v in batch.column(column)], dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            n = max(1, min(ROWS, int(np.searchsorted(ends, before + BYTES, "right")) - at))
            yield batch.slice(at, n)
            at += n


def flat(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of values in a row, and the values' starts with the end."""
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum([0] + [len(v) for v in values], dtype=np.int64)


def _packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four values below 2**31 as two longs."""
    return values[:, 0] | values[:, 1] << 31, values[:, 2] | values[:, 3] << 31


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _hashed(parts: DataFrame, primes: tuple[int, ...], chunk: int) -> DataFrame:
    """``parts`` with the summary of ``_part`` in its place: ``_a, _b, _n, _begins, _ends``."""
    others = [c for c in parts.columns if c != "_part"]
    made = ["_a", "_b", "_n", "_begins", "_ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        polynomial = Polynomial(primes, chunk)
        for batch in slices(batches, "_part"):
            data, starts = single_spaces(*flat(batch.column("_part").to_pylist()))
            a, b = _packed(polynomial.of_parts(data, starts))
            n, space = np.diff(starts), np.concatenate([data, [0]]) == 0x20
            columns = [a, b, n, (n > 0) & space[starts[:-1]], (n > 0) & space[starts[1:] - 1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *map(pa.array, columns)], others + made)

    return parts.mapInArrow(run, f"{_fields(parts, others)}, _a long, _b long, _n long, _begins boolean, _ends boolean")


def _combined(chunked: DataFrame, primes: tuple[int, ...]) -> DataFrame:
    """One row per text, with ``_a, _b, _n`` of its summaries ``_chunks`` in order."""
    others = [c for c in chunked.columns if c != "_chunks"]
    low = (1 << 31) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        polynomial = Polynomial(primes, 1)
        for batch in batches:
            rows = []
            for chunks in batch.column("_chunks").to_pylist():
                rows.append(polynomial.combine([((c["_a"] & low, c["_a"] >> 31, c["_b"] & low, c["_b"] >> 31), c["_n"], c["_begins"], c["_ends"]) for c in chunks]))
            a, b = _packed(np.array([v for v, _ in rows], np.int64).reshape(-1, 4))
            columns = [a, b, np.array([n for _, n in rows], np.int64)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *map(pa.array, columns)], others + ["_a", "_b", "_n"])

    return chunked.mapInArrow(run, f"{_fields(chunked, others)}, _a long, _b long, _n long")


def _source(docs: DataFrame, id_col: str, text_col: str, carry: dict[str, Column]) -> DataFrame:
    return docs.select(docs[id_col].alias("doc_id"), *[c.alias(n) for n, c in carry.items()], F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("_part"))


def fingerprints(source: DataFrame, primes: tuple[int, ...] = PRIMES, chunk: int = CHUNK) -> DataFrame:
    """``source`` with the fingerprint ``_a, _b, _n`` of ``_part`` in its place. Texts longer than a chunk are dealt out."""
    size = F.octet_length("_part")
    short = _hashed(source.filter(size <= chunk), primes, chunk).drop("_begins", "_ends")
    names = [c for c in source.columns if c != "_part"]
    cut = F.transform(F.sequence(F.lit(0), size - 1, F.lit(chunk)), lambda at: F.substring("_part", at + 1, F.lit(chunk)))
    long = source.filter(size > chunk).withColumn("_text", F.monotonically_increasing_id())
    parts = long.select("_text", F.struct(*names).alias("_of"), F.posexplode(cut).alias("_at", "_part"))
    tasks = 4 * source.sparkSession.sparkContext.defaultParallelism
    dealt = parts.withColumn("_of", F.when(F.col("_at") == 0, F.col("_of"))).repartition(tasks, "_text", "_at")
    # A text has 2 GB at most, so a list has 32,768 summaries at most with chunks of the usual size.
    summary = F.struct("_at", "_a", "_b", "_n", "_begins", "_ends")
    texts = _hashed(dealt, primes, chunk).groupBy("_text").agg(F.max("_of").alias("_of"), F.sort_array(F.collect_list(summary)).alias("_chunks"))
    return short.unionByName(_combined(texts.select("_of.*", "_chunks"), primes))


def bit_table(prints: DataFrame) -> bytes:
    """Which low bits of fingerprints occur; 16 bits a fingerprint, but 16 MiB at most, where more texts are read than need be."""
    bits = min(27, max(15, (16 * prints.count()).bit_length()))
    spot = F.col("_a").bitwiseAND((1 << bits) - 1)
    rows = prints.groupBy(F.shiftright(spot, 15).alias("page")).agg(F.bitmap_construct_agg(spot.bitwiseAND(32767)).alias("page_bits")).collect()
    table = bytearray(1 << bits - 3)
    for page, page_bits in rows:
        table[page * 4096 : page * 4096 + 4096] = page_bits
    return bytes(table)


def texts_with(source: DataFrame, table: bytes, primes: tuple[int, ...], chunk: int) -> DataFrame:
    """Rows of ``source`` whose fingerprint is in the table: with ``_a, _b, _n`` and ``_parts``, the chunks of the normalised text."""
    others = [c for c in source.columns if c != "_part"]
    shared = source.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        polynomial, spots = Polynomial(primes, chunk), np.frombuffer(shared.value, np.uint8)
        mask = len(spots) * 8 - 1
        for batch in slices(batches, "_part"):
            data, starts = single_spaces(*flat(batch.column("_part").to_pylist()))
            cuts = [np.append(np.arange(s, e, chunk), e) if e > s else np.array([s, s]) for s, e in zip(starts[:-1], starts[1:])]
            first = np.cumsum([0] + [len(c) - 1 for c in cuts])
            values = polynomial.of_parts(data, np.concatenate([*(c[:-1] for c in cuts), starts[-1:]]))
            whole = []
            for k, c in enumerate(cuts):
                rows = [(values[first[k] + i].tolist(), int(c[i + 1] - c[i]), False, False) for i in range(len(c) - 1)]
                whole.append(polynomial.combine(rows)[0] if len(rows) > 1 else rows[0][0])
            a, b = _packed(np.array(whole, np.int64))
            spot = a & mask
            hit = np.flatnonzero(spots[spot >> 3] >> (spot & 7).astype(np.uint8) & 1)
            if len(hit):
                parts = [[data[x:y].tobytes() for x, y in zip(cuts[k][:-1], cuts[k][1:])] for k in hit]
                taken = batch.take(pa.array(hit))
                columns = [pa.array(a[hit]), pa.array(b[hit]), pa.array(np.diff(starts)[hit]), pa.array(parts, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in others), *columns], others + ["_a", "_b", "_n", "_parts"])

    return source.mapInArrow(run, f"{_fields(source, others)}, _a long, _b long, _n long, _parts array<binary>")


PRINT = ["_a", "_b", "_n"]


def told_apart(source: DataFrame, mixed: DataFrame, primes: tuple[int, ...], chunk: int) -> DataFrame:
    """The rows with fingerprints that several texts share, with ``_class``: for each chunk the least row with the same content."""
    rows = texts_with(source, bit_table(mixed), primes, chunk).join(mixed, PRINT, "left_semi")
    rows = settle(rows.withColumn("_row", F.monotonically_increasing_id()), "shared-prints")
    chunks = rows.select(*PRINT, "_row", F.posexplode("_parts").alias("_at", "_part"))
    least = chunks.groupBy(*PRINT, "_at", "_part").agg(F.min("_row").alias("_least"))
    classes = chunks.join(least, [*PRINT, "_at", "_part"]).groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_at", "_least"))).alias("_class"))
    return rows.drop("_parts").join(classes, "_row").drop("_row").withColumn("_class", F.to_json("_class"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None, primes: tuple[int, ...] = PRIMES, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept`` and the carried columns."""
    carry = carry or {}
    source = _source(docs, id_col, text_col, carry)
    rows = settle(fingerprints(source, primes, chunk).withColumn("_row", F.monotonically_increasing_id()), "fingerprints")
    shared = settle(rows.groupBy(*PRINT).agg(F.count("*").alias("_rows")).filter("_rows > 1").select(*PRINT), "shared")
    again = texts_with(_source(docs, id_col, text_col, {}), bit_table(shared), primes, chunk)
    contents = again.select(*PRINT, F.posexplode("_parts").alias("_at", "_part")).groupBy(*PRINT, "_at", "_part").agg(F.lit(1).alias("_one"))
    mixed = settle(contents.groupBy(*PRINT, "_at").agg(F.count("*").alias("_contents")).filter("_contents > 1").select(*PRINT).distinct(), "mixed")
    rows = rows.withColumn("_class", F.lit(""))
    if not mixed.isEmpty():
        apart = told_apart(source, mixed, primes, chunk).withColumn("_row", F.monotonically_increasing_id())
        rows = settle(rows.join(mixed, PRINT, "left_anti").unionByName(apart), "told-apart")
        shared = rows.select(*PRINT).distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    groups = rows.groupBy(*PRINT, "_class").agg(F.count("*").alias("_rows"), F.min(order).alias("_keep")).filter("_rows > 1")
    joined = rows.join(settle(groups, "groups"), [*PRINT, "_class"], "left")
    single = F.col("_rows").isNull()
    return joined.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("_keep.id")).alias("keep_id"),
        F.coalesce("_rows", F.lit(1)).alias("group_size"),
        (single | (F.col("_row") == F.col("_keep.row"))).alias("kept"),
        *carry,
    )


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    normal = F.regexp_replace(F.coalesce(docs["text"], F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return exact_groups(docs, carry={"text_sha256": F.sha2(normal, 256)})


ORACLE_SQL = r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
h AS (SELECT doc_id, sha256(t) AS text_sha256, t FROM t)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY t)"""
