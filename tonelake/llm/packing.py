"""Packing documents into sequences by cutting-stock column generation.

A document's ids, with an end id, are cut into pieces of the sequence length and one rest. Lengths are
rounded up to classes, by a share of their size at most. A linear program over patterns, i.e. multisets of classes that fit a sequence,
covers the histogram of classes with the fewest sequences; it is solved by the revised simplex method
where a knapsack dynamic program finds the pattern of the best price. Patterns are used a whole number
of times, what is left over is filled first-fit by falling length. Pieces ranked within their class then
take the patterns' places in order.

Only the histogram (one row for each class, fewer than 300) and the patterns reach the driver.
Ranks come from counts of small buckets, so no class is sorted in one task.

Defined results: null and empty texts hold just the end id; a repeated row is packed again; ids may be
null or repeat; an empty table gives an empty table; other columns are not read. Texts of any length
are cut whole, each id lies in exactly one piece.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.llm.common import documents, map_batches, settle, texts
from tonelake.llm.tokens import encoder, tokenizer_path

LENGTH = 2048
#: Up to each length the classes' width; a width is 1/16 of its lengths at most.
WIDTHS = ((64, 1), (128, 4), (256, 8), (LENGTH, 16))
RANK_BUCKETS = 256


def class_sizes(length: int = LENGTH) -> np.ndarray:
    """The classes' sizes in order; the longest is ``length`` (rounded down to the width, then ``length`` itself)."""
    sizes, low = [], 0
    for top, width in (*WIDTHS[:-1], (length, WIDTHS[-1][1])):
        sizes += range(low + width, min(top, length) + 1, width)
        low = top
    return np.array(sizes if sizes[-1] == length else [*sizes, length], np.int64)


def all_patterns(histogram: np.ndarray, length: int, sizes: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Patterns over all classes: short pieces share sequences among themselves, so each program has one unit and few rows."""
    out = []
    for rows in (sizes <= WIDTHS[0][0], sizes > WIDTHS[0][0]):
        if not histogram[rows].any():
            continue
        unit = int(np.gcd.reduce(np.append(sizes[rows], length)))
        for pattern, times in whole_patterns(histogram[rows], length // unit, sizes[rows] // unit):
            full = np.zeros(len(sizes), np.int64)
            full[rows] = pattern
            out.append((full, times))
    return out


def cut(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``length`` ids: ``doc_id, start, length, ids_crc32, doc_tokens`` and, on request, ``ids``."""
    ids = docs.schema[id_col].dataType.simpleString()
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, rows, out, all_ids = encoder(path).encode, [], [[], [], [], []], []
        for row, text in enumerate(texts(batch)):
            data = encode(text) + end
            for at in range(0, len(data), 4 * length):
                piece = data[at : at + 4 * length]
                rows.append(row)
                for column, value in zip(out, (at // 4, len(piece) // 4, zlib.crc32(piece), len(data) // 4)):
                    column.append(value)
                if with_ids:
                    all_ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
        columns = [batch.column("doc_id").take(pa.array(rows, pa.int32())), *(pa.array(c, pa.int64()) for c in out)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            columns, names = [*columns, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(columns, names)

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return map_batches(source, run, f"doc_id {ids}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def best_pattern(prices: np.ndarray, capacity: int, sizes: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """The multiset of classes of the highest price that fits ``capacity``: value, counts per class.

    A class that is no dearer than a smaller one is in no better pattern, so the knapsack leaves it out.
    """
    sizes = np.arange(1, len(prices) + 1) if sizes is None else sizes
    kept = np.flatnonzero(prices > np.maximum.accumulate(np.concatenate([[1e-12], prices[:-1]])))
    value, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    of, gain = sizes[kept], prices[kept]
    fit = np.searchsorted(of, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        if fit[room]:
            gains = gain[: fit[room]] + value[room - of[: fit[room]]]
            k = gains.argmax()
            if gains[k] > value[room] + 1e-12:
                value[room], took[room] = gains[k], k
    counts, room = np.zeros(len(prices), np.int64), capacity
    while room:
        if took[room] < 0:
            room -= 1
        else:
            counts[kept[took[room]]] += 1
            room -= of[took[room]]
    return float(value[capacity]), counts


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A product without BLAS threads, which small matrices in a busy driver only wait for."""
    return np.einsum("ij,jk->ik" if b.ndim == 2 else "ij,j->i", a, b)


def column_generation(histogram: np.ndarray, capacity: int, sizes: np.ndarray, slack: float = 2e-3) -> list[tuple[np.ndarray, float]]:
    """Patterns and their fractional use that cover ``histogram`` (pieces of each class) with the fewest sequences, to within ``slack``."""
    rows = np.flatnonzero(histogram)
    if not len(rows):
        return []
    # A small uneven surplus keeps equal ratios, and with them endless loops, away.
    need = histogram[rows] + np.linspace(1e-3, 2e-3, len(rows)) ** 2
    fits = capacity // sizes[rows]
    patterns = np.zeros((len(rows), len(histogram)))  # row i: the pattern in the basis' place i
    patterns[np.arange(len(rows)), rows] = fits
    inverse, use = np.diag(1.0 / fits), need / fits
    for step in range(60 * len(rows) + 100):
        prices = np.zeros(len(histogram))
        prices[rows] = np.maximum(inverse.sum(axis=0), 0)
        gain, counts = best_pattern(prices, capacity, sizes)
        total = use.sum()
        if gain <= 1 + 1e-7 or total - total / gain < max(0.25, slack * total):
            break  # total / gain is a lower bound of any solution
        direction = _times(inverse, counts[rows].astype(float))
        ratios = np.full(len(rows), np.inf)
        np.divide(use, direction, out=ratios, where=direction > 1e-9)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        use = np.maximum(use - ratios[out] * direction, 0)
        use[out] = ratios[out]
        patterns[out] = counts
        inverse[out] /= direction[out]
        others = np.arange(len(rows)) != out
        inverse[others] -= np.outer(direction[others], inverse[out])
        if step % 200 == 199:  # a Newton step, so rounding errors don't pile up
            inverse = 2 * inverse - _times(_times(inverse, patterns[:, rows].T), inverse)
            use = np.maximum(_times(inverse, need), 0)
    return [(p.astype(np.int64), float(x)) for p, x in zip(patterns, use) if x > 1e-9]


def whole_patterns(histogram: np.ndarray, capacity: int, sizes: np.ndarray | None = None) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, covering ``histogram`` exactly. Classes have sizes 1, 2, 3, ... unless others are given."""
    sizes = np.arange(1, len(histogram) + 1) if sizes is None else sizes
    left, out = histogram.astype(np.int64).copy(), []
    for pattern, x in column_generation(histogram, capacity, sizes):
        times = int(np.floor(x + 1e-6))
        used = pattern > 0
        if used.any():
            times = min(times, int((left[used] // pattern[used]).min()))
        if times > 0 and used.any():
            out.append((pattern, times))
            left -= times * pattern
    while left.any():  # fewer places than the basis has patterns are left, for any number of pieces
        pattern, room = np.zeros_like(left), capacity
        for k in np.flatnonzero(left)[::-1]:
            n = int(min(left[k], room // sizes[k]))
            pattern[k] += n
            room -= n * int(sizes[k])
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((pattern, times))
        left -= times * pattern
    return out


def places(patterns: list[tuple[np.ndarray, int]], n_classes: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each class: first rank, first sequence, places per sequence of each pattern that has it."""
    out: dict[int, list[list[int]]] = {}
    filled, sequence = np.zeros(n_classes, np.int64), 0
    for pattern, times in patterns:
        for k in np.flatnonzero(pattern):
            out.setdefault(int(k) + 1, []).append([int(filled[k]), sequence, int(pattern[k])])
            filled[k] += times * pattern[k]
        sequence += times
    return {k: tuple(np.asarray(v, np.int64).T) for k, v in out.items()}


def pack(pieces: DataFrame, length: int = LENGTH, buckets: int = RANK_BUCKETS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; a piece has a ``length`` from 1 to ``length``.

    ``pieces`` should be a stored table, it is read twice.
    """
    sizes = class_sizes(length)
    n_classes = len(sizes)
    class_of = np.searchsorted(sizes, np.arange(length + 1)) + 1
    hashed = F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int")
    ranked = pieces.withColumn("_class", F.element_at(F.lit(class_of[1:].tolist()), F.col("length").cast("int")).cast("int"))
    over = F.element_at(F.lit(sizes.tolist()), F.col("_class")) - F.col("length")
    ranked = ranked.withColumn("_bucket", (over * buckets + hashed).cast("int"))
    counts = settle(ranked.groupBy("_class", "_bucket").count(), "packing-counts")
    histogram = np.zeros(n_classes, np.int64)
    for row in counts.groupBy("_class").agg(F.sum("count").alias("n")).collect():
        histogram[row["_class"] - 1] = row["n"]
    where = places(all_patterns(histogram, length, sizes), n_classes)
    before = counts.select("_class", "_bucket", (F.sum("count").over(W.partitionBy("_class").orderBy("_bucket")) - F.col("count")).alias("_before"))
    place = W.partitionBy("_class", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = ranked.withColumn("_place", F.row_number().over(place)).join(before, ["_class", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_place") - 1).drop("_bucket", "_before", "_place")

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds, ranks = (batch.column(c).to_numpy() for c in ("_class", "_rank"))
        sequence = np.zeros(len(ranks), np.int64)
        for kind in np.unique(kinds):
            first, base, per = where[int(kind)]
            rows = kinds == kind
            i = np.searchsorted(first, ranks[rows], "right") - 1
            sequence[rows] = base[i] + (ranks[rows] - first[i]) // per[i]
        keep = [c for c in batch.schema.names if c not in ("_class", "_rank")]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence)], [*keep, "sequence_id"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long"
    order = W.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    return map_batches(ranked, assign, schema).withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long"))


def pack_documents(docs: DataFrame, path: str, with_ids: bool = False, **names) -> DataFrame:
    """Cut ``docs`` and pack the pieces; texts are encoded once and never shuffled."""
    return pack(settle(cut(docs, path, with_ids=with_ids, **names), "pieces"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
