"""Alignment of two tokenizers' ids by the byte offsets at which tokens of both end.

Per text the ends of both token lists are running sums of byte lengths, kept as dictionaries from end to
index. The keys they share, sorted, cut both lists into groups that cover the same bytes, and a group's
links are the pairs of its tokens that end where it ends. The slices of many texts are laid out together.

Linked tokens end together, so the bytes of the shorter are the end of the longer's. A token has no more
ends than bytes, so the distinct linked pairs are at most the bytes of both vocabularies (about a
million), whatever the corpus. Their counts are summed on Spark and may therefore travel to every task.

Defined results: null and empty texts, and texts whose bytes either tokenizer changes, have no tokens and
zeros, with '' for the groups; each repeated row has its row and counts anew; ids may be null; an empty
table gives an empty table; other columns are not read. Texts are encoded whole, special strings as text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm.common import documents, settle
from tonelake.llm.tokens import byte_bpe, byte_tokens, tokenizer_path

#: Rows of an Arrow batch that are worked on at once.
ROWS = 128


class Pair:
    """Both encoders with their ids' bytes and decimal forms. A is a byte-level file, B a piece model."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = byte_bpe(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        bytes_a, self.bytes_b = byte_tokens(path_a), piece_bytes(self.b)
        self.length_a = np.array([len(t) for t in bytes_a], np.int64)
        self.length_b = np.array([len(t) for t in self.bytes_b], np.int64)
        self.n_a, self.n_b = len(bytes_a), len(self.bytes_b)
        # Decimal ids with what may follow: in A a comma or the bar, in B a comma or the next group.
        ends = [(self.n_a, ","), (self.n_a, "|"), (self.n_b, ","), (self.n_b, ";")]
        self.names = np.array([f"{i}{sign}" for n, sign in ends for i in range(n)], object)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B of each text; none where a tokenizer does not give the text's bytes."""
        none = np.zeros(0, np.int64)
        of_piece = self.bytes_b.__getitem__
        for text in texts:
            ids_b = self.b.encode(text, num_threads=1) if text else []
            if not text or b"".join(map(of_piece, ids_b)) != b" " + text.encode():
                yield none, none
            else:  # a byte-level encoder keeps all bytes
                yield np.asarray(self.a.encode_ordinary(" " + text), np.int64), np.asarray(ids_b, np.int64)


def piece_bytes(model) -> list[bytes]:
    """The bytes of each piece: U+2581 is a space, <0xHH> a byte."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return out


@lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    """One pair of encoders for each worker process."""
    return Pair(path_a, path_b)


def common_ends(ends_a: list[int], ends_b: list[int], first_a: int = 0, first_b: int = 0) -> tuple[list[int], list[int], list[int]]:
    """The sorted ends that both lists have, and the index of the last token with each end in either, counted from the first ones."""
    at_a, at_b = dict(zip(ends_a, range(first_a, first_a + len(ends_a)))), dict(zip(ends_b, range(first_b, first_b + len(ends_b))))
    keys = sorted(at_a.keys() & at_b.keys())
    return keys, [at_a[k] for k in keys], [at_b[k] for k in keys]


def laid_out(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Both id lists cut after the given indexes: each A slice and then its B slice, as places in :attr:`Pair.names`."""
    of_a, of_b = a.copy(), b + 2 * n_a
    of_a[last_a] += n_a
    of_b[last_b] += n_b
    before_a = np.repeat(np.concatenate([[0], last_b[:-1] + 1]), np.diff(last_a, prepend=-1))
    before_b = np.repeat(last_a + 1, np.diff(last_b, prepend=-1))
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + before_a] = of_a
    out[np.arange(len(b)) + before_b] = of_b
    return out


def links(ends_a: list[int], ends_b: list[int], keys: list[int], last_a: list[int], last_b: list[int]) -> tuple[list[int], list[int]]:
    """Indexes of the token pairs of each group that end at the group's end; more than one only where tokens are empty."""
    out_a, out_b = [], []
    for key, x, y in zip(keys, last_a, last_b):
        from_a, from_b = x, y
        while from_a and ends_a[from_a - 1] == key:
            from_a -= 1
        while from_b and ends_b[from_b - 1] == key:
            from_b -= 1
        for i in range(from_a, x + 1):
            out_a += [i] * (y + 1 - from_b)
            out_b += range(from_b, y + 1)
    return out_a, out_b


def align_texts(both: Pair, texts: list[str]) -> tuple[np.ndarray, list[str], list[np.ndarray], np.ndarray]:
    """Per text the four counts and its groups; and of all linked id pairs text, code (A id, B id) and times."""
    found = list(both.encode(texts))
    a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    first_a, first_b = (np.cumsum([0] + [len(f[k]) for f in found]) for k in (0, 1))
    # Bytes of earlier texts are in the ends of later ones, on both sides alike.
    ends_a, ends_b = np.cumsum(both.length_a[a]).tolist(), np.cumsum(both.length_b[b]).tolist()
    keys, last_a, last_b, first_key = [], [], [], [0]
    for i, j, k, m in zip(first_a[:-1].tolist(), first_a[1:].tolist(), first_b[:-1].tolist(), first_b[1:].tolist()):
        for whole, part in zip((keys, last_a, last_b), common_ends(ends_a[i:j], ends_b[k:m], i, k)):
            whole += part
        first_key.append(len(keys))
    empty = not (both.length_a.all() and both.length_b.all())
    linked_a, linked_b = (np.array(x, np.int64) for x in (links(ends_a, ends_b, keys, last_a, last_b) if empty else (last_a, last_b)))
    text_of = np.searchsorted(first_a, linked_a, "right") - 1
    last_a, last_b = np.array(last_a, np.int64), np.array(last_b, np.int64)
    names = both.names[laid_out(a, b, last_a, last_b, both.n_a, both.n_b)].tolist()
    first = (first_a + first_b).tolist()
    groups = ["".join(names[x:y])[:-1] for x, y in zip(first[:-1], first[1:])]
    code, times = np.unique(text_of << 42 | a[linked_a] * both.n_b + b[linked_b], return_counts=True)
    text_of_code, code = code >> 42, code & ((1 << 42) - 1)
    counts = np.stack([np.diff(first_a), np.diff(first_b), np.diff(first_key), np.bincount(text_of, minlength=len(texts))])
    return counts, groups, [text_of_code, code // both.n_b << 32 | code % both.n_b], times


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """Per row ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256`` and its linked id pairs as ``codes`` with ``times``."""
    ids = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                yield align(batch.slice(low, ROWS))

    def align(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, groups, (text_of, code), times = align_texts(pair(path_a, path_b), [t or "" for t in batch.column("text").to_pylist()])
        offsets = pa.array(np.searchsorted(text_of, np.arange(batch.num_rows + 1)), pa.int32())
        digests = pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups])
        lists = [pa.ListArray.from_arrays(offsets, pa.array(code)), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, counts), digests, *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"])

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return source.mapInArrow(run, f"doc_id {ids}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<int>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """``a, b, links, best``: links of each id pair over all rows, and whether no other pair of its B id has more."""
    pairs = rows.select(F.explode(F.arrays_zip("codes", "times")).alias("p"))
    counts = settle(pairs.groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.times").alias("links")), "pair-counts")
    b = F.col("code").bitwiseAND((1 << 32) - 1)
    most = counts.groupBy(b.alias("b")).agg(F.max("links").alias("most"))
    return counts.join(most, b == F.col("b")).select(F.shiftright("code", 32).alias("a"), "b", "links", (F.col("links") == F.col("most")).alias("best"), "code")


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts of tokens, groups and links, ``n_best`` and ``count_sum`` over links, the groups' digest."""
    rows = settle(aligned(docs, path_a, path_b, id_col, text_col), "aligned")
    # At most the bytes of both vocabularies, see above.
    table = pair_counts(rows).select("code", "links", "best").toArrow().sort_by("code")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("code", "links", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n_links, best = shared.value
        for batch in batches:
            offsets = batch.column("codes").offsets.to_numpy()
            at = np.searchsorted(code, batch.column("codes").flatten().to_numpy())
            times = batch.column("times").flatten().to_numpy().astype(np.int64)
            sums = [np.concatenate([[0], np.cumsum(v)]) for v in (times * best[at], times * n_links[at])] if len(at) else [np.zeros(1, np.int64)] * 2
            offsets = offsets - offsets[0]
            made = [pa.array(s[offsets[1:]] - s[offsets[:-1]], pa.int64()) for s in sums]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, "n_best", "count_sum"])

    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", n_best long, count_sum long"
    return rows.mapInArrow(run, schema)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
