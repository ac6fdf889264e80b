"""Ranked lexical search as an exact inner-product search in sparse ball trees.

A document is a vector over terms: its value for a term is the integer part of the score that depends on
the document. An item is a vector of integer term weights, so a score is an inner product of integers.
Documents are read once for their counts of the items' terms, and once more to be searched: each task
gathers its documents in blocks and builds a ball tree over each block. A node keeps the centroid of its
documents, the largest distance to it, and that distance within runs of terms. An inner product is at most
the centroid's plus the item's norm times the radius, taken over all terms or run by run, whichever is
less; bounds are rounded up. A search takes the node with the largest bound first and ends when no bound
reaches the least score that still counts; leaves are scored in 64-bit integers. A task carries each
item's best documents from block to block, so later trees are cut by earlier ones, and hands on as many
rows as an item wants; two steps of ranking end the search.

Items are searched in batches of at most 256 items or 100,000 terms (an item with more is alone); a
batch's terms and weights travel with the tasks, so their size does not grow with the documents.

Defined results: null and empty texts have no terms and are in no result; an item without terms, or whose
terms no document has, has no row; repeated documents rank as documents of their own, those without id
after the others of the same score; a repeated item is answered as often as it comes; an empty table on
either side gives an empty table; other columns are not read. Texts are read whole.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.llm.common import documents, settle

TOP = 50
LEAF = 16
#: Terms in a run that has a radius of its own.
RUN = 8
#: Cells of a block's matrix, and documents in a block at most.
CELLS, BLOCK = 1 << 22, 1024
BATCH_ITEMS, BATCH_TERMS = 256, 100_000
ROWS = 256

#: Terms are made of digits, letters and all beyond ASCII; only A to Z are lower-cased.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def counted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n`` of every row with terms, and ``terms`` and ``tfs``: the vocabulary's terms in it, and how often."""
    ids = docs.schema[id_col].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                kept, sizes, found, tfs = [], [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    all_terms = terms(text)
                    if not all_terms:
                        continue
                    counts = Counter(all_terms)
                    own = sorted((number[t], counts[t]) for t in counts.keys() & number.keys())
                    kept.append(row)
                    sizes.append(len(all_terms))
                    found.append([t for t, _ in own])
                    tfs.append([c for _, c in own])
                columns = [part.column("doc_id").take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return source.mapInArrow(run, f"doc_id {ids}, n long, terms array<int>, tfs array<long>")


@dataclass
class Queries:
    """Items as vectors: term numbers and integer weights of each."""

    terms: list[np.ndarray]
    weights: list[np.ndarray]
    n_terms: int


class BallTree:
    """A ball tree over the rows of an integer matrix with one column per term."""

    def __init__(self, matrix: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(matrix))
        self.low, self.high, self.children = [], [], []
        centroids, radii, run_radii = [], [], []
        values = matrix.astype(np.float64)
        stack = [(0, len(matrix), -1)]
        while stack:
            low, high, parent = stack.pop()
            node = len(self.low)
            if parent >= 0:
                self.children[parent].append(node)
            rows = values[self.order[low:high]]
            centroid = rows.mean(axis=0)
            squares = (rows - centroid) ** 2
            runs = np.add.reduceat(squares, np.arange(0, squares.shape[1], RUN), axis=1)
            away = runs.sum(axis=1)
            self.low.append(low)
            self.high.append(high)
            self.children.append([])
            centroids.append(centroid)
            radii.append(math.sqrt(away.max()))
            run_radii.append(np.sqrt(runs.max(axis=0)))
            if high - low > leaf:
                # The direction from the document farthest out to the one farthest from it, cut at the median.
                first = rows[away.argmax()]
                second = rows[((rows - first) ** 2).sum(axis=1).argmax()]
                along = rows @ (second - first)
                self.order[low:high] = self.order[low:high][np.argsort(along, kind="stable")]
                middle = (low + high) // 2
                stack += [(low, middle, node), (middle, high, node)]
        self.centroids, self.radii, self.run_radii = np.array(centroids), np.array(radii), np.array(run_radii)
        self.matrix = matrix[self.order]

    def bounds(self, terms_: np.ndarray, weights: np.ndarray, norm: float, runs: np.ndarray, run_norms: np.ndarray) -> np.ndarray:
        """No document of a node scores more than the node's bound. Sums of floats err by far less than what is added."""
        center = self.centroids[:, terms_] @ weights.astype(np.float64)
        reach = np.minimum(norm * self.radii, self.run_radii[:, runs] @ run_norms)
        return (center + reach) * (1 + 1e-9) + 1


def search(tree: BallTree, columns: np.ndarray, ids: list, queries: Queries, best: list[list], top: int) -> int:
    """Best-first search of each item in one tree; ``best`` holds each item's heap of (score, has id, -id). Returns leaves scored.

    ``columns`` are the term numbers of the matrix' columns.
    """
    place = np.full(queries.n_terms, -1)
    place[columns] = np.arange(len(columns))
    run_of_column = np.arange(len(columns)) // RUN
    scored = 0
    for k, heap in enumerate(best):
        at = place[queries.terms[k]]
        here = at >= 0
        at, weights = at[here], queries.weights[k][here]
        if not len(at):
            continue
        squares = np.bincount(run_of_column[at], weights.astype(float) ** 2, run_of_column[-1] + 1)
        runs = np.flatnonzero(squares)
        bound = tree.bounds(at, weights, math.sqrt(float((weights.astype(float) ** 2).sum())), runs, np.sqrt(squares[runs]))
        open_ = [(-bound[0], 0)]
        while open_:
            negative, node = heapq.heappop(open_)
            least = heap[0][0] if len(heap) == top else 1
            if -negative < least:
                break
            if tree.children[node]:
                for child in tree.children[node]:
                    if bound[child] >= least:
                        heapq.heappush(open_, (-bound[child], child))
                continue
            scored += 1
            low, high = tree.low[node], tree.high[node]
            scores = tree.matrix[low:high, at] @ weights
            for i in np.flatnonzero(scores >= least):
                doc = ids[tree.order[low + i]]
                entry = (int(scores[i]), doc is not None, -doc if doc is not None else 0)
                if len(heap) < top:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
    return scored


def searched(vectors: DataFrame, queries: Queries, top: int) -> DataFrame:
    """``item, doc_id, score``: the best documents of every task. ``vectors``: doc_id, m, terms, tfs."""
    ids = vectors.schema["doc_id"].dataType.simpleString()
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
        held = [], [], [], []
        limit = max(LEAF, min(BLOCK, CELLS // max(1, shared.value.n_terms)))
        for batch in batches:
            bounds = batch.column("terms").offsets.to_numpy()
            flat = [batch.column(c).flatten().to_numpy() for c in ("terms", "tfs")]
            bounds = bounds - bounds[0]
            for i, (doc, m) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("m").to_numpy())):
                for part, value in zip(held, (doc, m, flat[0][bounds[i] : bounds[i + 1]], flat[1][bounds[i] : bounds[i + 1]])):
                    part.append(value)
                if len(held[0]) == limit:
                    yield held
                    held = [], [], [], []
        if held[0]:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best: list[list] = [[] for _ in own.terms]
        for ids_, m, found, tfs in blocks(batches):
            columns, at = np.unique(np.concatenate(found), return_inverse=True)
            matrix = np.zeros((len(ids_), len(columns)), np.int64)
            tf, row = np.concatenate(tfs), np.repeat(np.arange(len(ids_)), [len(f) for f in found])
            matrix[row, at] = 1_000_000_000 * tf // (1000 * tf + 20 * np.asarray(m)[row])
            search(BallTree(matrix), columns, ids_, own, best, top)
        rows = [(k, -e[2] if e[1] else None, e[0]) for k, heap in enumerate(best) for e in heap]
        if rows:
            item, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, vectors_type), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    vectors_type = to_arrow_type(vectors.schema["doc_id"].dataType)
    return vectors.mapInArrow(run, f"item int, doc_id {ids}, score long")


def _ranked(best: DataFrame, top: int) -> DataFrame:
    """Two steps, so no task gets more than its part of all tasks' rows of an item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(32))
    cut = best.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= top)
    return cut.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top).drop("part")


def _batches(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Items with their terms, from the driver, in batches of bounded size."""
    batch, size = [], 0
    for row in items.select(items[item_col], items[text_col]).toLocalIterator():
        own = sorted(set(terms(row[1])))
        if batch and (len(batch) == BATCH_ITEMS or size + len(own) > BATCH_TERMS):
            yield batch
            batch, size = [], 0
        if own:
            batch.append((row[0], own))
            size += len(own)
    if batch:
        yield batch


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    out = None
    for batch in _batches(items, item_col, item_text_col):
        vocabulary: dict[bytes, int] = {}
        for _, own in batch:  # an item's new terms are in a row, so runs hold terms that come together
            for t in own:
                vocabulary.setdefault(t, len(vocabulary))
        vectors = settle(counted(docs, vocabulary, id_col, text_col), "term-counts")
        totals = vectors.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        if not totals["n"]:
            break
        held = {r["t"]: r["df"] for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
        weight = {t: math.floor(1000 * math.log((2 * totals["n"] + 2) / (2 * df + 1))) for t, df in held.items()}
        found = [np.array([vocabulary[t] for t in own if vocabulary[t] in weight], np.int64) for _, own in batch]
        queries = Queries(found, [np.array([weight[t] for t in ts], np.int64) for ts in found], len(vocabulary))
        m = F.lit(50) + F.expr(f"cast(50 * n as decimal(19, 0)) * cast({totals['n']} as decimal(18, 0)) div cast({totals['l']} as decimal(19, 0))")
        ranked = _ranked(searched(vectors.filter(F.size("terms") > 0).select("doc_id", m.cast("long").alias("m"), "terms", "tfs"), queries, top), top)
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(batch)], f"item int, item_id {items.schema[item_col].dataType.simpleString()}")
        part = ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = part if out is None else out.unionAll(settle(part, "found"))
    if out is None:
        types = [items.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()]
        return spark.createDataFrame([], f"item_id {types[0]}, rank int, doc_id {types[1]}, score long")
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
q AS (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct({_TERMS})) AS t FROM benchmark),
s AS (SELECT r, doc_id, len(ts) AS n, ts FROM d WHERE len(ts) > 0),
g AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM s),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM s) GROUP BY r, t),
v AS (SELECT t, floor(1000 * ln((2 * (SELECT big_n FROM g) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f WHERE t IN (SELECT t FROM q) GROUP BY t),
m AS (SELECT r, doc_id, 100 - 50 + ((50 * n * big_n) // big_l) AS m FROM s, g),
p AS (SELECT q, item_id, m.r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN v USING (t) JOIN f USING (t) JOIN m ON m.r = f.r GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM p WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 50"""
