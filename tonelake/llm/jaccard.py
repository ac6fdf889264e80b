"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A document's shingles are its runs of five words, hashed. The forest has trees over labels of MinHash
values. Two documents meet in a tree if their labels share a prefix; prefixes start at full depth and are
shortened until a pair right at the threshold is met with the target recall. Sharing is an
equality of hashed prefixes, so a tree's trie is a grouping and not a sort.

Documents with equal shingle sets are one node. Nodes that meet are joined to the least node of their
bucket only, so no bucket makes pairs; the components of these edges hold all links that the forest
finds. Within a component all pairs are compared exactly, in blocks of bounded size, and only counts and
spanning edges leave a block. So no link inside a component is lost, and no pairs are stored.

Defined results: null is the empty text; texts without words have equal, empty shingle sets; a text of
one to four words has one shingle, all its words; a repeated row is a copy of its like; a class's id is
its least document id (null ids never count unless a class has no other); an empty table gives an empty
table; other columns are not read. Words compare as they are written. Texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm.common import documents, map_batches, settle, texts
from tonelake.llm.components import components
from tonelake.session import release

SHINGLE = 5
THRESHOLD = 0.8
BLOCK = 256


@dataclass(frozen=True)
class Forest:
    """``trees`` tries of labels of ``depth`` MinHash values, searched to ``recall`` at the threshold."""

    trees: int = 48
    depth: int = 12
    recall: float = 0.9995
    seed: int = 5

    def prefix(self, threshold: float) -> int:
        """The longest prefix that meets the target recall for pairs at the threshold."""
        length = self.depth
        while length > 1 and 1 - (1 - threshold**length) ** self.trees < self.recall:
            length -= 1
        return length


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit moves every other."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_ORDER = _mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word in UTF-8 bytes: differences of a running polynomial."""
    inside = ~_SPACE[data]
    change = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = change[::2], change[1::2]
    powers = np.full(len(data) + 1, _BASE)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    running = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(_BYTES[data] * powers[:-1])])
    # The same word has the same sum times a power; dividing by the power is multiplying by its inverse.
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    back = np.full(len(data) + 1, inverse)
    back[0] = 1
    back = np.multiply.accumulate(back)
    return _mix((running[ends] - running[starts]) * back[starts] + (ends - starts).astype(np.uint64)), starts


def shingle_sets(batch: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in batch]
    data = np.frombuffer(b"\n".join(encoded), np.uint8)
    words, starts = word_hashes(data)
    bounds = np.cumsum([0] + [len(e) + 1 for e in encoded])
    first = np.searchsorted(starts, bounds)
    n = max(0, len(words) - SHINGLE + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        runs += words[k : k + n] * _ORDER[k]
    runs = _mix(runs)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1]))
        else:  # one shingle of all its words, or none
            whole = (words[a:b] * _ORDER[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(_mix(np.asarray([whole], np.uint64)) if b > a else np.zeros(0, np.uint64))
    return out


def prefix_keys(sets: list[np.ndarray], forest: Forest, length: int) -> np.ndarray:
    """For each set and tree the hash of its label's prefix; all sets must have members."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(forest.seed)
    factors = rng.integers(0, 1 << 31, (forest.trees, forest.depth), np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 1 << 32, (forest.trees, forest.depth), np.uint32)
    keys = np.zeros((len(sets), forest.trees), np.uint64)
    for tree in range(forest.trees):
        label = np.full(len(sets), tree + 1, np.uint64)
        for at in range(length):
            low = np.minimum.reduceat(values * factors[tree, at] + shifts[tree, at], starts)
            label = _mix(label * _BASE + low.astype(np.uint64))
        keys[:, tree] = label
    return keys


def set_hash(values: np.ndarray) -> int:
    """One number for a set of hashes, in any order."""
    return int(_mix(np.asarray([_mix(values).sum(dtype=np.uint64) + np.uint64(len(values))], np.uint64)).view(np.int64)[0])


def signatures(docs: DataFrame, forest: Forest, length: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, node, keys`` of every row: its shingle set's hash and the prefixes in the trees."""
    ids = docs.schema[id_col].dataType.simpleString()

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts(batch))
        full = [i for i, s in enumerate(sets) if len(s)]
        keys = np.zeros((len(sets), forest.trees), np.uint64)
        if full:
            keys[full] = prefix_keys([sets[i] for i in full], forest, length)
        offsets = pa.array(np.arange(len(sets) + 1) * forest.trees, pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([set_hash(s) for s in sets], pa.int64()), lists], ["doc_id", "node", "keys"])

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return map_batches(source, sign, f"doc_id {ids}, node long, keys array<long>")


def candidate_components(nodes: DataFrame) -> DataFrame:
    """``node, label``: components of nodes (with keys) that share a bucket; loners have no row.

    A node is joined to the least hub of its buckets, and its other hubs to that one. Nodes of a group share
    their hubs, so hardly any of these edges are distinct, and only hubs go through the rounds.
    """
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    hubs = settle(buckets.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub != last").select("key", "hub"), "buckets")
    # A node has one hub in each tree at most.
    joined = settle(buckets.join(hubs, "key").groupBy("node").agg(F.min("hub").alias("least"), F.collect_set("hub").alias("hubs")), "node-hubs")
    edges = joined.select(F.col("least").alias("a"), F.explode("hubs").alias("b")).filter("a != b").distinct()
    labels = components(edges).withColumnRenamed("node", "least")
    return joined.select("node", "least").join(labels, "least", "left").select("node", F.coalesce("label", "least").alias("label"))


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None = None, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right`` (or of ``left``)."""
    sets = left + (right or [])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    out = np.zeros((len(left), len(right or left)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        out += dense[: len(left)] @ dense[len(left) if right else 0 :].T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold, exactly."""
    common = intersections(left, right).astype(np.int64)
    a, b = (np.asarray([len(s) for s in x], np.int64) for x in (left, right or left))
    return common >= threshold * (a[:, None] + b[None, :] - common) - 1e-9


def _roots(pairs: np.ndarray, n: int) -> np.ndarray:
    """The least index of each index' component, from a table of pairs."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        new = root.copy()
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        np.minimum.at(new, root[pairs[:, 0]], low)
        np.minimum.at(new, root[pairs[:, 1]], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def verify(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """``node, links, root``: linked documents of other nodes, and a node it is linked to by way of its block.

    ``members``: node, label, copies, shingles, of components of all sizes. A component of more than
    ``block`` nodes is dealt to blocks by hash, and each pair of blocks is a group of its own; small
    components share groups. A group holds at most two blocks, or small components by the dozen.
    """
    sizes = members.groupBy("label").agg(F.count("*").alias("m"))
    sized = members.join(settle(sizes, "component-sizes"), "label")
    n_blocks = F.ceil(F.col("m") / block).cast("int")
    small = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))
    own = F.pmod(F.xxhash64("node"), n_blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda j: F.struct(F.least(j, own).alias("x"), F.greatest(j, own).alias("y")))
    groups = 4 * members.sparkSession.sparkContext.defaultParallelism
    groups = max(groups, members.count() // block)
    dealt = sized.withColumn("own", own).withColumn("pair", F.explode(F.when(F.col("m") > block, pairs).otherwise(F.array(small))))
    unit = F.when(F.col("m") > block, F.xxhash64("label", "pair.x", "pair.y")).otherwise(F.pmod(F.xxhash64("label"), F.lit(groups)))
    dealt = dealt.select(unit.alias("unit"), "label", "node", "copies", "shingles", "own", "pair.x", "pair.y")

    def compare(table: pa.Table) -> pa.Table:
        nodes, labels, copies, owns, xs, ys = (table.column(c).to_numpy() for c in ("node", "label", "copies", "own", "x", "y"))
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        order = np.lexsort((nodes, ys, xs, labels))
        cuts = np.flatnonzero(np.any([np.diff(v[order]) != 0 for v in (labels, xs, ys)], axis=0)) + 1
        out = [[], [], []]
        for rows in np.split(order, cuts):
            x, y = xs[rows[0]], ys[rows[0]]
            if x == y:
                near = linked([sets[i] for i in rows], None, threshold)
                np.fill_diagonal(near, False)
                counts = near @ copies[rows]
                pairs = np.argwhere(np.triu(near))
            else:
                left, right = np.flatnonzero(owns[rows] == x), np.flatnonzero(owns[rows] == y)
                if not len(left) or not len(right):
                    continue
                near = linked([sets[i] for i in rows[left]], [sets[i] for i in rows[right]], threshold)
                counts = np.zeros(len(rows), np.int64)
                counts[left], counts[right] = near @ copies[rows[right]], near.T @ copies[rows[left]]
                pairs = np.argwhere(near)
                pairs = np.column_stack([left[pairs[:, 0]], right[pairs[:, 1]]])
            roots = _roots(pairs, len(rows))
            hit = counts > 0
            out[0].append(nodes[rows][hit])
            out[1].append(counts[hit])
            out[2].append(nodes[rows][roots][hit])
        columns = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
        return pa.table([pa.array(c) for c in columns], names=["node", "links", "root"])

    return dealt.groupBy("unit").applyInArrow(compare, "node long, links long, root long")


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, forest: Forest = Forest(), block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, class_id, n_links, node``.

    ``n_links`` counts the other documents at or above the threshold, copies included; classes are the
    components of links, with their least id; ``node`` is equal for equal shingle sets.
    """
    signed = settle(signatures(docs, forest, forest.prefix(threshold), id_col, text_col), "signatures")
    nodes = settle(signed.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.min("keys").alias("keys")), "nodes")
    candidates = candidate_components(nodes.select("node", "keys"))
    # The keys are the bulk of what is stored, and go as soon as nothing reads them any more.
    with_keys = signed, nodes
    signed, nodes = settle(signed.select("doc_id", "node"), "doc-nodes"), settle(nodes.select("node", "copies", "first_id"), "nodes")
    release(*with_keys)
    wanted = settle(nodes.join(candidates, "node"), "candidates")

    def with_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts(batch))
        return pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    source = docs.select(docs[id_col].alias("first_id"), docs[text_col].alias("text"))
    chosen = source.join(wanted.select("first_id").distinct(), source["first_id"].eqNullSafe(wanted["first_id"]), "left_semi")
    sets = map_batches(chosen.select("text"), with_sets, "node long, shingles binary").groupBy("node").agg(F.min("shingles").alias("shingles"))
    members = settle(wanted.select("node", "label", "copies").join(sets, "node"), "members")
    found = settle(verify(members, threshold, block), "links")
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = nodes.join(classes, "node", "left").join(links, "node", "left")
    nodes = settle(nodes.select("node", F.coalesce("label", "node").alias("label"), "first_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "node-classes")
    ids = nodes.groupBy("label").agg(F.min("first_id").alias("class_id"))
    lookup = settle(nodes.join(ids, "label").select("node", "class_id", "n_links"), "classes")
    return signed.select("doc_id", "node").join(lookup, "node").select("doc_id", "class_id", "n_links", "node")


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their class, once each; rows without id stay."""
    classes = settle(jaccard_classes(docs, id_col=id_col, **names).filter(F.col("doc_id") == F.col("class_id")).select("doc_id"), "kept-ids")
    once = classes.distinct()
    kept = docs.join(once, docs[id_col] == once["doc_id"], "left_semi")
    if not classes.groupBy("doc_id").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_col])
    return kept.unionAll(docs.filter(docs[id_col].isNull()))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


ORACLE_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [''] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct([array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS g FROM w),
f AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) * 10 >= 8 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT c.a AS doc_id, class_id, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN n ON n.a = c.a"""
