"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets share all words by weight, none above ``most`` times its source. A source is a stream of its
documents in hashed order, run through as often as its target asks, and cut into blocks. The tree halves
the output shards from all down to one: at each node every source's quota of blocks is divided by a
multivariate-hypergeometric draw, so quotas stay exact and every shard gets the mix's shares up to
chance. A shard takes its quota as a run of the source's permuted block numbers, so no block is drawn
twice; a document is cut where a block ends, so a shard holds its quota of every source to the word, and
within a shard, draws have a hashed local order.

Documents move once, with sources split over bins. One row per source reaches the driver, where the
tree divides the quotas.

Defined results: a null source is a source of its own, last in order; null and empty texts have size 0,
and are never drawn; repeated rows are documents of their own; an empty table gives an empty table;
other columns are kept as they are, or not read where only the digest is asked for.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.llm.common import documents, n_words, running_sums, settle

WEIGHTS = (5, 2, 1)
MOST = 3
SHARDS = 8
BLOCK_WORDS = 4096
BINS = 1024
SEED = 7
#: numpy draws from fewer than 10**9 blocks; a source's last block counts as a whole one.
MOST_BLOCKS = 500_000_000


def source_key(source: Column) -> Column:
    """A key that is never null and tells a null source from any other."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("."), source.cast("string")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, key, source_size`` with ``target``: the least level of weight that shares all words, under the caps.

    Sources fill up in the order of cap over weight, so running sums of that order find the level. The
    windows are over one row per source.
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("_w", weight.cast("double")).withColumn("_cap", (most * F.col("source_size")).cast("double"))
    s = s.withColumn("_full_at", F.col("_cap") / F.col("_w"))
    filled = W.orderBy("_full_at", "key").rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy("_full_at", "key").rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(filled), F.lit(0.0))) / F.sum("_w").over(rest)
    s = s.withColumn("_level", level).withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_full_at"), F.col("_level"))).over(whole))
    return s.withColumn("target", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.lit(0.0)))).drop("_w", "_cap", "_full_at", "_level")


def split_quotas(blocks: list[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """Blocks of each source for each shard, from the splitting tree; shards differ by one block at most."""
    out = [[0] * shards for _ in blocks]

    def split(low: int, high: int, quota: np.ndarray) -> None:
        if high - low == 1:
            for source, n in enumerate(quota):
                out[source][low] = int(n)
            return
        middle, total = (low + high) // 2, int(quota.sum())
        draw = np.random.default_rng([seed, low, high]).multivariate_hypergeometric
        left = draw(quota, round(total * (middle - low) / (high - low)), method="marginals") if total else quota
        split(low, middle, left)
        split(middle, high, quota - left)

    if blocks:
        split(0, shards, np.asarray(blocks, np.int64))
    return out


def mix(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", shards: int = SHARDS, block_words: int = BLOCK_WORDS,
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST, whole: bool = False, seed: int = SEED) -> DataFrame:
    """One row per input row: ``row`` (all its columns), ``size``, ``source_size``, ``target``, ``draws``.

    ``draws`` lists (pass, start, words, block, shard, local_order) of each piece of the document in the mix: its
    words from ``start`` on that lie in the block. The last document of a source's last pass is drawn for its first
    words only, so a source's words meet its rounded target exactly. With ``whole`` a document is never cut: it
    goes where its first word goes, and the last one is drawn if its middle is inside. Blocks grow with the
    mix where it would have more than ``MOST_BLOCKS``. ``docs`` is read three times and should be a stored table or a scan.
    """
    spark = docs.sparkSession
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("_id"), docs[source_col].alias("source"), size.cast("long").alias("size"))
    base = base.withColumn("key", source_key(F.col("source")))
    sizes = base.groupBy("source", "key").agg(F.sum("size").alias("source_size"))
    plan = settle(targets(sizes, weights, most), "mix-targets").orderBy("key").collect()
    quota = [round(p["target"]) for p in plan]
    block_words = max(block_words, -(-sum(quota) // MOST_BLOCKS))
    blocks = [-(-q // block_words) for q in quota]
    shares = split_quotas(blocks, shards, seed)
    rows = []
    for p, q, n, share in zip(plan, quota, blocks, shares):
        step = next(a for a in range(max(1, int(n * 0.618)), 2 * n + 2) if math.gcd(a, max(1, n)) == 1)
        rows.append((p["key"], p["source_size"], p["target"], q, n, step, [int(e) for e in np.cumsum(share)]))
    schema = "key string, source_size long, target double, _quota long, _blocks long, _step long, _ends array<long>"
    plan_table = spark.createDataFrame(rows, schema)
    hashed = F.xxhash64(F.lit(seed), "_id", "size")
    placed = running_sums(base.withColumn("_hash", hashed), ["key"], F.shiftright("_hash", 54).cast("int"), ["_hash", "_id", "size"], F.col("size"), "_at").join(plan_table, "key", "left")
    from_ = lambda i: i * F.col("source_size") + F.col("_at")
    until = lambda i: F.least(from_(i) + F.col("size"), F.col("_quota"))

    def piece(i: Column, number: Column, start: Column, words: Column) -> Column:
        block = F.pmod(F.col("_step") * number, F.col("_blocks"))
        shard = F.size(F.filter("_ends", lambda e: e <= block))
        order = F.xxhash64(F.lit(seed), "_id", i, number)
        return F.struct(i.alias("pass"), start.alias("start"), words.alias("words"), block.alias("block"), shard.alias("shard"), order.alias("local_order"))

    def cut(i: Column) -> Column:
        low = lambda n: F.greatest(from_(i), n * block_words)
        numbers = F.sequence(F.floor(from_(i) / block_words), F.floor((until(i) - 1) / block_words))
        pieces = F.transform(numbers, lambda n: piece(i, n, low(n) - from_(i), F.least(until(i), (n + 1) * block_words) - low(n)))
        return F.when((F.col("size") > 0) & (until(i) > from_(i)), pieces)

    def uncut(i: Column) -> Column:
        inside = (F.col("size") > 0) & (from_(i) < F.col("_quota")) & (2 * (until(i) - from_(i)) >= F.col("size"))
        return F.when(inside, F.array(piece(i, F.floor(from_(i) / block_words), F.lit(0).cast("long"), F.col("size"))))

    passes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), uncut if whole else cut), lambda d: d.isNotNull())
    return placed.select("row", "size", "source_size", "target", F.flatten(passes).alias("draws"))


def drawn_rows(docs: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """``row, shard, local_order``: a document comes as often as it is drawn, whole.

    Each partition, and file that is written from it, has its rows of every shard together and in local
    order; bins of hashes dealt the rows, so a partition has its part of each source. Texts are not moved again for that.
    """
    drawn = mix(docs, n_words(docs[text_col]), whole=True, **names)
    rows = drawn.select("row", F.explode("draws").alias("draw")).select("row", "draw.shard", "draw.local_order")
    return rows.sortWithinPartitions("shard", "local_order")


def mixed_rows(docs: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """The rows of :func:`drawn_rows` with the columns of ``docs``."""
    return drawn_rows(docs, text_col, **names).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``taken`` sums the words of ``draws``, which say in which shard, block and place each piece is."""
    docs = documents(spark, sf_dir)
    sized = settle(docs.select("doc_id", "source", n_words(docs["text"]).alias("size")), "mix-sizes")
    drawn = mix(sized, sized["size"])
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return drawn.select("row.doc_id", "size", "source_size", "target", taken.alias("taken"), "draws")
