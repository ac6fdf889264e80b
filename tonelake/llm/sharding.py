"""Sharding by balanced label propagation.

Documents of one link (equal texts) are neighbours. Labels start as a hash of the id. Neighbours with
one label are alike, so the state is one row per link and shard with a count, however many copies a link
has. In every round a link's rows ask for the shard that holds most of their neighbours and still has
room; a shard admits moves, in hashed order, up to its capacity, the last one in part. Moves only ever
join what was apart, so cut edges fall. Moves need free room, and where few documents are unlinked there is
hardly any; so links that are still apart after the rounds leave their shards all at once, and what they leave
is room. They come back whole, in one line of falling size that is cut where a shard is full, so at most one
link is cut at each border of two shards. At the end documents take their link's places, and unlinked documents
fill the shards to counts that differ by one at most.

The driver sees one number per shard. No window spans a whole shard or link.

Defined results: null text is the empty text, and such documents are linked; each repeated row has a
place of its own; ids may be null; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.llm.common import documents, n_bytes, running_sums, settle

SHARDS = 8
ROUNDS = 6
BINS = 1024
SEED = 11


def _by_shard(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _loads(cells: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def propagate(cells: DataFrame, capacity: int, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, int]:
    """One round over ``cells`` (link, shard, n): the new cells and how many documents moved."""
    room = [max(0, capacity - load) for load in _loads(cells, shards)]
    link = W.partitionBy("link")
    weight = F.struct("n", F.xxhash64(F.lit(seed), "link", "shard").alias("h"), "shard")
    has_room = F.element_at(_by_shard(room), F.col("shard") + 1) > 0
    seen = cells.withColumn("weight", weight).withColumn("best", F.max(F.when(has_room, F.col("weight"))).over(link))
    asks = settle(seen.filter(F.col("weight") < F.col("best")).select("link", "shard", "n", F.col("best.shard").alias("to")), "shard-asks")
    bins = F.pmod(F.xxhash64(F.lit(seed), "link"), F.lit(BINS)).cast("int")
    asks = running_sums(asks, ["to"], bins, ["link", "shard"], F.col("n"), "before")
    moves = asks.withColumn("m", F.greatest(F.lit(0), F.least(F.col("n"), F.element_at(_by_shard(room), F.col("to") + 1) - F.col("before"))))
    moves = settle(moves.filter("m > 0").select("link", "shard", "to", "m"), "shard-moves")
    moved = moves.agg(F.sum("m")).first()[0] or 0
    parts = cells.select("link", "shard", "n").unionAll(moves.select("link", "shard", -F.col("m"))).unionAll(moves.select("link", "to", "m"))
    return settle(parts.groupBy("link", "shard").agg(F.sum("n").alias("n")).filter("n > 0"), "shard-cells"), moved


def deal_whole(cells: DataFrame, want: list[int], seed: int = SEED) -> DataFrame:
    """The cells with all split links dealt anew: shard loads stay within ``want``, ``len(want) - 1`` links are cut at most.

    Links of a shard that holds more than it should are dealt anew with them.
    """
    marked = settle(cells.select("link", "shard", "n", (F.count("*").over(W.partitionBy("link")) > 1).alias("out")), "shard-split")
    loads = _loads(marked.filter(~F.col("out")), len(want))
    over = F.element_at(_by_shard([load > w for w, load in zip(want, loads)]), F.col("shard") + 1) > 0
    room = [w if load > w else w - load for w, load in zip(want, loads)]
    lifted = settle(marked.filter(F.col("out") | over).groupBy("link").agg(F.sum("n").alias("n")), "shard-lifted")
    # Large links come first, so that one larger than a shard starts with an empty one.
    bins = (63 - F.floor(F.log2("n"))) * BINS + F.pmod(F.xxhash64(F.lit(seed), "link"), F.lit(BINS))
    line = running_sums(lifted.withColumn("one", F.lit(1)), ["one"], bins, ["link"], F.col("n"), "from")
    parts, start = [], 0
    for s in sorted(range(len(want)), key=lambda s: (-room[s], s)):
        inside = F.least(F.col("from") + F.col("n"), F.lit(start + room[s])) - F.greatest(F.col("from"), F.lit(start))
        parts.append(F.struct(F.lit(s).alias("shard"), inside.cast("long").alias("n")))
        start += room[s]
    dealt = line.select("link", F.explode(F.filter(F.array(*parts), lambda p: p["n"] > 0)).alias("p")).select("link", "p.shard", "p.n")
    return settle(marked.filter(~(F.col("out") | over)).select("link", "shard", "n").unionAll(dealt), "shard-cells")


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """``docs`` (a stored table with ``doc_id`` and ``link``) with ``shard`` and ``slot``; ``link`` groups neighbours.

    Counts differ by one at most; slots of a shard are gapless from 0.
    """
    label = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(shards)).cast("int")
    total = docs.count()
    want = [total // shards + (s < total % shards) for s in range(shards)]
    cells = docs.groupBy("link", label.alias("shard")).agg(F.count("*").alias("n"))
    cells = cells.withColumn("all", F.sum("n").over(W.partitionBy("link"))).filter("`all` > 1").drop("all")
    cells = settle(cells, "shard-cells")
    for _ in range(rounds):
        cells, moved = propagate(cells, min(want), shards, seed)
        if not moved:
            break
    cells = deal_whole(cells, want, seed)
    kept = [min(w, load) for w, load in zip(want, _loads(cells, shards))]
    by_link = W.partitionBy("link").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    cells = running_sums(cells, ["shard"], F.pmod(F.xxhash64("link"), F.lit(BINS)).cast("int"), ["link"], F.col("n"), "at")
    cells = cells.withColumn("first", F.coalesce(F.sum("n").over(by_link), F.lit(0)))
    places = settle(cells.groupBy("link").agg(F.sort_array(F.collect_list(F.struct("first", "shard", "at"))).alias("places")), "shard-places")
    marked = settle(docs.join(places, "link", "left"), "shard-marked")

    linked = marked.filter("places IS NOT NULL")
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(BINS)).cast("int")
    linked = running_sums(linked, ["link"], spread, ["doc_id"], F.lit(1), "rank")
    place = F.element_at(F.filter("places", lambda p: p["first"] <= F.col("rank")), -1)
    linked = linked.withColumn("p", place).select(*docs.columns, F.col("p.shard").alias("shard"), (F.col("p.at") + F.col("rank") - F.col("p.first")).alias("slot"))
    linked = settle(linked, "shard-linked")
    fits = F.col("slot") < F.element_at(_by_shard(kept), F.col("shard") + 1)

    loose = marked.filter("places IS NULL").select(*docs.columns).unionAll(linked.filter(~fits).select(*docs.columns))
    loose = running_sums(loose.withColumn("one", F.lit(1)), ["one"], spread, ["doc_id", "link"], F.lit(1), "rank")
    ends, filled = [], 0
    for w, k in zip(want, kept):
        filled += w - k
        ends.append(filled)
    shard = F.size(F.filter(_by_shard(ends), lambda e: e <= F.col("rank")))
    slot = F.col("rank") + F.element_at(_by_shard([k - (e - (w - k)) for w, k, e in zip(want, kept, ends)]), F.col("shard") + 1)
    loose = loose.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long"))
    return linked.filter(fits).unionByName(loose.select(*linked.columns))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    text = F.coalesce(docs["text"], F.lit(""))
    keys = docs.select("doc_id", (n_bytes(docs["text"]) + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("link"))
    out = balanced_shards(settle(keys, "shard-keys"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
