"""Sharding and mixing."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import odd_rows, table
from tonelake.llm import mixing, sharding
from tonelake.llm.common import n_words, settle

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sharded(docs):
    keys = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("link"))
    return sharding.balanced_shards(settle(keys, "test-keys"))


def assert_even(rows, n):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(8)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_are_even_and_keep_groups(docs, no_docs):
    rows = sharded(docs).collect()
    assert_even(rows, docs.count())
    groups = defaultdict(set)
    for r in rows:
        groups[r["link"]].add(r["shard"])
    assert sum(len(s) - 1 for s in groups.values()) <= 1
    assert sharded(no_docs).count() == 0


def test_a_hot_group_fills_few_shards(spark):
    rows = [(i, "hot" if i < 300 else f"t{i}", "a") for i in range(700)]
    out = sharded(table(spark, rows)).collect()
    assert_even(out, 700)
    link = Counter(r["link"] for r in out).most_common(1)[0][0]
    hot = Counter(r["shard"] for r in out if r["link"] == link)
    assert sum(hot.values()) == 300 and len(hot) <= 5  # 300 rows need at least four shards of 87 or 88


def cut_links(rows):
    shards = defaultdict(set)
    for r in rows:
        shards[r["link"]].add(r["shard"])
    return sum(len(s) > 1 for s in shards.values())


@pytest.mark.parametrize("hot,paired", [(0, 4000), (0, 3800), (1333, 3880)])
def test_groups_stay_whole_where_hardly_a_row_is_loose(spark, hot, paired):
    rows = [(i, "hot" if i < hot else f"t{i // 2}" if i < paired else f"one{i}", "a") for i in range(4000)]
    out = sharded(table(spark, rows)).collect()
    assert_even(out, 4000)
    assert cut_links(out) <= 7  # at most one at each border of two shards


def water_level(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, target = set(), {}
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / total for s in names}
        above = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def test_mix_meets_targets(docs, no_docs):
    out = mixing.mix(docs, n_words(docs["text"]), block_words=64)
    rows = out.select("row.doc_id", "row.text", "row.source", "size", "source_size", "target", "draws").collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in rows) == Counter(odd_rows())
    sizes, taken, shards, blocks = Counter(), Counter(), Counter(), Counter()
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or ""))
        words = sum(d["words"] for d in r["draws"])
        assert words <= 3 * r["size"] and all(0 <= d["start"] and d["start"] + d["words"] <= r["size"] and d["words"] > 0 for d in r["draws"])
        for k in range(3):  # the pieces of a pass follow each other
            ends = [(d["start"], d["start"] + d["words"]) for d in r["draws"] if d["pass"] == k]
            assert all(a[1] == b[0] for a, b in zip(ends, ends[1:])) and (not ends or ends[0][0] == 0)
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += words
        for d in r["draws"]:
            shards[r["source"], d["shard"]] += d["words"]
            blocks[r["source"], d["shard"], d["block"]] += d["words"]
    target = water_level(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    # Every shard holds the words of the blocks that the tree gave it, of every source: all full but a source's last one.
    order = sorted(target, key=lambda s: "" if s is None else "." + s)
    quotas = [-(-round(target[s]) // 64) for s in order]
    for s, share in zip(order, mixing.split_quotas(quotas, 8)):
        for shard, n in enumerate(share):
            held = sorted(words for (a, b, _), words in blocks.items() if (a, b) == (s, shard))
            assert len(held) == n and held[1:] == [64] * (n - 1) and (64 * n - 64 < shards[s, shard] <= 64 * n if n else shards[s, shard] == 0)
    again = mixing.mix(docs, n_words(docs["text"]), block_words=64).select("draws").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in out.select("draws").collect())
    assert mixing.mix(no_docs, n_words(no_docs["text"])).count() == 0


def test_mixed_rows_keep_columns(docs, monkeypatch):
    from pyspark.sql import functions as F

    rows = mixing.mixed_rows(docs, block_words=16)
    drawn = mixing.mix(docs, n_words(docs["text"]), whole=True, block_words=16)
    wanted = Counter((d["shard"], d["local_order"], r["row"]["doc_id"]) for r in drawn.collect() for d in r["draws"])
    placed = mixing.drawn_rows(docs, block_words=16).select(F.spark_partition_id().alias("p"), "shard", "local_order", "row.doc_id").collect()
    assert Counter((r["shard"], r["local_order"], r["doc_id"]) for r in placed) == wanted and len({r["shard"] for r in placed}) == 8
    for p in {r["p"] for r in placed}:
        order = [(r["shard"], r["local_order"]) for r in placed if r["p"] == p]
        assert order == sorted(order)
    with monkeypatch.context() as m:
        m.setattr(mixing, "MOST_BLOCKS", 50)  # a larger mix has larger blocks, not more of them
        draws = mixing.mix(docs, n_words(docs["text"]), block_words=4).select("draws").collect()
        assert max(d["block"] for r in draws for d in r["draws"]) < 50 + 4
    assert rows.columns == docs.columns
    assert set(map(tuple, rows.select("doc_id", "text").collect())) <= {(i, t) for i, t, _ in odd_rows()}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 5}, {"a": 1, "b": 1, "c": 10_000}, {"a": 0}, {"z": 7}])
def test_targets_share_all(spark, sizes):
    s = spark.createDataFrame([(k, "" if k is None else "." + k, v) for k, v in sizes.items()], "source string, key string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(s).collect()}
    assert got == pytest.approx(water_level(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0))


def test_quotas_split_exactly():
    blocks = [100, 3, 0, 57]
    shares = mixing.split_quotas(blocks, 8)
    assert [sum(s) for s in shares] == blocks
    per_shard = np.sum(shares, axis=0)
    assert per_shard.max() - per_shard.min() <= 3
    assert mixing.split_quotas([], 8) == []
