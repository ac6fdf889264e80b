"""Ranked search against a plain scorer, and the trees' bounds against all scores."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import odd_rows, table
from tonelake.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=50):
    counted = [(i, Counter(terms(t))) for i, t, *_ in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counted:
            m = 100 - 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def near_docs():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abCdÉ7") for _ in range(rng.randint(1, 3)))
    rows = [(k, " ".join(word() for _ in range(rng.randint(1, 60))), "a") for k in range(400)]
    return rows + [(1000 + k, rows[5][1], "a") for k in range(80)] + [(None, rows[5][1], "a"), (7, rows[7][1], "a"), (2000, "\x00 -_-", "a")]


ITEMS = [(1, "abC dÉ7 a-b c"), (1, "abC dÉ7 a-b c"), (2, None), (3, ""), (4, "nowhere zzz"), (5, near_docs()[5][1]), (None, "ab"), (6, "one two three x"), (7, " ".join(t for _, t, _ in odd_rows()[20:24]))]


def found(frame):
    return sorted(map(tuple, frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("rows", [odd_rows(), near_docs()])
@pytest.mark.parametrize("settings", [{}, {"LEAF": 2, "BLOCK": 20, "RUN": 3, "BATCH_ITEMS": 4}])
def test_ranks_and_scores_are_exact(spark, monkeypatch, rows, settings):
    for name, value in settings.items():
        monkeypatch.setattr(lexical, name, value)
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id long, text string, doc_id string, score int")
    for top in (50, 3):
        assert found(lexical.lexical_search(table(spark, rows), items, top=top)) == brute(rows, ITEMS, top)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    centers = rng.integers(0, 2, (8, 60)) * rng.integers(100_000, 900_000, (8, 60))
    matrix = centers[rng.integers(0, 8, 500)] + rng.integers(0, 30_000, (500, 60))
    tree = lexical.BallTree(matrix, 8)
    assert sorted(tree.order) == list(range(500)) and (tree.matrix == matrix[tree.order]).all()
    own = [np.sort(rng.choice(60, 9, replace=False)) for _ in range(12)]
    queries = lexical.Queries(own, [rng.integers(1, 12_000, 9) for _ in own], 60)
    best = [[] for _ in own]
    leaves = lexical.search(tree, np.arange(60), list(range(500)), queries, best, 5)
    assert leaves < 0.8 * 12 * sum(not c for c in tree.children)
    for t, w, heap in zip(own, queries.weights, best):
        scores = matrix[:, t] @ w
        squares = np.bincount(t // lexical.RUN, w.astype(float) ** 2, 60 // lexical.RUN + 1)
        runs = np.flatnonzero(squares)
        bounds = tree.bounds(t, w, math.sqrt((w.astype(float) ** 2).sum()), runs, np.sqrt(squares[runs]))
        for node, (low, high) in enumerate(zip(tree.low, tree.high)):
            assert scores[tree.order[low:high]].max() <= bounds[node]
        wanted = sorted(((-s, i) for i, s in enumerate(scores.tolist()) if s > 0))[:5]
        assert sorted((-s, -i) for s, _, i in heap) == wanted


def test_empty_tables(spark, docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.lexical_search(no_docs, items).count() == 0
    assert lexical.lexical_search(docs, items.limit(0)).count() == 0


def test_query(spark, tmp_path):
    table(spark, near_docs()).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert found(lexical.op12_lexical_search(spark, str(tmp_path))) == brute(near_docs(), ITEMS)
