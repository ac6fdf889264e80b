"""The opN queries themselves, on small folders with odd rows: all columns of each contract against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import odd_rows, table
from tests.llm.test_copies import brute as jaccard_brute
from tests.llm.test_learned import LABELS, counts, held_out, labelled
from tests.llm.test_scans import PII, base_pii, base_secrets
from tests.llm.test_spread import water_level
from tests.llm.test_tokens_packing import ids
from tonelake.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of_folder():
    rows, _ = labelled(120)
    extra = [(5000, "password = hunter2hunter é " + "ab" * 14, "b"), (5001, "mail a@b.co or 10.0.0.1, card 4111 1111 1111 1111, call +49 30 1234567", None), (5002, "<|endoftext|> it's", "a"), (5003, "x y\nx y\n" * 30, "c")]
    return [*((1000 + i, t, s) for i, t, s in rows), *odd_rows(), *extra]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    table(spark, rows_of_folder()).repartition(3).write.parquet(str(path / "documents.parquet"))
    marks = [(1000 + i, q, t) for i, q, t in labelled(120)[1]] + [(5, None, None), (None, 1, 1), (99, 0, 0)]
    spark.createDataFrame(marks, LABELS).write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, "one two three"), (2, None)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    vectors = [(i, [((i * 7 + k * k * (i + 3)) % 17 - 8) / 8 for k in range(64)], 0) for i in range(12)] + [(None, [0.1] * 64, 0), (50, None, 1), (51, [], 1), (3, [((3 * 7 + k * k * 6) % 17 - 8) / 8 for k in range(64)], 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(path / "embeddings.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def empty_folder(spark, folder, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "benchmark", "embeddings"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(path / f"{name}.parquet"))
    return str(path)


def run(spark, folder, number):
    name = next(n for n in QUERIES if n.startswith(f"op{number}_"))
    return [r.asDict(recursive=True) for r in QUERIES[name](spark, folder).collect()]


def per_document(got, wanted, *columns):
    """Rows of a query against (doc_id, text) -> values, repeated rows and rows without id included."""
    assert Counter((r["doc_id"], *(r[c] for c in columns)) for r in got) == Counter((i, *wanted(i, t or "")) for i, t, _ in rows_of_folder())


@pytest.mark.parametrize("number", range(1, 14))
def test_empty_tables(spark, empty_folder, number):
    assert run(spark, empty_folder, number) == []


def test_op1(spark, folder):
    got = run(spark, folder, 1)
    groups = defaultdict(set)
    for r in got:
        groups[r["class_id"]].add(r["media_id"])
        assert r["n_points"] >= 0
    assert Counter(r["media_id"] for r in got) == Counter([2 * i for i in range(12)] + [6] + [2 * i + 1 for i in (0, 5, 10)])
    assert all(c == min(g) for c, g in groups.items()) and all({2 * i, 2 * i + 1} <= next(g for g in groups.values() if 2 * i in g) for i in (0, 5, 10))


def test_op2(spark, folder):
    got = run(spark, folder, 2)
    per_document(got, lambda i, t: (i is None or held_out(i),), "held_out")
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    toxic = {1000 + i for i, _, t in labelled(120)[1] if t}
    assert sum((r["doc_id"] in toxic) == r["predicted"] for r in got if r["doc_id"] and 1000 <= r["doc_id"] < 1120) >= 114


def test_op3(spark, folder):
    for _ in range(2):  # the second run meets the counts of the first
        got = run(spark, folder, 3)
        per_document(got, lambda i, t: (len(t.encode()), len(ids(t)), len(ids(t)) > 1024), "n_bytes", "n_tokens", "over_limit")


def test_op4(spark, folder):
    got = run(spark, folder, 4)

    def wanted(i, t):
        base = base_secrets(t)
        kinds = Counter(k for k, _, _ in base)
        return kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()

    per_document(got, wanted, "n_assign", "n_access", "n_hex", "base_sha256")
    texts = {i: t or "" for i, t, _ in rows_of_folder()}
    for r in got:
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        assert set(base_secrets(texts[r["doc_id"]])) <= set(spans) and [a for _, a, _ in spans] == sorted(a for _, a, _ in spans)


def test_op5(spark, folder):
    got = run(spark, folder, 5)
    pieces, sequences = Counter(), defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    wanted = Counter()
    for i, t, _ in rows_of_folder():
        whole = [*ids(t or ""), 1]
        for s in {s for d, s, *_ in pieces if d == i}:
            n = next(n for d, start, n, _, total in pieces if (d, start, total) == (i, s, len(whole)))
            wanted[i, s, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in whole[s : s + n])), len(whole)] += 1
    assert pieces == wanted and sum(n * k for (_, _, n, _, _), k in pieces.items()) == sum(len(ids(t or "")) + 1 for _, t, _ in rows_of_folder())
    for parts in sequences.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048


def test_op6(spark, folder):
    got = run(spark, folder, 6)
    per_document(got, lambda i, t: (len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", None), "size", "text_crc32", "law", "grown_shard")
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
    assert set(shards) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    sizes = [len(shards[k]) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1


def test_op7(spark, folder):
    got = run(spark, folder, 7)
    rows, sizes, taken = rows_of_folder(), Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    target, of = water_level(sizes), defaultdict(set)
    for i, _, s in rows:
        of[i].add(s)
    per_document(got, lambda i, t: (len(WORD.findall(t)),), "size")
    for r in got:
        source = next(s for s in of[r["doc_id"]] if sizes[s] == r["source_size"])
        taken[source] += r["taken"]
        assert r["target"] == pytest.approx(target[source]) and r["taken"] <= 3 * r["size"] and r["taken"] == sum(d["words"] for d in r["draws"])
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_op8(spark, folder):
    got = run(spark, folder, 8)
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == jaccard_brute(rows_of_folder())


def test_op9(spark, folder):
    got = run(spark, folder, 9)

    def wanted(i, t):
        n, *others = counts(t)
        return n, *others, n < 20 or 100 * others[-1] > 30 * n

    per_document(got, wanted, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert not any(r["kept"] and r["base_failed"] for r in got) and any(r["kept"] for r in got)


def test_op10(spark, folder):
    got = run(spark, folder, 10)

    def wanted(i, t):
        base = sorted(base_pii(t), key=lambda s: ([k for k, _ in PII].index(s[0]), s[1]))
        kinds = Counter(k for k, _, _ in base)
        return *(kinds[k] for k, _ in PII), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()

    per_document(got, wanted, "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    texts = {i: t or "" for i, t, _ in rows_of_folder()}
    for r in got:
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        assert set(base_pii(texts[r["doc_id"]])) <= set(spans) and r["n_spans"] == len(spans)
