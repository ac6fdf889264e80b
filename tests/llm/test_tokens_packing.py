import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import odd_rows
from tonelake.llm import packing
from tonelake.llm.tokens import Encoder, TokenCache, count_tokens, tokenizer_path
from tonelake.session import work_path

PATH = tokenizer_path("byte_bpe_50k.json")
TOKENIZER, ENCODER = Tokenizer.from_file(PATH), Encoder(PATH)


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=" \n\t'sab.,é²1\x1c\x85\xa0…!漢<|>", max_size=40))
def test_chunks_give_the_librarys_ids(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)


@pytest.mark.parametrize("text", ["a<|endoftext|>b c", "it's 'tis Bob's\nend.\nNext, 'll", "a   b \n c\n\n d", " lead", "trail ", *[t for _, t, _ in odd_rows() if t][:12]])
def test_ids_of_hard_texts(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)


def test_cache_encodes_only_misses(spark, docs, no_docs):
    cache = TokenCache(spark, work_path(spark, "test-cache"))
    expected = Counter((i, len((t or "").encode()), len(ids(t))) for i, t, _ in odd_rows())
    for path in (PATH, PATH, tokenizer_path("word_bpe_49k.json")):
        got = Counter(map(tuple, count_tokens(docs, cache, path).collect()))
        if path == PATH:
            assert got == expected
    stored = spark.read.parquet(cache.path)
    distinct = len({t or "" for _, t, _ in odd_rows()})
    assert stored.count() == 2 * distinct and stored.distinct().count() == 2 * distinct
    assert count_tokens(no_docs, cache, PATH).count() == 0
    assert count_tokens(docs, cache, tokenizer_path("piece_bpe_32k.model")).count() == docs.count()


def test_whole_patterns_cover_and_fit():
    rng = np.random.default_rng(1)
    for n in (1, 5, 16):
        for _ in range(5):
            histogram = rng.integers(0, 40, n)
            used = packing.whole_patterns(histogram, 16)
            assert (sum((p * k for p, k in used), np.zeros(n, int)) == histogram).all()
            assert all((p * np.arange(1, n + 1)).sum() <= 16 for p, _ in used)
    histogram = np.zeros(16, int)
    histogram[[8, 6]] = 100  # lengths 9 and 7 fit together exactly
    assert sum(k for _, k in packing.whole_patterns(histogram, 16)) == 100


@pytest.mark.parametrize("seed,lengths", [(1, lambda r: r.integers(1, 9, 4000)), (2, lambda r: r.integers(1, 200, 20_000)), (3, lambda r: np.full(5000, 17)), (4, lambda r: r.integers(1, 2049, 20_000)),
                                           (5, lambda r: np.minimum(2048, r.lognormal(6, 1.2, 20_000).astype(int) + 1)), (6, lambda r: np.full(100, 2048))])
def test_padding_is_low_for_any_lengths(seed, lengths):
    lengths, sizes = lengths(np.random.default_rng(seed)), packing.class_sizes()
    assert sizes[-1] == 2048 and (np.diff(sizes) > 0).all()
    histogram = np.bincount(np.searchsorted(sizes, lengths), minlength=len(sizes))
    patterns = packing.all_patterns(histogram, 2048, sizes)
    assert (sum(p * n for p, n in patterns) == histogram).all() and all((p * sizes).sum() <= 2048 for p, _ in patterns)
    assert lengths.sum() / (2048 * sum(n for _, n in patterns)) > 0.95


def test_packing_of_short_texts(spark):
    rows = spark.createDataFrame([(i, "word " * (i % 8)) for i in range(4000)], "doc_id long, text string")
    out = packing.pack_documents(rows, PATH).collect()
    total, used = sum(r["length"] for r in out), len({r["sequence_id"] for r in out})
    assert total == sum(len(ids("word " * (i % 8))) + 1 for i in range(4000)) and total / (2048 * used) > 0.95


def test_packing_is_whole_and_tight(docs, no_docs):
    rows = packing.pack_documents(docs, PATH, with_ids=True).collect()
    whole = Counter()
    for i, t, _ in odd_rows():
        whole[i, tuple(ids(t) + [1])] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 1 <= r["length"] <= 2048 and len(r["ids"]) == r["length"]
        assert zlib.crc32(np.asarray(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], tuple(r["ids"])))
    for (i, n), found in pieces.items():
        originals = [(k, c) for k, c in whole.items() if k[0] == i and len(k[1]) == n]
        assert sum(len(p) for _, p in found) == sum(n * c for _, c in originals)
        assert all(any(k[1][s : s + len(p)] == p for k, _ in originals) for s, p in found)
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= 1.2 * total / 2048 + 1
    assert packing.pack_documents(no_docs, PATH).count() == 0
