"""Token alignment against a plain version with the tokenizers' own libraries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import odd_rows, table
from tonelake.llm import align
from tonelake.llm.tokens import tokenizer_path

PATH_A, PATH_B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(PATH_A), sentencepiece.SentencePieceProcessor(model_file=PATH_B)
A.encode_special_tokens = True


def signs():
    """The bytes of byte-level signs, by what the library itself writes for single bytes."""
    shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    others = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(others)}}


SIGNS = signs()


def plain(text):
    """(A ids, B ids, groups, links) by comparing all ends."""
    if not text:
        return [], [], [], []
    ids_a, ids_b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    bytes_a = [bytes(SIGNS[c] for c in A.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, B.id_to_piece(i)) for i in ids_b)]
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return [], [], [], []
    ends = [[sum(len(x) for x in xs[: k + 1]) for k in range(len(xs))] for xs in (bytes_a, bytes_b)]
    links = [(ids_a[i], ids_b[j]) for i, x in enumerate(ends[0]) for j, y in enumerate(ends[1]) if x == y]
    groups, i, j = [], 0, 0
    for x in sorted(set(ends[0]) & set(ends[1])):
        p, q = ends[0].index(x) + 1, ends[1].index(x) + 1
        groups.append((ids_a[i:p], ids_b[j:q]))
        i, j = p, q
    return ids_a, ids_b, groups, links


def brute(rows):
    found = [(i, *plain(t)) for i, t, *_ in rows]
    counts = Counter(x for *_, links in found for x in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for i, ids_a, ids_b, groups, links in found:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(counts[x] == most[x[1]] for x in links)
        out.append((i, len(ids_a), len(ids_b), len(groups), len(links), best, sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if ids_a else ""))
    return sorted(out, key=str)


def short_rows():
    hard = ["a<|endoftext|>b c", "it's 'tis Bob's\nend.", "a   b \n c\n\n d", " lead", "trail ", "<s> </s> <unk> <0x41>", "tab\tnul\x00é é ﬁ ½", "▁a ▁▁ b", "漢字 と ☃ 🙂🙂", "  \xa0 x", "́", " ", "\n"]
    return [(k, t, "a") for k, t in enumerate(hard)] + [r for r in odd_rows() if len(r[1] or "") < 1500] + [(None, hard[1], "a"), (3, " lead", "a")]


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_rows_equal_the_plain_version(spark, tmp_path):
    rows = short_rows()
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = align.op13_token_alignment(spark, str(tmp_path)).select(*NAMES).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t'sab.,é²1\x1c\x85\xa0…!漢<|>▁\x00", max_size=40))
def test_ids_and_groups_of_any_text(text):
    (ids_a, ids_b), wanted = next(align.pair(PATH_A, PATH_B).encode([text])), plain(text)
    assert (list(ids_a), list(ids_b)) == wanted[:2]


def test_very_long_text_and_empty_table(spark, docs, no_docs):
    rows = {r["doc_id"]: r for r in align.align_tokens(docs, PATH_A, PATH_B).collect()}
    long = next(t for i, t, _ in odd_rows() if i == 4)
    assert rows[4]["n_a"] == len(A.encode(" " + long).ids) and rows[4]["n_b"] == len(B.encode(long))
    assert (rows[1]["n_a"], rows[1]["groups_sha256"], rows[1]["count_sum"]) == (0, "", 0)
    assert align.align_tokens(no_docs, PATH_A, PATH_B).count() == 0


def test_empty_tokens_link_with_all_that_end_there():
    ends_a, ends_b = [2, 2, 5], [2, 5, 5]
    keys, last_a, last_b = align.common_ends(ends_a, ends_b)
    assert (keys, last_a, last_b) == ([2, 5], [1, 2], [0, 2])
    assert align.links(ends_a, ends_b, keys, last_a, last_b) == ([0, 1, 2, 2], [0, 0, 1, 2])
    both = align.pair(PATH_A, PATH_B)
    out = align.laid_out(*(np.array(x) for x in ([1, 2, 3], [7, 8, 9], last_a, last_b)), both.n_a, both.n_b)
    assert "".join(both.names[out]) == "1,2|7;3|8,9;"


@pytest.mark.parametrize("vocabulary", [PATH_A])
def test_linked_tokens_end_alike(spark, docs, vocabulary):
    """The bound of distinct pairs: one token's bytes are the end of the other's."""
    both = align.pair(vocabulary, PATH_B)
    rows = align.aligned(docs, vocabulary, PATH_B, "doc_id", "text")
    from tonelake.llm.tokens import byte_tokens

    tokens = byte_tokens(vocabulary)
    for r in align.pair_counts(rows).collect():
        a, b = tokens[r["a"]], both.bytes_b[r["b"]]
        assert a.endswith(b) or b.endswith(a)
