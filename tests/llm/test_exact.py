"""Exact groups against a dictionary of normalised texts."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import odd_rows, table
from tonelake.llm import exact

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[SPACES.sub(" ", t or "")].append(i)
    out = []
    for members in groups.values():
        ids = [i for i in members if i is not None]
        keep = min(ids) if ids else None
        out += [(i, keep, len(members)) for i in members]
    return sorted(out, key=str), len(groups)


def copies():
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["ab", "é", "漢字", "", "x\ty"]) for _ in range(rng.randint(0, 40))) for _ in range(12)]
    space = lambda t: re.sub(" ", lambda _: rng.choice([" ", "\n", " \t ", "\r\n"]), t)
    rows = [(k, space(rng.choice(texts)), "a") for k in range(120)]
    return rows + [(None, texts[0], "a"), (None, "alone", "a"), (7, rows[7][1], "a"), (7, "another text of id 7", "a"), (500, "\n\n", "a"), (501, " ", "a"), (502, "", "a")]


@pytest.mark.parametrize("rows", [odd_rows(), copies()])
@pytest.mark.parametrize("primes,chunk", [(exact.PRIMES, exact.CHUNK), (exact.PRIMES, 16), ((5, 7, 2, 3), 16), ((2, 2, 2, 2), 64)])
def test_groups_are_those_of_equal_texts(spark, rows, primes, chunk):
    docs = table(spark, rows)
    got = exact.exact_groups(docs, carry={"key": docs["text"]}, primes=primes, chunk=chunk).collect()
    wanted, n_groups = brute(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == wanted
    kept = [r for r in got if r["kept"]]
    assert len(kept) == n_groups and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert len({SPACES.sub(" ", r["key"] or "") for r in kept}) == n_groups
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(t)
    assert all(r["key"] in texts[r["doc_id"]] for r in got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tabé", max_size=30), min_size=1, max_size=5), st.integers(1, 9))
def test_fingerprints_compose(parts, chunk):
    """Whatever way a text is cut, its chunks combine to the polynomial of its normal form."""
    polynomial, text = exact.Polynomial(chunk=64), "".join(parts).encode()
    rows = []
    for at in range(0, max(1, len(text)), chunk):
        part = text[at : at + chunk]
        data, starts = exact.single_spaces(np.frombuffer(part, np.uint8), np.array([0, len(part)]))
        rows.append((polynomial.of_parts(data, starts)[0].tolist(), len(data), bytes(data[:1]) == b" ", bytes(data[-1:]) == b" "))
    normal = re.sub(rb"[\x20\x09-\x0D]+", b" ", text)
    wanted = [sum(c * pow(b, len(normal) - 1 - i, p) for i, c in enumerate(normal)) % p for p, b in zip(polynomial.primes, polynomial.bases)]
    assert polynomial.combine(rows) == (wanted, len(normal))


def test_empty_table(no_docs):
    assert exact.exact_groups(no_docs).count() == 0


def test_query(spark, tmp_path):
    rows = odd_rows() + copies()
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = exact.op11_exact_dedup(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == brute(rows)[0]
    normal = {hashlib.sha256(SPACES.sub(" ", t or "").encode()).hexdigest() for _, t, *_ in rows}
    assert {r["text_sha256"] for r in got} == normal == {r["text_sha256"] for r in got if r["kept"]}
    assert len([r for r in got if r["kept"]]) == len(normal)
