"""Secrets and personal data against brute force."""

import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tonelake.llm import pii, secrets
from tonelake.llm.pii import KINDS

BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)),
        ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+"))]


def base_secrets(text):
    ok = {"assign": lambda m: len(m.group(2)) >= 6, "access": lambda m: len(m.group()) >= 20, "hex": lambda m: len(m.group()) >= 24}
    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE) for m in p.finditer(text or "") if ok[kind](m)]
    return [(BASE[k][0], a, b) for a, k, b in sorted(found)]


def base(spans):
    return [(s["kind"], s["start"], s["end"]) for s in spans if s["kind"] != "entropy"]


SECRETS = ["token = 'abc12' password: longer1", 'API_KEY="0123456789abcdef0123456789abcdef"', "AKIA" + "A" * 15, "xAKIA" + "B7" * 9 + " é " + "deadbeef" * 4,
           "Kpassword=abcdefgh toKen=ſſſſſſ", "secret=" + "z" * 6 + "secret=short", "a" * 30 + "g" + "b" * 24, "passwd  =  " + "q9" * 40]


@pytest.mark.parametrize("text", SECRETS)
def test_base_secrets_are_found(text):
    assert [(secrets.KINDS[k], a, b) for a, k, b in secrets.SecretScanner().scan(text) if k < 3] == base_secrets(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="pasword=: '\"tokenAKI019afZ\n\xa0 ", max_size=120))
def test_base_secrets_of_any_text(text):
    assert [(secrets.KINDS[k], a, b) for a, k, b in secrets.SecretScanner().scan(text) if k < 3] == base_secrets(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdefg0123456789", max_size=80))
def test_incremental_entropy_equals_the_plain_one(run):
    import math
    from collections import Counter

    window, bits = 12, 2.9
    plain = []
    for i in range(len(run) - window + 1):
        shares = [n / window for n in Counter(run[i : i + window]).values()]
        if -sum(p * math.log2(p) for p in shares) >= bits - 1e-9:
            plain.append((i, i + window))
    assert secrets.entropy_windows(run, window, bits) == secrets.joined(plain)


def test_entropy_finds_keys_and_leaves_words_and_ids():
    scan = secrets.SecretScanner().scan
    assert [k for _, k, _ in scan("key is q8ZrT4kLw0PzX7vNm2Bd here")] == [3]
    for harmless in ("thisisaverylongwordwithoutanynumbers", "123e4567-e89b-12d3-a456-426614174000", "1234567890123456789012", "example_q8ZrT4kLw0PzX7vNm2Bd", "release-notes-of-version-2024"):
        assert scan(harmless) == []


def test_scan_of_odd_tables(spark, docs, no_docs):
    rows = secrets.scan_secrets(docs).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(base(r["secrets"]) == base_secrets(texts[r["doc_id"]]) for r in rows)
    assert secrets.scan_secrets(no_docs).count() == 0
    hidden = spark.createDataFrame([(1, "token = abcdefgh end"), (2, None), (3, "clean")], "doc_id long, text string")
    assert [r["text"] for r in secrets.redact_secrets(hidden).orderBy("doc_id").collect()] == ["[SECRET] end", None, "clean"]


PII = [("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
       ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))]


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_pii(text):
    out = []
    for kind, pattern in PII:
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


PEOPLE = ["a@b.c_x@d.e", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "x@y", "++49 (30) 1234 5678 9", "4111 1111-1111 1111 11", "4111-1111-1111-1111", "a" * 60_000 + "@b.co", "1" * 30_000,
          "é4111111111111111 é a@b.c a@b.c 1.2.3.4", None, "", "a@b.c a@b.cc a@b.c", "999.1.1.1 255.255.255.255", "4111111111111111 4111111111111111", "1-" * 20_000 + "1", "0.0.0.0" * 50]


def test_base_spans_of_odd_texts(spark):
    source = spark.createDataFrame(list(enumerate(PEOPLE)), "doc_id long, text string")
    for row in pii.find_candidates(source).collect():
        assert [(KINDS[s["k"]], s["start"], s["end"]) for s in row["base"]] == base_pii(PEOPLE[row["doc_id"]])


#: The generators as Python patterns (atomic groups for possessive quantifiers).
WIDE = {
    "mail": r"(?<!\S)(?>[^\s@<>()\[\]]{1,64})\s?(?:@|\(at\)|\[at\])\s?(?>[^\s@<>()\[\]]{1,255})",
    "number": r"(?<![0-9])[+(]?[0-9](?>(?:[\x20().\-/]{0,2}[0-9]){6,})",
    "dotted": r"(?<![0-9.:])(?>[0-9]{1,6})(?>(?:[.:](?>[0-9]{1,6})){2,})",
}
HARD = ["x" * 70 + "@host.de " + "x" * 64 + "@host.de", "1234567.8.9.1 and 567.8.9", "a (at) b.co c@d é@f.g a@b@c d@e", "1:2:3.4 :1.2.3 1.2.3:4", "(030) 123 45-67/8 +1.2.3.4.5.6.7 00000000", "😀 m@x.yz 1.2.3 😀1.2.3.4"]


def random_texts(n=150):
    import random

    rng = random.Random(9)
    bits = ["a", "é", " ", "@", ".", ":", "1", "23", "456", "-", "(at)", "(", ")", "+", "b.co", "4111 1111 1111 1111", "\n", "😀", "8.8.8.8"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_generators_propose_what_python_finds(spark):
    texts = [*HARD, *random_texts(), *[t or "" for t in PEOPLE if len(t or "") < 3000]]
    rows = pii.find_candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for row in rows:
        text, base = texts[row["doc_id"]], base_pii(texts[row["doc_id"]])
        wanted = []
        for generator, pattern in WIDE.items():
            for m in re.finditer(pattern, text):
                digits = len(re.sub("[^0-9]", "", m.group()))
                kind = {"mail": "email", "dotted": "ip"}.get(generator, "card" if digits >= 13 else "phone")
                shared = [(k, min(m.end(), e) - max(m.start(), s), max(m.end() - m.start(), e - s)) for k, s, e in base]
                wanted.append((kind, m.start(), m.end(), any(k == kind and 2 * n >= size for k, n, size in shared), all(n <= 0 for _, n, _ in shared)))
        assert [(KINDS[c["k"]], c["start"], c["end"], c["label"], c["clear"]) for c in row["found"]] == wanted, text
        assert [(KINDS[s["k"]], s["start"], s["end"]) for s in row["base"]] == base


def test_a_text_of_contact_data_takes_seconds(spark):
    import time

    text = " ".join(f"u{i}@host{i}.de 10.{i % 256}.3.4 +49 30 {1000000 + i}" for i in range(7000))
    source = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    row = pii.find_candidates(source).first()
    assert time.time() - start < 60 and len(row["found"]) > 20_000
    assert [(KINDS[s["k"]], s["start"], s["end"]) for s in row["base"]] == base_pii(text)


def test_overlapping_spans_leave_the_better_one(spark):
    class Model(pii.SpanModel):
        def score(self, f):
            return f[0]

    schema = "doc_id long, base array<struct<k:int,start:int,end:int>>, found array<struct<k:int,start:int,end:int,f:array<double>,clear:boolean>>"
    found = [(0, 0, 10, [0.6], True), (1, 5, 12, [0.9], True), (2, 12, 15, [0.5], True), (3, 14, 20, [0.7], True), (3, 30, 40, [0.2], True), (0, 50, 60, [0.9], False)]
    rows = spark.createDataFrame([(1, [(0, 55, 58)], found), (2, [], [])], schema)
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.select_spans(rows, Model([(1.0, 0.0)], [0.4] * 4)).collect()}
    assert got == {1: [(0, 55, 58), (1, 5, 12), (3, 14, 20)], 2: []}


def test_trees_add_what_looks_alike(spark):
    card = lambda i: (d := f"4{i:014d}") + next(c for c in "0123456789" if luhn(d + c))
    texts = [f"pay with card {card(i * 977)} now" for i in range(150)] + [f"order number {i * 7919 + 10**8} was sent" for i in range(150)]
    texts += ["pay with card 4111.1111.1111.1111 now"]
    source = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find_candidates(source).cache()
    model = pii.learn_spans(found.filter("doc_id < 300"), least=5, precision=0.9)
    rows = {r["doc_id"]: r for r in pii.select_spans(found, model).collect()}
    assert [(KINDS[s["k"]], s["start"], s["end"]) for s in rows[300]["spans"]] == [("card", 14, 33)]
    for i, text in enumerate(texts[:300]):
        assert [(KINDS[s["k"]], s["start"], s["end"]) for s in rows[i]["base"]] == base_pii(text)
        assert set(map(tuple, rows[i]["base"])) <= set(map(tuple, rows[i]["spans"]))
        assert i < 150 or not rows[i]["spans"]


def test_every_candidate_is_learned_from(spark):
    """A kind that is rare among very many candidates has enough of them kept apart to get its threshold."""
    card, ip = [[float(j == i) for j in range(len(pii.FEATURES))] for i in (3, 5)]
    array = lambda f: f"array({', '.join(f'{x}D' for x in f)})"
    one = lambda k, f, label: f"named_struct('k', {k}, 'start', 0, 'end', 9, 'f', {f}, 'label', {label}, 'sure', true)"
    found = spark.range(0, 60_000, 1, 4).selectExpr(
        "id AS doc_id", f"array(CASE WHEN id % 750 = 0 THEN {one(1, array(ip), 'true')} ELSE {one(2, array(card), 'id % 2 = 0')} END) AS found")
    model = pii.learn_spans(found)
    assert model.trees and model.thresholds[1] <= 1 and model.thresholds[2] > 1  # 80 of kind 1, of which 20 or more are apart


def test_pii_of_odd_tables(docs, no_docs, spark):
    assert pii.find_pii(docs).count() == docs.count()
    assert pii.find_pii(no_docs).count() == 0
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("mail a@b.c or +1 (234) 555-0199.",)], "text string")
    masked = d.select(pii.redact(F.col("text"), pii.base_spans(F.col("text"))).alias("t")).first()["t"]
    assert masked == "mail [PII] or [PII]."


def test_fold_of_ids():
    assert zlib.crc32(b"123") % 5 == zlib.crc32(str(123).encode()) % 5
