"""Toxicity and quality rules: held-out accuracy and brute force."""

import random
import re
import zlib
from collections import Counter

from tests.llm.conftest import odd_rows, table
from tonelake.llm import rules, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def labelled(n=400):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    rows, marks = [], []
    for i in range(n):
        ws = [word() for _ in range(rng.randint(25, 120))]
        toxic, bad = i % 4 == 0, i % 5 == 1
        if toxic:
            for _ in range(4):
                ws.insert(rng.randrange(len(ws)), rng.choice(["idiot", "zorkoxa", "zorkobu", "you moron"]))
        if bad:
            ws = [w + "***" for w in ws]
        rows.append((i, " ".join(ws), "a"))
        marks.append((i, 0 if bad else 1, int(toxic)))
    return rows, marks


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_holds_on_unseen_rows(spark, tmp_path):
    rows, marks = labelled()
    path = str(tmp_path / "docs")
    table(spark, rows).write.parquet(path)
    docs, labels = spark.read.parquet(path), spark.createDataFrame(marks, LABELS)
    scored = toxicity.score_toxicity(docs, docs, labels, name="verdict")
    assert scored.columns == [*docs.columns, "verdict"]
    got = {r["doc_id"]: r["verdict"] for r in scored.collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.5) == bool(t) for i, _, t in marks if held_out(i)]
    assert sum(right) >= 0.95 * len(right)
    # Labels of held-out rows change nothing.
    turned = spark.createDataFrame([(i, q, 1 - t if held_out(i) else t) for i, q, t in marks], LABELS)
    again = {r["doc_id"]: r["verdict"] for r in toxicity.score_toxicity(docs, docs, turned, name="verdict").collect()}
    assert again == got


def test_toxicity_of_odd_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], LABELS)
    assert [r["s"] for r in toxicity.score_toxicity(docs, docs, none, ["doc_id"], name="s").select("s").distinct().collect()] == [0.0]
    odd = spark.createDataFrame([(4, 1, 1), (4, 1, 0), (5, None, None), (None, 1, 1), (999, 1, 0), (8, 1, 0), (20, 1, 0), (21, 1, 1)], LABELS)
    rows = toxicity.score_toxicity(docs, docs, odd, name="s").collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((i, t) for i, t, _ in odd_rows())
    assert toxicity.score_toxicity(no_docs, no_docs, odd, name="s").count() == 0


def test_words_behind_signs():
    known = toxicity._Words({"zorko-": 3.0})
    bits = lambda w: known[w] & 255
    assert bits("Idiot!!") & toxicity._LEX and bits("1d10t") & toxicity._LEX and bits("1d10t") & toxicity._OBFUSCATED
    assert not bits("idea") and known["zorkoxa"] >> 8 == 48 and bits("YOU") == toxicity._YOU | toxicity._CAPS


def counts(text):
    text = text or ""
    ws = WORD.findall(text)
    places = {}
    for i in range(len(ws) - 7):
        places.setdefault(tuple(ws[i : i + 8]), []).append(i)
    covered = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_statistics_against_brute_force(spark, docs, no_docs):
    w = " ".join("abcdefghijklmnop")
    extra = [(900, w, "a"), (901, w + " x " + w, "a"), (902, "q " * 40, "a"), (903, "a b\na b\n\n \na b\n c", "a"), (904, "é# 漢% |\n<>", "a"), (905, w + " " + w + " " + w[8:], "a"), (906, "a " * 8, "a"), (907, "a " * 9, "a")]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = rules.text_statistics(docs.unionAll(table(spark, extra))).select("doc_id", *names).collect()
    assert Counter(map(tuple, got)) == Counter((i, *counts(t)) for i, t, _ in [*odd_rows(), *extra])
    assert rules.text_statistics(no_docs).count() == 0


def test_rules_are_learned_and_hold(spark):
    rows, marks = labelled()
    stats = rules.text_statistics(table(spark, rows))
    found = rules.learn_quality_rules(stats, spark.createDataFrame(marks, LABELS))
    assert "symbol_share >" in found.text() and len(found.rules) == 1
    kept = {r["doc_id"]: r["kept"] for r in stats.select("doc_id", found.verdict().alias("kept")).collect()}
    assert all(kept[i] == bool(q) for i, q, _ in marks if held_out(i))


def test_no_labels_no_rules(spark, docs):
    stats = rules.text_statistics(docs)
    for marks in ([], [(4, 1, 0)], [(4, None, 0), (None, 0, 0)]):
        found = rules.learn_quality_rules(stats, spark.createDataFrame(marks, LABELS))
        assert found.rules == [] and stats.filter(~found.verdict()).count() == 0
