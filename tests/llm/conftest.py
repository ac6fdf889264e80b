import random

import pytest

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, label string, key string, size long, shard int, slot long, row string, features string, node long, words string, score double, _bin int"


def table(spark, rows):
    """Documents with columns whose names the operators use inside: rows of (doc_id, text, source)."""
    full = [(i, t, s, "en", len(t or ""), "x", "y", 7, 3, 5, "r", "f", 9, "w", 0.1, 2) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    long, copy = text(20_000), text(120)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, long, "b"), (5, copy, "b"), (5, copy, "b"), (6, copy, None), (7, copy + " end", "c"),
            (8, "one two three", "c"), (9, "one two three", "c"), (None, text(60), "a"), (10, "x" * 50_000, "a"), (11, "Ünï ☃ 漢字 " * 30, "b")]
    return rows + [(20 + i, text(rng.randint(1, 300)), rng.choice(["a", "b", None])) for i in range(60)]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    table(spark, odd_rows()).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return table(spark, [(1, "x", "a")]).limit(0)
