"""The stages of the pipeline against brute force, one at a time."""

from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_copies import brute
from tests.llm.test_learned import LABELS, labelled
from tests.llm.conftest import table
from tonelake.llm.secrets import SecretScanner, joined
from tonelake.session import settle


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, marks = labelled()
    rows = [(i, t + (" token = abcdef123456" if i % 9 == 0 else ""), "ab"[i % 3 == 0]) for i, t, _ in rows]
    rows += [(1000 + i, rows[i][1], "b") for i in range(1, 40, 2)]
    table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, LABELS).write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, folder), f"test-{name}")
        out.append(docs)
    return rows, marks, out, folder


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def test_stages(spark, stages):
    rows, marks, (calm, single, safe, mixed, packed), folder = stages
    toxic = {i for i, _, t in marks if t} | {1000 + i for i, _, t in marks if t}
    kept = pairs(calm)
    assert set(kept) <= set(rows)
    assert len({i for i, _, _ in kept} & toxic) <= 3 and len({i for i, _, _ in rows} - toxic - {i for i, _, _ in kept}) <= 3
    assert {i for i, _, _ in pairs(single)} == {c for _, c, _ in brute(kept)}
    scanner = SecretScanner()
    for (i, before, _), (j, after, _) in zip(sorted(pairs(single)), sorted(pairs(safe))):
        for a, b in reversed(joined([(a, b) for a, _, b in scanner.scan(before)])):
            before = before[:a] + "[SECRET]" + before[b:]
        assert (i, before) == (j, after)
    assert "[SECRET]" in " ".join(t for _, t, _ in pairs(safe))
    drawn = Counter(pairs(mixed))
    assert set(drawn) <= set(pairs(safe)) and max(drawn.values()) <= 3
    for df in (calm, single, safe, mixed):
        assert df.columns == calm.columns
    from tests.llm.test_tokens_packing import ids

    assert packed.agg({"length": "sum"}).first()[0] == sum((len(ids(t)) + 1) * n for (_, t, _), n in drawn.items())
    assert corpus_pipeline.run(spark, folder).columns == packed.columns
