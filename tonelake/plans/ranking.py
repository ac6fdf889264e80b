"""Scoring a batch of prompts against a catalog, and the ranked playlists.

A prompt is defined to be scored against every song, so the work is songs x prompts. What moves is
kept small: prompts come in bounded batches that travel with the tasks, songs stay where they are read
and are scored in blocks, and a task hands on as many rows of a prompt as it wants. A block's two
similarities come first; a song that no prompt could still rank, even if all its other signals were
perfect, is not scored further.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tonelake.functions.numbers import stable_round_array
from tonelake.functions.vectors import similarity, similarity_bounds, vector_matrix
from tonelake.plans import signals as sig
from tonelake.plans.prompt import SIGNALS, with_weights
from tonelake.rules import Rulebook, default_rulebook

MAX_BATCH = 4096  # prompts scored in one pass over the songs
MAX_KEPT = 1 << 21  # rows that a task may hold back for them
MERGE_PARTS = 32  # parts of a prompt's rows that are cut to its limit before they meet
CELLS = 1 << 20  # pairs of a block
_WITH, _WITHOUT = "_weights_with_clap", "_weights_without_clap"


class BatchTooLarge(ValueError):
    pass


class Batch:
    """A bounded batch of prompts, held by the driver: vectors as matrices in batch order, and the plans."""

    def __init__(self, plans: DataFrame, max_batch: int = MAX_BATCH, rules: Rulebook | None = None):
        rules = rules or default_rulebook()
        for name, has_clap in ((_WITH, "true"), (_WITHOUT, "false")):
            plans = with_weights(plans, has_clap, rules).withColumnRenamed("weights", name)
        table = plans.limit(max_batch + 1).toArrow()
        limits = table["limit"].to_pylist()
        if table.num_rows > max_batch or (len(limits) > 1 and sum(limits) > MAX_KEPT):
            raise BatchTooLarge(f"more than {max_batch} prompts or {MAX_KEPT} rows in a batch")
        self.id_type = plans.schema["query_id"].dataType
        self.ids = table["query_id"].to_pylist()
        if len(set(self.ids)) < len(self.ids):
            raise ValueError("a query_id comes more than once")
        self.limits = np.array(limits, np.int64)
        self.text = self._matrix(table, "query_vec")
        self.clap = self._matrix(table, "clap_vec")
        missing = lambda name: [v is None for v in table[name].to_pylist()] if name in table.column_names else [True] * len(self.ids)
        if any(missing("query_vec")):
            raise ValueError("every prompt needs a query_vec")
        self.has_clap = ~np.array(missing("clap_vec"), bool)
        self.plans = table.select(["profile", "emotions", "genres", "negated", _WITH, _WITHOUT]).to_pylist()

    @staticmethod
    def _matrix(table, name: str) -> np.ndarray | None:
        rows = table[name].to_pylist() if name in table.column_names else []
        lengths = {len(v) for v in rows if v is not None}
        if not lengths:
            return None
        if len(lengths) > 1:
            raise ValueError(f"{name} of lengths {sorted(lengths)}")
        matrix = np.array([v if v is not None else [0.0] * max(lengths) for v in rows], "float64")
        if not np.isfinite(matrix).all():
            raise ValueError(f"{name} with a component that is not finite")
        return matrix


def prompt_batches(plans: DataFrame, max_batch: int = MAX_BATCH, rules: Rulebook | None = None) -> list[Batch]:
    """All prompts, in batches that :class:`Batch` takes: one if they fit, else hash parts."""
    try:
        return [Batch(plans, max_batch, rules)]
    except BatchTooLarge:
        parts = -(-plans.count() // max_batch)
    if not plans.groupBy("query_id").count().filter("count > 1").isEmpty():
        raise ValueError("a query_id comes more than once")
    while True:
        part = F.pmod(F.xxhash64("query_id"), F.lit(parts))
        sizes = plans.groupBy(part).agg(F.count("*").alias("n"), F.sum("limit").alias("kept"))
        if sizes.filter((F.col("n") > max_batch) | ((F.col("n") > 1) & (F.col("kept") > MAX_KEPT))).isEmpty():
            return [Batch(plans.filter(part == i), max_batch, rules) for i in range(parts)]
        parts *= 2


class Scorer:
    """All that a task needs to score songs for a batch: matrices, similarity bounds and weights."""

    def __init__(self, songs: DataFrame, batch: Batch, rules: Rulebook):
        self.text, self.limits, self.ids = batch.text, batch.limits, batch.ids
        self.clap = batch.clap if "clap_embedding" in songs.columns else None
        signals = {"sem": ("embedding", self.text, True)}
        if self.clap is not None:
            signals["clap"] = ("clap_embedding", self.clap, False)
        n = len(batch.ids)
        self.low, self.high = {}, {}
        rows = similarity_bounds(songs.filter(F.col("embedding").isNotNull()), signals, "embedding").collect()
        for name in ("sem", "clap"):
            self.low[name], self.high[name] = np.full(n, np.nan), np.full(n, np.nan)
            for r in rows if name in signals else []:
                self.low[name][r["pos"]], self.high[name][r["pos"]] = (r[f"{name}_{e}"] if r[f"{name}_{e}"] is not None else np.nan for e in ("low", "high"))
        # The audio signal counts only if the prompt has a vector and some song has one.
        self.low["clap"][~batch.has_clap] = np.nan
        active = ~np.isnan(self.low["clap"])
        self.weights = {s: np.array([p[_WITH if a else _WITHOUT][s] for p, a in zip(batch.plans, active)]) for s in SIGNALS}
        self.rest = self.weights["features"] + self.weights["genre"] + self.weights["emotion"]
        self.song_signals = sig.SongSignals(batch.plans, rules)
        self.features, self.emotions, self.n_genres = rules.features, rules.emotions, len(rules.genres)
        self.rows = max(64, min(4096, CELLS // n))

    def inputs(self, songs: DataFrame, rules: Rulebook) -> DataFrame:
        """The columns that tasks read: a row of numbers per song, and its vectors."""
        clap = F.col("clap_embedding") if self.clap is not None else F.lit(None).cast("array<float>").alias("clap_embedding")
        return songs.filter(F.col("embedding").isNotNull()).select(
            F.col("id").alias("song_id"), *sig.song_inputs(rules), sig.song_genres(rules).alias("song_genres"), "embedding", clap
        )

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, self.rows):
                block = batch.slice(at, self.rows)
                if block.num_rows:
                    yield block

    def similarities(self, block: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Which songs have a usable text vector, and of those both similarities and their positions in their range."""
        rows, good = vector_matrix(block.column("embedding"), self.text.shape[1])
        found = {"semantic": similarity(rows, self.text, True)}
        found["clap"] = np.full(found["semantic"].shape, np.nan)
        if self.clap is not None:
            rows, usable = vector_matrix(block.column("clap_embedding"), self.clap.shape[1])
            found["clap"][usable[good]] = similarity(rows[good[usable]], self.clap, False)
            found["clap"][:, np.isnan(self.low["clap"])] = np.nan
        for name, source in (("norm_semantic", "sem"), ("norm_clap", "clap")):
            found[name] = sig.min_max(found[name.removeprefix("norm_")], self.low[source], self.high[source])
        return np.flatnonzero(good), found

    def ceiling(self, found: dict[str, np.ndarray]) -> np.ndarray:
        """No score is above: the similarities' part, and all of what the other signals could add."""
        return 100.0 * (self.weights["semantic"] * found["norm_semantic"] + self.weights["clap"] * found["norm_clap"] + self.rest) + 1e-3

    def complete(self, block: pa.RecordBatch, at: np.ndarray, found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """All signals and the scores of the songs ``at``, whose similarities are ``found``."""
        songs = block.take(pa.array(at))
        column = lambda name: songs.column(name).to_numpy(zero_copy_only=False).astype("float64")
        genres = np.zeros((len(at), self.n_genres))
        lists = songs.column("song_genres")
        genres[np.repeat(np.arange(len(at)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = 1.0
        out = found | self.song_signals.of({f: column(f"f_{f}") for f in self.features}, {e: column(f"e_{e}") for e in self.emotions}, genres)
        value = {"semantic": "norm_semantic", "clap": "norm_clap", "features": "features", "genre": "genre", "emotion": "emotion"}
        total = sum(self.weights[s] * out[value[s]] for s in SIGNALS)
        out["score"] = stable_round_array(np.clip(100.0 * (total - out["penalty"]), 0.0, 100.0), 4)
        out["semantic_score"] = stable_round_array(out["semantic"] * 100.0, 4)
        return out


def _song_ids(block: pa.RecordBatch) -> np.ndarray:
    return block.column("song_id").to_numpy()


def _pairs_schema(inputs: DataFrame, batch: Batch, more: str) -> str:
    return f"query_id {batch.id_type.simpleString()}, song_id {inputs.schema['song_id'].dataType.simpleString()}, {more}"


PAIR_COLUMNS = ["semantic", "clap", "norm_semantic", "norm_clap", "features", "genre", "emotion", "penalty", "score", "semantic_score"]


def score_batch(songs: DataFrame, batch: Batch, rules: Rulebook | None = None) -> DataFrame:
    """One row per (prompt, song): ids, the signals, ``score`` (0-100) and the plain similarity in percent."""
    rules = rules or default_rulebook()
    scorer = Scorer(songs, batch, rules)
    inputs, id_type = scorer.inputs(songs, rules), to_arrow_type(batch.id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in scorer.blocks(batches):
            at, found = scorer.similarities(block)
            out = scorer.complete(block, at, found)
            n = len(scorer.ids)
            columns = [pa.array(scorer.ids * len(at), id_type), pa.array(np.repeat(_song_ids(block)[at], n))]
            columns += [pa.array(out[c].ravel(), mask=np.isnan(out[c].ravel())) for c in PAIR_COLUMNS]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "song_id", *PAIR_COLUMNS])

    return inputs.mapInArrow(run, _pairs_schema(inputs, batch, ", ".join(f"{c} double" for c in PAIR_COLUMNS)))


def score_summary(songs: DataFrame, batch: Batch, rules: Rulebook | None = None) -> DataFrame:
    """Per prompt the number of ``songs``, and the ``total`` and ``best`` of their scores; a task hands on one row per prompt."""
    rules = rules or default_rulebook()
    scorer = Scorer(songs, batch, rules)
    inputs, id_type = scorer.inputs(songs, rules), to_arrow_type(batch.id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, best = 0, np.zeros(len(scorer.ids)), np.full(len(scorer.ids), -np.inf)
        for block in scorer.blocks(batches):
            at, found = scorer.similarities(block)
            if len(at):
                scores = scorer.complete(block, at, found)["score"]
                n, total, best = n + len(at), total + scores.sum(axis=0), np.maximum(best, scores.max(axis=0))
        if n:
            columns = [pa.array(scorer.ids, id_type), pa.array([n] * len(total), pa.int64()), pa.array(total), pa.array(best)]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "songs", "total", "best"])

    parts = inputs.mapInArrow(run, f"query_id {batch.id_type.simpleString()}, songs long, total double, best double")
    return parts.groupBy("query_id").agg(F.sum("songs").alias("songs"), F.sum("total").alias("total"), F.max("best").alias("best"))


class Best:
    """Each prompt's best songs so far in a task, by score and then by larger id."""

    def __init__(self, limits: np.ndarray):
        self.limits = limits
        self.least = np.full(len(limits), -np.inf)
        self.rows = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0)) for _ in limits]

    def add(self, k: int, scores: np.ndarray, songs: np.ndarray, plain: np.ndarray) -> None:
        limit = int(self.limits[k])
        scores, songs, plain = (np.concatenate(x) for x in zip(self.rows[k], (scores, songs, plain)))
        if len(scores) > limit:
            kept = scores >= np.partition(scores, -limit)[-limit]
            scores, songs, plain = scores[kept], songs[kept], plain[kept]
            order = np.lexsort((songs, scores))[::-1][:limit]
            scores, songs, plain = scores[order], songs[order], plain[order]
        self.rows[k] = scores, songs, plain
        if len(scores) == limit:
            self.least[k] = scores.min()


def best_in_tasks(songs: DataFrame, batch: Batch, rules: Rulebook) -> DataFrame:
    """``query_id, song_id, limit, score, semantic_score``: every task's best songs of each prompt, its limit at most."""
    scorer = Scorer(songs, batch, rules)
    inputs, id_type = scorer.inputs(songs, rules), to_arrow_type(batch.id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(scorer.limits)
        for block in scorer.blocks(batches):
            at, found = scorer.similarities(block)
            open_ = (scorer.ceiling(found) >= best.least).any(axis=1)
            if not open_.any():
                continue
            at, found = at[open_], {c: v[open_] for c, v in found.items()}
            out = scorer.complete(block, at, found)
            ids, enough = _song_ids(block)[at], out["score"] >= best.least
            for k in np.flatnonzero(enough.any(axis=0)):
                rows = enough[:, k]
                best.add(k, out["score"][rows, k], ids[rows], out["semantic_score"][rows, k])
        sizes = [len(r[0]) for r in best.rows]
        if sum(sizes):
            query = pa.array(scorer.ids, id_type).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            score, song, plain = (np.concatenate([r[i] for r in best.rows]) for i in range(3))
            limit = np.repeat(scorer.limits, sizes)
            yield pa.RecordBatch.from_arrays([query, *map(pa.array, (song, limit, score, plain))], ["query_id", "song_id", "limit", "score", "semantic_score"])

    return inputs.mapInArrow(run, _pairs_schema(inputs, batch, "limit long, score double, semantic_score double"))


def top_rows(rows: DataFrame) -> DataFrame:
    """Best rows per prompt by score, then by larger id, from tasks that cut theirs to the limit.

    Parts of a prompt's rows are cut once more before they meet, so the last step sees ``MERGE_PARTS``
    times the limit at most.
    """
    order = [F.desc("score"), F.desc("song_id")]
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("song_id"), F.lit(MERGE_PARTS)))
    for keys in (["query_id", "_part"], ["query_id"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        rows = rows.withColumn("rank", place).filter(F.col("rank") <= F.col("limit"))
    return rows.drop("_part")


def rank_prompts(
    songs: DataFrame,
    plans: DataFrame,
    rules: Rulebook | None = None,
    max_batch: int = MAX_BATCH,
) -> DataFrame:
    """Ranked playlists: query_id, rank, song_id, score, semantic_score, match_quality.

    ``plans`` comes from :func:`plan_prompts` with a ``query_vec`` and, for the audio signal, a
    ``clap_vec`` column. Prompts are taken in batches of at most ``max_batch``, and of ``MAX_KEPT`` rows of
    playlists: each is one pass over the songs. Their ids must differ and each needs a finite
    ``query_vec``; song ids are longs. A song whose text vector is missing or not finite is not ranked, one whose audio
    vector is has no audio signal; a vector of another length than the prompts' raises.
    """
    rules = rules or default_rulebook()

    batches = [b for b in prompt_batches(plans, max_batch, rules) if b.ids]
    if not batches:
        raise ValueError("no prompts")
    parts = [top_rows(best_in_tasks(songs, b, rules)) for b in batches]
    return reduce(DataFrame.unionByName, parts).select(
        "query_id", "rank", "song_id", "score", "semantic_score",
        match_quality(F.col("score")).alias("match_quality"),
    )


def match_quality(score: Column) -> Column:
    return (
        F.when(score.isNull(), "unknown").when(score >= 60, "high").when(score >= 35, "medium")
        .otherwise("low")
    )


def hydrate(ranked: DataFrame, songs: DataFrame, columns: list[str]) -> DataFrame:
    """Add song columns to ranked rows; a song that is gone drops its row. Spark picks the join from the sizes it sees."""
    picked = songs.select(F.col("id").alias("song_id"), *columns)
    return picked.join(ranked, "song_id")
