"""Vector expressions and the block similarity used for scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions.numbers import let

DIMENSIONS = 64


def dot(a: Column, b: Column) -> Column:
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    scaled = lambda v, n: F.transform(v, lambda x: x.cast("double") / n)
    return let(a, lambda v: let(norm(v) + F.lit(1e-8), lambda n: scaled(v, n)))


def hashed_words(text: Column, dims: int = DIMENSIONS) -> Column:
    """Unit vector of hashed word counts: the stand-in text vectoriser that needs no model."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))
    slots = F.transform(
        tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("int") % F.lit(dims)
    )

    def count(found: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)),
            lambda i: (F.size(found) - F.size(F.array_remove(found, i))).cast("double"),
        )

    return l2_normalise(let(slots, count)).cast("array<float>")


def decode_float32(raw: Column) -> Column:
    """Little-endian float32 bytes to an array; a length that is no multiple of 4 gives NULL."""

    @F.arrow_udf("array<float>")
    def decode(batch: pa.Array) -> pa.Array:
        lengths = np.diff(_offsets(batch)) if len(batch) else np.zeros(0, "int64")
        good = (lengths % 4 == 0) & batch.is_valid().to_numpy(zero_copy_only=False)
        kept = batch.filter(pa.array(good)) if not good.all() else batch
        ends = _offsets(kept)
        data = kept.buffers()[2]
        values = np.frombuffer(data, "uint8", ends[-1] - ends[0], ends[0]).view("<f4") if data and len(kept) else np.zeros(0, "<f4")
        sizes = np.concatenate([[0], np.cumsum(np.where(good, lengths // 4, 0))]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(sizes), pa.array(values, pa.float32()), mask=pa.array(~good))

    return decode(as_input(raw))


def _offsets(batch: pa.Array) -> np.ndarray:
    """Where each value of a binary array begins, and the last one ends, in its data buffer."""
    wide = pa.types.is_large_binary(batch.type)
    starts = np.frombuffer(batch.buffers()[1], "int64" if wide else "int32")
    return starts[batch.offset : batch.offset + len(batch) + 1].astype("int64")


def as_input(column: Column) -> Column:
    """A column as the argument of a Python function.

    Spark cannot hand a lambda expression to Python, and the optimizer would put one that is used
    once in place of the column. Naming the column twice keeps it a column.
    """
    return F.coalesce(column, column)


def vector_matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows as a float64 matrix, and their mask.

    A row that is missing, or has a component that is missing or not finite, has no vector. A vector of
    another length belongs to another model and raises.
    """
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    odd = lengths[(lengths >= 0) & (lengths != dims)]
    if len(odd):
        raise ValueError(f"a vector of length {odd[0]} among songs, where the prompts have {dims}")
    good = lengths == dims
    kept = column.filter(pa.array(good)) if not good.all() else column
    rows = kept.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dims)
    finite = np.isfinite(rows).all(axis=1)
    if not finite.all():
        good[np.flatnonzero(good)[~finite]] = False
        rows = rows[finite]
    return rows, good


def similarity(rows: np.ndarray, prompts: np.ndarray, cosine: bool) -> np.ndarray:
    sims = rows @ prompts.T
    if cosine:
        size = np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(prompts, axis=1)[None, :]
        sims = np.divide(sims, size, out=np.zeros_like(sims), where=size > 0)
    return sims


def similarity_bounds(
    songs: DataFrame, signals: dict[str, tuple[str, np.ndarray, bool]], needed: str
) -> DataFrame:
    """Lowest and highest similarity per prompt position over all songs, one pass for all signals.

    ``signals`` maps a name to (vector column, prompt matrix, cosine); only songs with a usable vector
    in the column ``needed``, which is one of them, count. Every task is reduced to one
    row per prompt before anything is shuffled. Columns: pos, <name>_low, <name>_high.
    """
    names = list(signals)
    width = max(m.shape[0] for _, m, _ in signals.values())
    step = max(64, (1 << 20) // width)

    def reduce_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = {n: np.full(width, np.inf) for n in names}
        high = {n: np.full(width, -np.inf) for n in names}
        for batch in batches:
            usable = {n: vector_matrix(batch.column(i), signals[n][1].shape[1]) for i, n in enumerate(names)}
            ranked = next(usable[n][1] for n in names if signals[n][0] == needed)
            for n in names:
                _, prompts, cosine = signals[n]
                rows, good = usable[n]
                rows = rows[ranked[good]]
                for at in range(0, len(rows), step):
                    sims = similarity(rows[at : at + step], prompts, cosine)
                    low[n] = np.minimum(low[n], sims.min(axis=0))
                    high[n] = np.maximum(high[n], sims.max(axis=0))
        ends = [pa.array(x[n], mask=~np.isfinite(x[n])) for n in names for x in (low, high)]
        columns = ["pos", *[f"{n}_{e}" for n in names for e in ("low", "high")]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype="int32")), *ends], names=columns)

    schema = "pos int, " + ", ".join(f"{n}_low double, {n}_high double" for n in names)
    ends = [f(f"{n}_{e}").alias(f"{n}_{e}") for n in names for e, f in (("low", F.min), ("high", F.max))]
    vectors = songs.select(*[column for column, _, _ in signals.values()])
    return vectors.mapInArrow(reduce_batches, schema).groupBy("pos").agg(*ends)


def with_model_vectors(
    df: DataFrame,
    text: str,
    out: str,
    load: Callable[[], Callable[[list[str]], Sequence]],
    prefix: str = "",
) -> DataFrame:
    """Vectors from a user's model, for texts or, with a column of paths, for audio.

    ``load`` runs once per worker process and returns a function from a list of strings to their
    vectors, None where there is none. Only the text column goes to Python. ``prefix`` is put before every text; query and passage sides differ
    in some models.
    """

    @F.arrow_udf("array<float>")
    def encode(batch: pa.Array) -> pa.Array:
        found = worker_model(load)([prefix + (t or "") for t in batch.to_pylist()])
        return pa.array([None if v is None else np.asarray(v, dtype="float32") for v in found], pa.list_(pa.float32()))

    return df.withColumn(out, encode(as_input(F.col(text).cast("string"))))


_MODELS: dict[bytes, Callable] = {}


def worker_model(load: Callable[[], Callable]) -> Callable:
    """The model that ``load`` makes, kept for the life of the worker process."""
    key = cloudpickle.dumps(load)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = load()
    return _MODELS[key]
