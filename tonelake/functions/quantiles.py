"""Exact percentiles per key by radix selection: ranks are found by counts, no values are sorted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions.vectors import as_input
from tonelake.session import settle

#: Values of a key that Spark's own exact aggregate may hold in one task.
FEW = 1 << 16
#: Bits of a value that are left after each pass.
SHIFTS = (44, 22, 0)


def ordered_bits(value: Column) -> Column:
    """The bits of a double as a long that sorts as the double does; both zeros are one."""

    @F.arrow_udf("long")
    def bits(batch: pa.Array) -> pa.Array:
        raw = (batch.to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
        return pa.array(raw ^ ((raw >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))

    return bits(as_input(value))


def double_of(bits: Column) -> Column:
    """The double of :func:`ordered_bits`."""

    @F.arrow_udf("double")
    def value(batch: pa.Array) -> pa.Array:
        raw = batch.to_numpy(zero_copy_only=False)
        return pa.array((raw ^ ((raw >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64))

    return value(as_input(bits))


def select_ranks(codes: DataFrame, ranks: DataFrame, key: str, shifts: tuple[int, ...] = SHIFTS) -> DataFrame:
    """``key, _rank, _v``: for each row of ``ranks`` (key, _rank from 0) the value of that rank among the key's ``_u``.

    Each pass counts, on the map side first, the leading bits of values that share the bits found so far
    with a wanted rank, and the counts in order say where the rank lies. A pass orders at most 2**22
    counts of a key and bucket, and ends the search where buckets hold one value each.
    """
    open_ = ranks.select(key, "_rank", F.col("_rank").alias("_left"))
    before = None
    for shift in shifts:
        wanted = codes
        group = [key]
        if before is not None:
            wanted = codes.withColumn("_prefix", F.shiftright("_u", before)).join(open_.select(key, "_prefix").distinct(), [key, "_prefix"], "left_semi")
            group = [key, "_prefix"]
        counts = wanted.groupBy(*group, F.shiftright("_u", shift).alias("_next")).agg(F.count("*").alias("_c"), F.min("_u").alias("_least"), F.max("_u").alias("_most"))
        upto = F.sum("_c").over(Window.partitionBy(*group).orderBy("_next"))
        starts = counts.withColumn("_first", upto - F.col("_c"))
        joined = open_.select(*group, "_rank", "_left").join(starts, group)
        inside = (F.col("_left") >= F.col("_first")) & (F.col("_left") < F.col("_first") + F.col("_c"))
        open_ = settle(joined.filter(inside).select(key, "_rank", (F.col("_left") - F.col("_first")).alias("_left"), F.col("_next").alias("_prefix"), "_least", "_most"), "ranks")
        if open_.filter("_least < _most").isEmpty():
            break
        before = shift
    return open_.select(key, "_rank", double_of(F.col("_least")).alias("_v"))


def keys_of_many(rows: DataFrame, key: str, few: int = FEW) -> DataFrame:
    """``key, _n`` of the keys with more than ``few`` rows, as a stored table."""
    return settle(rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > few), "large-keys")


def interpolated(place: Column, low: Column, high: Column) -> Column:
    """The value at a place between ranks, from those at its floor and ceiling, as Spark's ``percentile`` computes it."""
    between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
    return F.when((F.floor(place) == F.ceil(place)) | (low == high), low).otherwise(between)


def exact_percentiles(df: DataFrame, key: str, value: str, probs: dict[str, float], few: int = FEW, shifts: tuple[int, ...] = SHIFTS) -> DataFrame:
    """Linear-interpolated percentiles of ``value`` per ``key``; one column per entry of probs.

    A key with up to ``few`` values is read by Spark's own exact aggregate, which merges counts of equal
    values on the map side. Of a key with more, however many, the ranks next to each percentile are selected by their
    leading bits. Missing values don't count.
    """
    v = F.col(value).cast("double")
    rows = df.select(key, v.alias("_v")).filter(v.isNotNull() & ~F.isnan(v))
    small = lambda of: of.groupBy(key).agg(F.percentile("_v", F.lit(list(probs.values()))).alias("_p")).select(key, *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(probs)])
    many = keys_of_many(rows, key, few)
    if many.isEmpty():
        return small(rows)
    codes = settle(rows.join(many, key, "left_semi").select(key, ordered_bits(F.col("_v")).alias("_u")), "value-bits")
    at = {n: F.lit(float(p)) * (F.col("_n") - 1) for n, p in probs.items()}
    ends = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in at.values()])))
    found = settle(select_ranks(codes, many.select(key, F.explode(ends).alias("_rank")), key, shifts), "selected")
    joined = many.join(found, key).groupBy(key).agg(
        F.max("_n").alias("_n"),
        *[F.max(F.when(F.col("_rank") == end(at[n]), F.col("_v"))).alias(f"_{side}_{n}") for n in probs for side, end in (("low", F.floor), ("high", F.ceil))],
    )
    part = lambda n: at[n] - F.floor(at[n])
    large = joined.select(key, *[(F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * part(n)).alias(n) for n in probs])
    return small(rows.join(many, key, "left_anti")).unionByName(large)
