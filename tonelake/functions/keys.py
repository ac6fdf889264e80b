"""Rows of wanted keys, told from others before anything is dealt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.session import settle

#: Bits of a table of keys, at most: 32 MB.
MOST_BITS = 1 << 28
#: Bits in one of its rows, as ``bitmap_construct_agg`` makes them.
ROW_BITS = 1 << 15
_KINDS = ("bigint", "int", "string")


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def key_bits(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A stored table (_row, _words) of bits, some 16 for each key, in which the hashes of all keys are set, and how many bits it has."""
    bits = ROW_BITS
    while bits < min(MOST_BITS, 16 * keys.count()):
        bits *= 2
    slots = keys.filter(F.col(key).isNotNull()).select(_slot(F.col(key), bits).alias("_slot"))
    # Dealt by row first, so that maps are made once and not by every task.
    dealt = slots.select(F.shiftright("_slot", 15).alias("_row"), F.col("_slot").bitwiseAND(F.lit(ROW_BITS - 1)).alias("_at")).repartition("_row")
    maps = dealt.groupBy("_row").agg(F.bitmap_construct_agg("_at").alias("_map"))
    word = lambda i: F.conv(F.hex(F.substr(F.col("_map"), i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    return settle(maps.select("_row", F.transform(F.sequence(F.lit(0), F.lit(ROW_BITS // 64 - 1)), word).alias("_words")), "key-bits"), bits


def likely_rows(rows: DataFrame, key: str, table: tuple[DataFrame, int]) -> DataFrame:
    """The rows whose key may be one of those of :func:`key_bits`: all that are, and some 6 % of the others up to 16 million keys.

    Narrow: the table travels with the tasks.
    """
    maps, bits = table
    slot = _slot(F.col(key), bits)
    word = F.get("_words", F.shiftright(slot.bitwiseAND(F.lit(ROW_BITS - 1)), 6).cast("int"))
    # Words are written from their first byte on, bytes from their last bit.
    byte = F.shiftright(slot, 3).bitwiseAND(F.lit(7))
    at = (F.lit(56) - byte * 8 + slot.bitwiseAND(F.lit(7))).cast("int")
    return rows.join(F.broadcast(maps), (F.shiftright(slot, 15) == F.col("_row")) & (F.getbit(word, at) == 1), "left_semi")


def rows_of_keys(rows: DataFrame, keys: DataFrame, key: str, table: tuple[DataFrame, int]) -> DataFrame:
    """The rows whose key is among ``keys``; most others are left out before rows are dealt. ``table``: :func:`key_bits` of ``keys``."""
    kind = dict(rows.dtypes)[key]
    if kind in _KINDS and kind == dict(keys.dtypes)[key]:  # of other types equal keys may have other hashes
        rows = likely_rows(rows, key, table)
    return rows.join(keys, key, "left_semi")
