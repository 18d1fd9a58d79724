"""Bit sets of bounded size that let tasks skip rows no join partner can exist for.

A set is an array of ``bits`` flags; each member sets two. It never loses a member, and what it lets
through by chance is settled by the exact join that follows. Its size follows the number of members
up to ``MOST_BITS`` (32 MB); beyond that it lets more through, and results stay the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS, BITS_PER_MEMBER = 1 << 24, 1 << 28, 16


def bits_for(members: int) -> int:
    bits = LEAST_BITS
    while bits < members * BITS_PER_MEMBER and bits < MOST_BITS:
        bits *= 2
    return bits


def build(members: DataFrame, column: str, count: int) -> np.ndarray:
    """Flags of all values of the long ``column``; at most 32 MB come to the driver, whatever the input."""
    bits = bits_for(count)
    value = F.col(column)
    places = F.array(value.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(value, 32).bitwiseAND(F.lit(bits - 1)))
    words = (
        members.select(F.explode(places).alias("p"))
        .groupBy(F.shiftrightunsigned("p", 6).alias("w"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("m"))
        .toArrow()
    )
    flags = np.zeros(bits // 64, np.uint64)
    flags[words["w"].to_numpy()] = words["m"].to_numpy().view(np.uint64)
    return flags


def hit(flags: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the unsigned ``values`` may be members."""
    mask, six, low = np.uint64(len(flags) * 64 - 1), np.uint64(6), np.uint64(63)

    def flag(place):
        return (flags[place >> six] >> (place & low)) & np.uint64(1)

    first = values & mask
    found = flag(first).astype(bool)
    some = np.flatnonzero(found)
    found[some] = flag((values[some] >> np.uint64(32)) & mask).astype(bool)
    return found


def member(flags, value: Column) -> Column:
    """Whether a long column may be a member; ``flags`` is a broadcast set."""

    @F.arrow_udf("boolean")
    def run(values: pa.Array) -> pa.Array:
        return pa.array(hit(flags.value, values.to_numpy(zero_copy_only=False).view(np.uint64)))

    return run(value)


def row_hash(key: str, text: str) -> Column:
    """Name of a row by its key and text, as ``named`` takes them."""
    return F.xxhash64(F.col(key).cast("bigint"), F.xxhash64(text))


def named(rows: DataFrame):
    """Broadcast set of the rows named by ``id`` and ``tk``, the hash of the text."""
    flags = build(rows.select(F.xxhash64("id", "tk").alias("h")), "h", rows.count())
    return rows.sparkSession.sparkContext.broadcast(flags)


def split(docs: DataFrame, rows: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` that are surely not among ``rows``, and those that may be (with ``__tk``, the hash of the text).

    ``rows`` names rows by ``id`` and ``tk``. Only the second part has to be shuffled for a join.
    """
    listed = member(named(rows), row_hash(key, text))
    return docs.where(~listed), docs.where(listed).withColumn("__tk", F.xxhash64(text))


def match(maybe: DataFrame, rows: DataFrame, key: str, how: str) -> DataFrame:
    """Join the second part of ``split`` with ``rows`` on key (null-safe) and hash of the text.

    Any further columns of ``rows`` are added; ``docs`` may have columns of any name not in them.
    """
    rows = rows.withColumnsRenamed({"id": "__rid", "tk": "__rtk"})
    same = F.col(key).cast("bigint").eqNullSafe(F.col("__rid")) & (F.col("__tk") == F.col("__rtk"))
    return maybe.join(rows, same, how).drop("__rid", "__rtk")


def without(docs: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` less the rows named by ``id`` and ``tk`` in ``rows``."""
    sure, maybe = split(docs, rows, key, text)
    return sure.union(match(maybe, rows, key, "left_anti").drop("__tk"))
