"""Sorting, pages and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registra.sources.tables import KEY


def _list_order() -> list[Column]:
    return [F.col("year").desc_nulls_last(), F.col(KEY).asc()]


def page(df: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """One page, newest year first, then by key. The plan is a top-k, not a full sort."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page numbers start at 1 and pages hold 1 to 100 records")
    return df.orderBy(*_list_order()).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, year: int | None, key: str, size: int = 20) -> DataFrame:
    """The page that follows the record ``(year, key)``. Its cost does not grow with depth."""
    if year is None:
        later = F.col("year").isNull() & (F.col(KEY) > key)
    else:
        same = (F.col("year") == year) & (F.col(KEY) > key)
        later = F.col("year").isNull() | (F.col("year") < year) | same
    return df.where(later).orderBy(*_list_order()).limit(size)


def page_info(df: DataFrame, size: int = 20) -> DataFrame:
    """Record count and page count."""
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), F.ceil(total / size).cast("bigint").alias("pages"))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows of every group.

    Spark cuts each group to ``k`` rows before the shuffle, so a hot group costs no more than
    a small one.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
