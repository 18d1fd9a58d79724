"""Places: institutions to cities and districts by keywords in their names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.functions.numeric import MONEY
from registra.operators.paging import top_k, top_k_per_group


@dataclass(frozen=True)
class City:
    city: str
    keys: tuple[str, ...]
    lat: float
    lon: float
    fo: str


def _case(found: Sequence[tuple[Column, int]]) -> Column:
    """Index of the first condition that holds, evaluated in order."""
    expr = F.lit(None).cast("int")
    if found:
        expr = F.when(found[0][0], F.lit(found[0][1]))
        for cond, index in found[1:]:
            expr = expr.when(cond, F.lit(index))
    return expr


def _fallback_words(cities: Sequence[City]) -> list[tuple[str, int]]:
    """First word of each city name when longer than four letters; the first city keeps it."""
    words: dict[str, int] = {}
    for i, c in enumerate(cities):
        word = c.city.lower().replace(".", "").replace("-", "").split(" ")[0]
        if len(word) > 4:
            words.setdefault(word, i)
    return list(words.items())


def first_match(
    df: DataFrame,
    name_column: str,
    cities: Sequence[City],
    mode: str = "first",
    fallback: bool = True,
) -> DataFrame:
    """Add ``city``, ``lat``, ``lon``, ``fo`` of the city whose key occurs in the name.

    ``mode="first"``: the first city in dictionary order wins. ``mode="longest"``: the longest
    key wins. Without a key the city's own first word is tried. No match leaves nulls. The
    dictionary becomes one CASE expression, so there is neither a join nor a shuffle.
    """
    keys = [(k, i) for i, c in enumerate(cities) for k in c.keys]
    # a column of its own, or every test would lower the name again
    named = df.withColumn("_name", F.lower(F.coalesce(F.col(name_column), F.lit(""))))
    name = F.col("_name")
    if mode == "first":
        found = [
            (reduce(or_, [F.contains(name, F.lit(k)) for k in c.keys]), i)
            for i, c in enumerate(cities)
            if c.keys
        ]
    elif mode == "longest":
        ordered = sorted(keys, key=lambda ki: (-len(ki[0]), ki[1]))
        found = [(F.contains(name, F.lit(k)), i) for k, i in ordered]
    else:
        raise ValueError(f"unknown mode {mode!r}")
    index = _case(found)
    if fallback:
        words = [(F.contains(name, F.lit(w)), i) for w, i in _fallback_words(cities)]
        index = F.coalesce(index, _case(words))
    rows = F.array(
        *[
            F.struct(
                F.lit(c.city).alias("city"),
                F.lit(float(c.lat)).alias("lat"),
                F.lit(float(c.lon)).alias("lon"),
                F.lit(c.fo).alias("fo"),
            )
            for c in cities
        ]
    )
    placed = named.withColumn("_index", index)
    placed = placed.withColumn("_city", F.when(F.col("_index").isNotNull(), F.get(rows, "_index")))
    return placed.select(*df.columns, "_city.city", "_city.lat", "_city.lon", "_city.fo")


def place_rows(
    rows: DataFrame, cities: Sequence[City], mode: str = "first"
) -> DataFrame:
    """Rows of the institution aggregate that fall on a known city."""
    return first_match(rows, "institution", cities, mode).where(F.col("city").isNotNull())


def city_rollup(placed: DataFrame) -> DataFrame:
    """Records and budget per city; cities without records are left out."""
    sums = placed.groupBy("city", "lat", "lon", "fo").agg(
        F.sum("projects").alias("projects"),
        F.sum(F.col("total_budget").cast(MONEY)).cast("double").alias("budget"),
    )
    return sums.where(F.col("projects") > 0)


def city_organisations(placed: DataFrame, k: int = 5) -> DataFrame:
    """Largest institutions of each city by records."""
    order = [F.desc("projects"), F.asc("institution"), F.asc("ogrn"), F.asc("ministry")]
    named = placed.where(F.col("institution").isNotNull())
    return top_k_per_group(named, ["city"], order, k).select(
        "city", "rank", "institution", "projects", "total_budget"
    )


def district_rollup(cities: DataFrame) -> DataFrame:
    """Records and number of cities per district."""
    sums = cities.groupBy("fo").agg(
        F.sum("projects").alias("projects"), F.count(F.lit(1)).alias("cities")
    )
    return sums.where(F.col("projects") > 0)


def geo_coverage(rows: DataFrame, cities: Sequence[City], mode: str = "first") -> DataFrame:
    """Records on the map, all records, percent."""
    on_map = F.sum(F.when(F.col("city").isNotNull(), F.col("projects")).otherwise(0))
    zero = F.lit(0).cast("bigint")
    return (
        first_match(rows, "institution", cities, mode)
        .agg(
            F.coalesce(on_map, zero).alias("matched"),
            F.coalesce(F.sum("projects"), zero).alias("total"),
        )
        .withColumn(
            "percent",
            F.when(F.col("total") > 0, F.round(F.col("matched") * 100 / F.col("total"), 0)).cast(
                "int"
            ),
        )
    )


def top_cities(cities: DataFrame, metric: str = "projects", k: int = 10) -> DataFrame:
    return top_k(cities, [F.desc(metric), F.asc("city")], k)
