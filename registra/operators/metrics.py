"""Counts and budgets: the dashboard and budget figures.

All groupings aggregate on the map side first, so a hot year, type or institution reaches the
shuffle as one row per task. Ties in every top list are broken by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.functions.numeric import MONEY, money_avg, money_sum, round_dec
from registra.operators.filters import FilterSpec, year_between

BUDGET = "budget_total_thousands"
DASHBOARD_YEARS = (2019, 2027)
BUDGET_YEARS = (2020, 2025)
SIZE_EDGES = (1_000, 10_000, 100_000)
SIZE_NAMES = ("under_1m", "to_10m", "to_100m", "over_100m")


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def total_budget(df: DataFrame) -> DataFrame:
    """Budget in billions with one decimal; 0 when there is none."""
    billions = F.coalesce(money_sum(F.col(BUDGET)), F.lit(0.0)) / 1_000_000
    return df.agg(round_dec(billions, 1).alias("total_budget_billions"))


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(count(F.col(column)).alias("distinct_count"))


def count_by_year(
    df: DataFrame, spec: FilterSpec = FilterSpec(), years: tuple[int, int] = DASHBOARD_YEARS
) -> DataFrame:
    """Records per year. The year condition of ``spec`` is left out on purpose."""
    kept = spec.without_year().apply(df).where(year_between(*years))
    return kept.groupBy("year").agg(F.count(F.lit(1)).alias("count"))


def top_groups(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values of a column."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("projects")
    )
    return counts.orderBy(F.desc("projects"), F.asc(column)).limit(n)


def dashboard_cube(df: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Counts and money per (year, institution, type), one scan for the whole dashboard.

    It is far smaller than the records. Write or persist it when several figures are taken from it.
    """
    kept = spec.without_year().apply(df)
    return kept.groupBy("year", "executor_name", "nioktr_types").agg(
        F.count(F.lit(1)).alias("projects"), F.sum(F.col(BUDGET).cast(MONEY)).alias("money")
    )


def dashboard_stats(
    cube: DataFrame,
    year: int | None = None,
    years: tuple[int, int] = DASHBOARD_YEARS,
) -> dict[str, DataFrame]:
    """The six dashboard figures from :func:`dashboard_cube`; ``year`` does not limit by_year."""
    chosen = cube.where(F.col("year") == year) if year else cube

    def ranked(column: str, n: int) -> DataFrame:
        counts = chosen.where(F.col(column).isNotNull()).groupBy(column)
        return (
            counts.agg(F.sum("projects").alias("projects"))
            .orderBy(F.desc("projects"), F.asc(column))
            .limit(n)
        )

    zero = F.lit(0).cast("bigint")
    money = F.coalesce(F.sum("money").cast("double"), F.lit(0.0))
    return {
        "total": chosen.agg(F.coalesce(F.sum("projects"), zero).alias("total")),
        "total_budget": chosen.agg(round_dec(money / 1_000_000, 1).alias("total_budget_billions")),
        "institutions": chosen.agg(F.count_distinct("executor_name").alias("institutions")),
        "by_year": cube.where(year_between(*years))
        .groupBy("year")
        .agg(F.sum("projects").alias("count")),
        "top_institutions": ranked("executor_name", 10),
        "by_type": ranked("nioktr_types", 8),
    }


def budget_by_year(df: DataFrame, years: tuple[int, int] = BUDGET_YEARS) -> DataFrame:
    kept = df.where(F.col(BUDGET).isNotNull() & year_between(*years))
    return kept.groupBy("year").agg(*_budget_figures(average=True))


def _budget_figures(average: bool) -> list:
    money = F.col(BUDGET)
    figures = [round_dec(money_sum(money) / 1_000_000, 1).alias("total_billions")]
    if average:
        figures.append(round_dec(money_avg(money) / 1_000, 1).alias("avg_millions"))
    return [*figures, F.count(F.lit(1)).alias("projects")]


def top_by_sum(df: DataFrame, column: str, n: int = 10, average: bool = False) -> DataFrame:
    """Groups with the largest *rounded* budget, in billions."""
    kept = df.where(F.col(BUDGET).isNotNull() & F.col(column).isNotNull())
    sums = kept.groupBy(column).agg(*_budget_figures(average))
    return sums.orderBy(F.desc("total_billions"), F.asc(column)).limit(n)


def budget_by_type(df: DataFrame, n: int = 8) -> DataFrame:
    return top_by_sum(df, "nioktr_types", n, average=True)


def _size_counts(c: Column, edges: Sequence[float], names: Sequence[str]) -> list[Column]:
    tests = [c < edges[0], *[c.between(a, b) for a, b in zip(edges, edges[1:])], c > edges[-1]]
    return [F.count_if(t).alias(n) for t, n in zip(tests, names, strict=True)]


def bucket_counts(
    df: DataFrame,
    column: str = BUDGET,
    edges: Sequence[float] = SIZE_EDGES,
    names: Sequence[str] = SIZE_NAMES,
) -> DataFrame:
    """Records per size class in one pass.

    Inner classes include both edges, so a value on an inner edge counts in two of them.
    """
    return df.agg(*_size_counts(F.col(column), edges, names))


def budget_cube(
    df: DataFrame,
    edges: Sequence[float] = SIZE_EDGES,
    names: Sequence[str] = SIZE_NAMES,
) -> DataFrame:
    """Records with a budget per (year, institution, type): count, money and size classes.

    One scan for all budget figures. Write or persist it when several figures are taken from it.
    """
    kept = df.where(F.col(BUDGET).isNotNull())
    return kept.groupBy("year", "executor_name", "nioktr_types").agg(
        F.count(F.lit(1)).alias("projects"),
        F.sum(F.col(BUDGET).cast(MONEY)).alias("money"),
        *_size_counts(F.col(BUDGET), edges, names),
    )


def budget_stats(
    cube: DataFrame, spec: FilterSpec = FilterSpec(), years: tuple[int, int] = BUDGET_YEARS
) -> dict[str, DataFrame]:
    """The four budget figures from :func:`budget_cube`; by_year ignores the filters.

    The filters may name year, type and institution.
    """
    if spec.search:
        raise ValueError("budget figures cannot be searched by text")
    kept = spec.apply(cube)
    money, n = F.sum("money").cast("double"), F.sum("projects")
    billions = round_dec(money / 1_000_000, 1).alias("total_billions")
    figures = [billions, round_dec(money / n / 1_000, 1).alias("avg_millions"), n.alias("projects")]

    def ranked(column: str, k: int, *values: Column) -> DataFrame:
        sums = kept.where(F.col(column).isNotNull()).groupBy(column).agg(*values)
        return sums.orderBy(F.desc("total_billions"), F.asc(column)).limit(k)

    sizes = [c for c in cube.columns if c not in (
        "year", "executor_name", "nioktr_types", "projects", "money")]
    zero = F.lit(0).cast("bigint")
    return {
        "by_year": cube.where(year_between(*years)).groupBy("year").agg(*figures),
        "top_orgs_by_budget": ranked("executor_name", 10, billions, n.alias("projects")),
        "by_type": ranked("nioktr_types", 8, *figures),
        "distribution": kept.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in sizes]),
    }


def map_rows(df: DataFrame) -> DataFrame:
    """Count and budget per institution and ministry."""
    named = df.where(F.col("executor_name").isNotNull())
    return named.groupBy(
        F.col("executor_name").alias("institution"),
        F.col("executor_ogrn").alias("ogrn"),
        F.col("executor_okogu").alias("ministry"),
    ).agg(
        F.count(F.lit(1)).alias("projects"),
        F.coalesce(money_sum(F.col(BUDGET)), F.lit(0.0)).alias("total_budget"),
    )
