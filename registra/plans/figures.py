"""Queries: counts and budgets (A1-A12, A17, A22, A23) and numeric expressions (X10-X14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registra.functions import numeric
from registra.operators import metrics, profile
from registra.operators.filters import FilterSpec
from registra.plans.projects import EDGES, YEARS, projects, table, with_projects
from registra.plans.registry import dec_round, money, query
from registra.sources.tables import written
from registra.plans.selection import SEARCH_SQL, SPEC, SPEC_SQL, TYPE_SQL

_SPEC_COLUMNS = ("year", "nioktr_types", "name", "annotation", "keyword_list", "executor_name",
                 "budget_total_thousands")
_B = "budget_total_thousands"
_SUM = money(_B)
DASH = (1996, 2000)


def _billions(expr):
    return dec_round(f"{expr} / 1000000", 1)


def _filtered(spark, sf):
    return SPEC.apply(projects(spark, sf, *_SPEC_COLUMNS))


@query("a01_total", with_projects(f"SELECT count(*) AS total FROM projects WHERE {SPEC_SQL}"))
def a01(spark, sf):
    return metrics.total(_filtered(spark, sf))


@query("a02_total_budget", with_projects(
    f"SELECT {_billions(f'coalesce({_SUM}, 0)')} AS total_budget_billions "
    f"FROM projects WHERE {SPEC_SQL}"))
def a02(spark, sf):
    return metrics.total_budget(_filtered(spark, sf))


@query("a03_distinct_count", with_projects(
    "SELECT count(DISTINCT executor_name) AS distinct_count FROM projects"))
def a03(spark, sf):
    return metrics.distinct_count(projects(spark, sf, "executor_name"), "executor_name")


@query("a04_count_by_year", with_projects(
    f"SELECT year, count(*) AS count FROM projects WHERE {TYPE_SQL} AND {SEARCH_SQL} "
    f"AND executor_name ILIKE '%#0%' AND year BETWEEN {DASH[0]} AND {DASH[1]} GROUP BY year"))
def a04(spark, sf):
    return metrics.count_by_year(projects(spark, sf, *_SPEC_COLUMNS), SPEC, DASH)


def _top_sql(column, n):
    return with_projects(
        f"SELECT {column}, count(*) AS projects FROM projects WHERE {column} IS NOT NULL "
        f"GROUP BY {column} ORDER BY projects DESC, {column} LIMIT {n}")


@query("a05_top_groups", _top_sql("executor_name", 10))
def a05(spark, sf):
    return metrics.top_groups(projects(spark, sf, "executor_name"), "executor_name", 10)


@query("a06_top_types", _top_sql("nioktr_types", 8))
def a06(spark, sf):
    return metrics.top_groups(projects(spark, sf, "nioktr_types"), "nioktr_types", 8)


def _stacked(figures, labels):
    """All figures of a bundle as (figure, item, n, value)."""
    out = None
    for name, frame in figures.items():
        item, n, value = labels[name]
        part = frame.select(
            F.lit(name).alias("figure"),
            (F.col(item).cast("string") if item else F.lit(None).cast("string")).alias("item"),
            (F.col(n).cast("bigint") if n else F.lit(None).cast("bigint")).alias("n"),
            (F.col(value) if value else F.lit(None).cast("double")).alias("value"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("a07_dashboard", with_projects(f""", kept AS (
  SELECT * FROM projects WHERE {TYPE_SQL}
), chosen AS (SELECT * FROM kept WHERE year = 1998)
SELECT 'total' AS figure, NULL::VARCHAR AS item, count(*) AS n, NULL::DOUBLE AS value FROM chosen
UNION ALL SELECT 'total_budget', NULL, NULL, {_billions(f'coalesce({_SUM}, 0)')} FROM chosen
UNION ALL SELECT 'institutions', NULL, count(DISTINCT executor_name), NULL FROM chosen
UNION ALL SELECT 'by_year', CAST(year AS VARCHAR), count(*), NULL FROM kept
  WHERE year BETWEEN {DASH[0]} AND {DASH[1]} GROUP BY year
UNION ALL (SELECT 'top_institutions', executor_name, count(*) AS c, NULL FROM chosen
  WHERE executor_name IS NOT NULL GROUP BY executor_name ORDER BY c DESC, executor_name LIMIT 10)
UNION ALL (SELECT 'by_type', nioktr_types, count(*) AS c, NULL FROM chosen
  WHERE nioktr_types IS NOT NULL GROUP BY nioktr_types ORDER BY c DESC, nioktr_types LIMIT 8)"""))
def a07(spark, sf):
    df = projects(spark, sf, "year", "nioktr_types", "executor_name", _B)
    cube = written(metrics.dashboard_cube(df, FilterSpec(nioktr_type="low")), "dashboard")
    return _stacked(metrics.dashboard_stats(cube, 1998, DASH), {
        "total": (None, "total", None),
        "total_budget": (None, None, "total_budget_billions"),
        "institutions": (None, "institutions", None),
        "by_year": ("year", "count", None),
        "top_institutions": ("executor_name", "projects", None),
        "by_type": ("nioktr_types", "projects", None),
    })


_BUDGET_FIGURES = (
    f"{_billions(_SUM)} AS total_billions, "
    f"{dec_round(f'{_SUM} / count(*) / 1000', 1)} AS avg_millions, count(*) AS projects")


@query("a08_budget_by_year", with_projects(
    f"SELECT year, {_BUDGET_FIGURES} FROM projects WHERE {_B} IS NOT NULL "
    f"AND year BETWEEN {YEARS[0]} AND {YEARS[1]} GROUP BY year"))
def a08(spark, sf):
    return metrics.budget_by_year(projects(spark, sf, "year", _B), YEARS)


@query("a09_top_by_sum", with_projects(
    f"SELECT executor_name, {_billions(_SUM)} AS total_billions, count(*) AS projects "
    f"FROM projects WHERE {_B} IS NOT NULL AND executor_name IS NOT NULL "
    "GROUP BY executor_name ORDER BY total_billions DESC, executor_name LIMIT 10"))
def a09(spark, sf):
    return metrics.top_by_sum(projects(spark, sf, "executor_name", _B), "executor_name", 10)


@query("a10_budget_by_type", with_projects(
    f"SELECT nioktr_types, {_BUDGET_FIGURES} FROM projects WHERE {_B} IS NOT NULL "
    "AND nioktr_types IS NOT NULL GROUP BY nioktr_types "
    "ORDER BY total_billions DESC, nioktr_types LIMIT 8"))
def a10(spark, sf):
    return metrics.budget_by_type(projects(spark, sf, "nioktr_types", _B), 8)


_NAMES = metrics.SIZE_NAMES
_TESTS = (f"< {EDGES[0]}", f"BETWEEN {EDGES[0]} AND {EDGES[1]}",
          f"BETWEEN {EDGES[1]} AND {EDGES[2]}", f"> {EDGES[2]}")


@query("a11_bucket_counts", with_projects("SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {_B} {t}) AS {n}" for t, n in zip(_TESTS, _NAMES))
    + " FROM projects"))
def a11(spark, sf):
    return metrics.bucket_counts(projects(spark, sf, _B), edges=EDGES, names=_NAMES)


@query("a12_budget_bundle", with_projects(f""", kept AS (
  SELECT * FROM projects WHERE {TYPE_SQL} AND year = 1998
)
SELECT 'by_year' AS figure, CAST(year AS VARCHAR) AS item, count(*) AS n,
  {_billions(_SUM)} AS value FROM projects WHERE {_B} IS NOT NULL
  AND year BETWEEN {YEARS[0]} AND {YEARS[1]} GROUP BY year
UNION ALL (SELECT 'top_orgs_by_budget', executor_name, count(*), {_billions(_SUM)} AS v FROM kept
  WHERE {_B} IS NOT NULL AND executor_name IS NOT NULL GROUP BY executor_name
  ORDER BY v DESC, executor_name LIMIT 10)
UNION ALL (SELECT 'by_type', nioktr_types, count(*), {_billions(_SUM)} AS v FROM kept
  WHERE {_B} IS NOT NULL AND nioktr_types IS NOT NULL GROUP BY nioktr_types
  ORDER BY v DESC, nioktr_types LIMIT 8)
""" + "".join(
    f"UNION ALL SELECT 'distribution', '{n}', count(*) FILTER (WHERE {_B} {t}), NULL FROM kept\n"
    for t, n in zip(_TESTS, _NAMES))))
def a12(spark, sf):
    df = projects(spark, sf, "year", "nioktr_types", "executor_name", _B)
    cube = written(metrics.budget_cube(df, EDGES), "budget")
    figures = metrics.budget_stats(cube, FilterSpec(year=1998, nioktr_type="low"), YEARS)
    figures["distribution"] = figures["distribution"].unpivot([], list(_NAMES), "item", "n")
    return _stacked(figures, {
        "by_year": ("year", "projects", "total_billions"),
        "top_orgs_by_budget": ("executor_name", "projects", "total_billions"),
        "by_type": ("nioktr_types", "projects", "total_billions"),
        "distribution": ("item", "n", None),
    })


@query("a22_numeric_profile", with_projects(
    f"SELECT count({_B}) AS filled, {dec_round(f'count({_B}) / count(*)', 6)} AS share, "
    f"{dec_round(_SUM, 2)} AS sum, {dec_round(f'{_SUM} / count({_B})', 2)} AS mean, "
    f"{dec_round(f'median({_B})', 4)} AS median FROM projects"))
def a22(spark, sf):
    return profile.numeric_profile(projects(spark, sf, _B), _B)


@query("a23_log_histogram", with_projects(f""", logs AS (
  SELECT log10({_B}) AS x FROM projects WHERE {_B} > 0
), edges AS (SELECT min(x) AS lo, (max(x) - min(x)) / 50 AS width FROM logs),
counts AS (SELECT CAST(least(floor((x - lo) / width), 49) AS INTEGER) AS bin, count(*) AS n
  FROM logs, edges GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, {dec_round('lo + b * width', 6)} AS low,
  {dec_round('lo + (b + 1) * width', 6)} AS high, coalesce(n, 0) AS count
FROM (SELECT unnest(range(50)) AS b) CROSS JOIN edges LEFT JOIN counts ON b = bin"""))
def a23(spark, sf):
    return profile.log_histogram(projects(spark, sf, _B), _B, 50)


@query("x10_round_dec",
       "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
       f"{dec_round('l_extendedprice * l_discount / 1000', 2)} AS rounded FROM lineitem")
def x10(spark, sf):
    amount = F.col("l_extendedprice") * F.col("l_discount") / 1000
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        numeric.round_dec(amount, 2).alias("rounded"))


@query("x11_null_defaults", with_projects(
    f"SELECT registration_number, coalesce({_B}, 0) AS budget, "
    "coalesce(supervisor_full_name, '') AS supervisor, "
    "coalesce(executor_ogrn, executor_name) AS id FROM projects"))
def x11(spark, sf):
    return projects(spark, sf, "registration_number", _B, "supervisor_full_name", "executor_ogrn",
                    "executor_name").select(
        "registration_number", F.coalesce(_B, F.lit(0.0)).alias("budget"),
        F.coalesce("supervisor_full_name", F.lit("")).alias("supervisor"),
        F.coalesce("executor_ogrn", "executor_name").alias("id"))


# positions made from the given numbers: latitudes 41 to 74, longitudes -180 to 180
_LAT_SQL, _LON_SQL = "(41 + c_custkey % 34)", "(c_custkey * 7 % 360 - 180)"
_MERC = "ln(tan(pi() / 4 + ({}) * pi() / 360))"


_EAST = f"CASE WHEN {_LON_SQL} < -10 THEN {_LON_SQL} + 360 ELSE {_LON_SQL} END"
_NORTH, _SOUTH = _MERC.format(74), _MERC.format(41)
_X_SQL = dec_round(f"({_EAST} - 19) / (192 - 19) * 780", 4)
_Y_SQL = dec_round(f"({_NORTH} - {_MERC.format(_LAT_SQL)}) / ({_NORTH} - {_SOUTH}) * 430", 4)


@query("x13_mercator_xy", f"SELECT c_custkey, {_X_SQL} AS x, {_Y_SQL} AS y FROM customer")
def x13(spark, sf):
    lat = F.lit(41) + F.col("c_custkey") % 34
    lon = F.col("c_custkey") * 7 % 360 - 180
    return table(spark, sf, "customer").select(
        "c_custkey", numeric.round_dec(numeric.mercator_x(lon), 4).alias("x"),
        numeric.round_dec(numeric.mercator_y(lat), 4).alias("y"))


@query("x14_sqrt_scale",
       "SELECT p_partkey, "
       f"{dec_round('greatest(4, sqrt(p_retailprice / 3000.0) * 36)', 6)} AS bubble, "
       f"{dec_round('least(30, greatest(9, 9 + sqrt(p_size / 50.0) * 22))', 6)} AS node FROM part")
def x14(spark, sf):
    bubble = numeric.sqrt_scale(F.col("p_retailprice"), F.lit(3000.0), 4, 36)
    node = numeric.sqrt_scale(F.col("p_size"), F.lit(50.0), 9, 22, base=9, hi=30)
    return table(spark, sf, "part").select(
        "p_partkey", numeric.round_dec(bubble, 6).alias("bubble"),
        numeric.round_dec(node, 6).alias("node"))
