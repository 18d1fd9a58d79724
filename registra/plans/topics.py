"""Queries: keyword trends, ranks, stacks and frequent terms (A13-A15, A21, A24, F11, J2, J6, W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registra.operators import keywords
from registra.operators.paging import top_k_per_group
from registra.plans.projects import (
    DOCUMENT_KEYWORDS_SQL, YEARS, document_keywords, projects, table, with_projects,
)
from registra.plans.registry import dec_round, money, query, sql_strip

_B = "budget_total_thousands"
_COLUMNS = ("year", _B, "keyword_list")
TOP = 12
RECORDS_PER_TASK = 250_000

CELLS_SQL = f"""cells AS (
  SELECT year, lower(trim(kw)) AS keyword, count(*) AS projects,
    coalesce({money(_B)}, 0) / 1000000 AS budget_billions
  FROM (SELECT year, {_B}, unnest(string_split(keyword_list, ';')) AS kw FROM projects
        WHERE year BETWEEN {YEARS[0]} AND {YEARS[1]} AND keyword_list IS NOT NULL)
  WHERE trim(kw) <> '' AND length(trim(kw)) BETWEEN 3 AND 60
  GROUP BY 1, 2 HAVING count(*) >= 2
)"""
TOP_SQL = f"""top AS (
  SELECT keyword, CAST(sum(projects) AS BIGINT) AS total FROM cells GROUP BY keyword
  ORDER BY total DESC, keyword LIMIT {TOP}
)"""
GRID_SQL = f"""{CELLS_SQL}, {TOP_SQL}, grid AS (
  SELECT t.keyword, t.total, y.year, coalesce(c.projects, 0) AS projects,
    coalesce({dec_round('c.budget_billions', 2)}, 0) AS budget
  FROM top t CROSS JOIN
    (SELECT CAST(unnest(range({YEARS[0]}, {YEARS[1]} + 1)) AS INTEGER) AS year) y
  LEFT JOIN cells c ON c.keyword = t.keyword AND c.year = y.year
)"""


def _cells(spark, sf):
    return keywords.keyword_cells(projects(spark, sf, *_COLUMNS), YEARS)


def _grid(spark, sf):
    return keywords.keyword_trends(projects(spark, sf, *_COLUMNS), TOP, YEARS)


@query("j02_explode_keywords", with_projects(
    "SELECT registration_number, kw AS keyword_raw, count(*) AS n FROM (SELECT registration_number, "
    "unnest(string_split(keyword_list, ';')) AS kw FROM projects) GROUP BY 1, 2"))
def j02(spark, sf):
    """The records are dealt out first, so that a task holds the keywords of so many, however large the input is."""
    tasks = -(-projects(spark, sf, "registration_number").count() // RECORDS_PER_TASK)
    records = projects(spark, sf, "registration_number", "keyword_list").repartition(max(1, tasks))
    parts = keywords.explode_keywords(records)
    return parts.groupBy("registration_number", "keyword_raw").agg(F.count(F.lit(1)).alias("n"))


@query("a13_keyword_cells", with_projects(
    f", {CELLS_SQL} SELECT year, keyword, projects, {dec_round('budget_billions', 6)} "
    "AS budget_billions FROM cells"))
def a13(spark, sf):
    from registra.functions.numeric import round_dec

    return _cells(spark, sf).withColumn("budget_billions", round_dec(F.col("budget_billions"), 6))


@query("a14_top_keywords", with_projects(f", {CELLS_SQL}, {TOP_SQL} SELECT * FROM top"))
def a14(spark, sf):
    return keywords.top_keywords(_cells(spark, sf), TOP)


@query("a15_keyword_trends", with_projects(f", {GRID_SQL} SELECT * FROM grid"))
def a15(spark, sf):
    return _grid(spark, sf)


@query("j06_densify", with_projects(f", {GRID_SQL} SELECT * FROM grid"))
def j06(spark, sf):
    cells = _cells(spark, sf)
    return keywords.densify(cells, keywords.top_keywords(cells, TOP), YEARS)


@query("f11_active_topics", with_projects(
    f", {GRID_SQL} SELECT * FROM grid WHERE keyword IN "
    "(SELECT keyword FROM grid WHERE projects > 0 OR budget > 0)"))
def f11(spark, sf):
    return keywords.active_topics(_grid(spark, sf))


@query("a21_year_totals", with_projects(
    f", {GRID_SQL} SELECT year, CAST(sum(projects) AS BIGINT) AS projects, "
    f"{money('budget')} AS budget FROM grid GROUP BY year"))
def a21(spark, sf):
    return keywords.year_totals(_grid(spark, sf))


def _rank_sql(metric):
    return ("SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY "
            f"{metric} DESC, total DESC, keyword) AS INTEGER) AS rank FROM grid")


@query("w01_yearly_rank", with_projects(f", {GRID_SQL} {_rank_sql('budget')}"))
def w01(spark, sf):
    return keywords.yearly_rank(_grid(spark, sf), "budget")


@query("w02_rank_in_year", with_projects(
    f", {GRID_SQL} SELECT * FROM ({_rank_sql('projects')}) WHERE year = {YEARS[1]}"))
def w02(spark, sf):
    return keywords.rank_in_year(_grid(spark, sf), YEARS[1])


_BANDS_SQL = """bands AS (
  SELECT keyword, total, year, projects AS val,
    CAST(sum(projects) OVER w - projects AS BIGINT) AS bottom,
    CAST(sum(projects) OVER w AS BIGINT) AS top
  FROM grid WINDOW w AS (PARTITION BY year ORDER BY total DESC, keyword
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""


@query("w03_stack_bands", with_projects(f", {GRID_SQL}, {_BANDS_SQL} SELECT * FROM bands"))
def w03(spark, sf):
    return keywords.stack_bands(_grid(spark, sf))


@query("w04_stack_max", with_projects(
    f", {GRID_SQL}, {_BANDS_SQL} SELECT CAST(greatest(max(top), 1) AS DOUBLE) AS stack_max "
    "FROM bands"))
def w04(spark, sf):
    return keywords.stack_max(keywords.stack_bands(_grid(spark, sf)))


@query("w05_peak_year", with_projects(
    f", {GRID_SQL} SELECT keyword, year AS peak_year, projects AS peak_value FROM grid "
    "QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY projects DESC, year) = 1"))
def w05(spark, sf):
    return keywords.peak_year(_grid(spark, sf))


@query("w06_share_of_max", with_projects(
    f", {GRID_SQL} SELECT keyword, year, projects, projects / max(projects) OVER (PARTITION BY year) "
    "AS share FROM grid"))
def w06(spark, sf):
    grid = _grid(spark, sf).select("keyword", "year", "projects")
    return keywords.share_of_max(grid, "projects", ["year"])


@query("w06_share_of_all",
       "SELECT o_orderkey, o_totalprice / (SELECT max(o_totalprice) FROM orders) AS share FROM orders")
def w06_all(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return keywords.share_of_max(orders, "o_totalprice").drop("o_totalprice")


@query("w07_top_k_per_group",
       "SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey "
       "ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 5")
def w07(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_k_per_group(
        orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)


@query("a24_top_terms", f"""WITH {DOCUMENT_KEYWORDS_SQL}
SELECT term, count(*) AS count FROM (
  SELECT lower({sql_strip("unnest(regexp_split_to_array(keyword_list, '[;,]'))")}) AS term FROM docs
) WHERE term <> '' GROUP BY term ORDER BY count DESC, term LIMIT 20""")
def a24(spark, sf):
    return keywords.top_terms(document_keywords(spark, sf), n=20)
