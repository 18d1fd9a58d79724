"""Queries: filters, joins of records, pages and top-k, set operations (F, J5, T, U, W8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registra.operators import filters, paging
from registra.operators.changes import pending
from registra.operators.cleaning import dedup_keep_last
from registra.operators.filters import FilterSpec
from registra.plans.projects import YEARS, projects, table, with_projects
from registra.plans.registry import query

SPEC = FilterSpec(
    year=1998, nioktr_type="low", search="customer#00000001, Brand#1_;, %gear%", institution="#0"
)
TYPE_SQL = "nioktr_types ILIKE '%low%'"
SEARCH_SQL = "(" + " OR ".join(
    f"{c} ILIKE '{p}'"
    for p in ("%customer#00000001%", "%Brand#1_;%", "%%gear%%")
    for c in ("name", "annotation", "keyword_list")
) + ")"
SPEC_SQL = f"year = 1998 AND {TYPE_SQL} AND {SEARCH_SQL} AND executor_name ILIKE '%#0%'"
_KEY = "registration_number"


@query("f01_by_year", with_projects(f"SELECT {_KEY}, year FROM projects WHERE year = 1998"))
def f01(spark, sf):
    return filters.by_year(filters.by_year(projects(spark, sf, _KEY, "year"), 0), 1998)


@query("f02_contains_ci", with_projects(
    f"SELECT {_KEY}, nioktr_types FROM projects WHERE {TYPE_SQL}"))
def f02(spark, sf):
    df = projects(spark, sf, _KEY, "nioktr_types")
    return df.where(filters.contains_ci(F.col("nioktr_types"), "LoW"))


@query("f03_search_any", with_projects(f"SELECT {_KEY}, name FROM projects WHERE {SEARCH_SQL}"))
def f03(spark, sf):
    df = projects(spark, sf, _KEY, *filters.SEARCH_COLUMNS)
    return FilterSpec(search=SPEC.search).apply(df).select(_KEY, "name")


@query("f04_institution", with_projects(
    f"SELECT {_KEY}, executor_name FROM projects WHERE executor_name ILIKE '%0017%'"))
def f04(spark, sf):
    return FilterSpec(institution="0017").apply(projects(spark, sf, _KEY, "executor_name"))


@query("f05_filter_spec", with_projects(
    f"SELECT {_KEY}, year, nioktr_types, executor_name FROM projects WHERE {SPEC_SQL}"))
def f05(spark, sf):
    df = projects(spark, sf, _KEY, "year", "nioktr_types", "executor_name",
                  *filters.SEARCH_COLUMNS)
    return SPEC.apply(df).select(_KEY, "year", "nioktr_types", "executor_name")


@query("f06_year_between", with_projects(
    f"SELECT {_KEY}, year FROM projects WHERE year BETWEEN {YEARS[0]} AND {YEARS[1]}"))
def f06(spark, sf):
    return projects(spark, sf, _KEY, "year").where(filters.year_between(*YEARS))


@query("f07_not_null_guards", with_projects(
    f"SELECT {_KEY}, supervisor_full_name FROM projects WHERE supervisor_full_name IS NOT NULL "
    "AND budget_total_thousands IS NOT NULL AND executor_name IS NOT NULL"))
def f07(spark, sf):
    columns = ("supervisor_full_name", "budget_total_thousands", "executor_name")
    return projects(spark, sf, _KEY, *columns).dropna(subset=list(columns)).select(
        _KEY, "supervisor_full_name")


@query("f08_valid_keyword", with_projects(
    "SELECT kw, count(*) AS n FROM (SELECT unnest(string_split(keyword_list, ';')) AS kw "
    "FROM projects) WHERE trim(kw) <> '' AND length(trim(kw)) BETWEEN 5 AND 8 GROUP BY kw"))
def f08(spark, sf):
    words = projects(spark, sf, "keyword_list").select(
        F.explode(F.split("keyword_list", ";")).alias("kw"))
    kept = words.where(filters.valid_keyword(F.col("kw"), 5, 8))
    return kept.groupBy("kw").agg(F.count(F.lit(1)).alias("n"))


_LOOKUP = with_projects(
    f"SELECT {_KEY}, name, year FROM projects WHERE {_KEY} IN "
    "(SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang = 'en')")


@query("f09_lookup", _LOOKUP)
def f09(spark, sf):
    keys = table(spark, sf, "documents").where("lang = 'en'").select(
        F.col("doc_id").cast("string").alias(_KEY))
    return filters.lookup(projects(spark, sf, _KEY, "name", "year"), keys)


@query("f09_lookup_report",
       f"SELECT DISTINCT CAST(l_partkey * 9 AS VARCHAR) AS {_KEY}, EXISTS (SELECT 1 FROM orders "
       "WHERE o_orderkey = l_partkey * 9) AS found FROM lineitem")
def f09_report(spark, sf):
    keys = table(spark, sf, "lineitem").select((F.col("l_partkey") * 9).cast("string").alias(_KEY))
    return filters.lookup_report(projects(spark, sf, _KEY), keys)


@query("f10_project_list_view", with_projects(
    f"SELECT {_KEY}, name, annotation, executor_name AS institution, executor_okogu AS ministry, "
    "year, start_date, end_date, nioktr_types, budget_total_thousands, supervisor_full_name, "
    "keyword_list, rubrics, stages_count, reports_number FROM projects"))
def f10(spark, sf):
    return filters.project_list_view(projects(spark, sf))


# ---- anti joins and set operations --------------------------------------------------------

_PENDING = ("SELECT CAST(o_orderkey AS VARCHAR) AS registration_number FROM orders "
            "WHERE o_orderkey NOT IN (SELECT doc_id FROM documents)")


@query("j05_pending", _PENDING)
def j05(spark, sf):
    done = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias(_KEY))
    return pending(projects(spark, sf, _KEY), done)


@query("u03_set_difference", _PENDING)
def u03(spark, sf):
    return j05(spark, sf)


@query("u01_union_all",
       "SELECT c_name AS name, c_nationkey AS okogu FROM customer "
       "UNION ALL SELECT s_name, s_nationkey FROM supplier")
def u01(spark, sf):
    from registra.sources.snapshots import union_snapshots

    return union_snapshots(
        table(spark, sf, "customer").selectExpr("c_name name", "c_nationkey okogu"),
        table(spark, sf, "supplier").selectExpr("s_nationkey okogu", "s_name name"))


@query("u04_set_membership", _LOOKUP)
def u04(spark, sf):
    return f09(spark, sf)


@query("w08_keep_last",
       "SELECT conv_id, turn, role FROM conversations "
       "QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) = 1")
def w08(spark, sf):
    turns = table(spark, sf, "conversations").drop("text")
    return dedup_keep_last(turns, "conv_id", ["turn", "role"])


# ---- pages and top-k ----------------------------------------------------------------------

_PAGE_SQL = (f"SELECT {_KEY}, name, year FROM projects WHERE {SEARCH_SQL} "
             f"ORDER BY year DESC NULLS LAST, {_KEY} LIMIT 20 OFFSET 20")


def _searched(spark, sf):
    df = projects(spark, sf, _KEY, "year", *filters.SEARCH_COLUMNS)
    return FilterSpec(search=SPEC.search).apply(df).select(_KEY, "name", "year")


@query("t01_page", with_projects(_PAGE_SQL))
def t01(spark, sf):
    return paging.page(_searched(spark, sf), 2, 20)


@query("t01_page_after", with_projects(
    f"SELECT {_KEY}, name, year FROM projects WHERE year < 1999 OR year IS NULL "
    f"OR (year = 1999 AND {_KEY} > '5') ORDER BY year DESC NULLS LAST, {_KEY} LIMIT 20"))
def t01_after(spark, sf):
    return paging.page_after(projects(spark, sf, _KEY, "name", "year"), 1999, "5", 20)


@query("t02_page_info", with_projects(
    "SELECT count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS pages "
    f"FROM projects WHERE {SEARCH_SQL}"))
def t02(spark, sf):
    return paging.page_info(_searched(spark, sf), 20)


_TOP = ("SELECT p_name, sum(n)::BIGINT AS n FROM (SELECT l_partkey, count(*) AS n FROM lineitem "
        "GROUP BY 1) JOIN part ON l_partkey = p_partkey GROUP BY p_name ORDER BY n DESC, p_name ")


def _part_counts(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_name").agg(F.sum("n").alias("n"))


@query("t03_top_k", _TOP + "LIMIT 10")
def t03(spark, sf):
    return paging.top_k(_part_counts(spark, sf), [F.desc("n"), F.asc("p_name")], 10)


@query("t04_most_common", _TOP + "LIMIT 25")
def t04(spark, sf):
    return paging.top_k(_part_counts(spark, sf), [F.desc("n"), F.asc("p_name")], 25)


