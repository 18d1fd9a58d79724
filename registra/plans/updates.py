"""Queries: batches of changes (M). Customers, renumbered, act as changes to orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from registra.operators import changes
from registra.plans.projects import projects, table, with_projects
from registra.plans.registry import query
from registra.sources.tables import KEY

_COLUMNS = (KEY, "name", "year", "nioktr_types", "budget_total_thousands", "executor_name",
            "reports_number")
_SHOWN = ", ".join(_COLUMNS)
STEP = 12  # customer numbers times this reach beyond the order numbers, so some keys are new


def _base(spark, sf):
    return projects(spark, sf, *_COLUMNS)


def _batch(spark, sf):
    return table(spark, sf, "customer").select(
        (F.col("c_custkey") * STEP).cast("string").alias(KEY),
        F.concat(F.lit("new "), "c_name").alias("name"),
        F.lit(2002).alias("year"),
        F.col("c_acctbal").alias("budget_total_thousands"),
    )


_BATCH_SQL = f"""batch AS (
  SELECT CAST(c_custkey * {STEP} AS VARCHAR) AS registration_number, 'new ' || c_name AS name,
    CAST(2002 AS INTEGER) AS year, c_acctbal AS budget_total_thousands FROM customer
)"""
_NEW_ROW = (f"SELECT {KEY}, name, year, NULL AS nioktr_types, budget_total_thousands, "
            "NULL AS executor_name, NULL AS reports_number FROM batch")


@query("m01_apply_inserts", with_projects(
    f", {_BATCH_SQL} SELECT {_SHOWN} FROM projects UNION ALL {_NEW_ROW} "
    f"WHERE {KEY} NOT IN (SELECT {KEY} FROM projects)"))
def m01(spark, sf):
    return changes.apply_inserts(_base(spark, sf), _batch(spark, sf), "name")[0]


@query("m01_insert_conflicts", with_projects(
    f", {_BATCH_SQL} SELECT * FROM batch WHERE {KEY} IN (SELECT {KEY} FROM projects)"))
def m01_conflicts(spark, sf):
    return changes.apply_inserts(_base(spark, sf), _batch(spark, sf), "name")[1]


@query("m02_apply_updates", with_projects(
    f", {_BATCH_SQL} SELECT p.{KEY}, " + ", ".join(
        f"CASE WHEN b.{KEY} IS NULL THEN p.{c} ELSE {new} END AS {c}" for c, new in (
            ("name", "b.name"), ("year", "b.year"), ("nioktr_types", "NULL"),
            ("budget_total_thousands", "b.budget_total_thousands"), ("executor_name", "NULL")))
    + f", reports_number FROM projects p LEFT JOIN batch b ON p.{KEY} = b.{KEY}"))
def m02(spark, sf):
    return changes.apply_updates(_base(spark, sf), _batch(spark, sf), "name")[0]


@query("m02_update_missing", with_projects(
    f", {_BATCH_SQL} SELECT * FROM batch WHERE {KEY} NOT IN (SELECT {KEY} FROM projects)"))
def m02_missing(spark, sf):
    return changes.apply_updates(_base(spark, sf), _batch(spark, sf), "name")[1]


@query("m03_apply_deletes", with_projects(
    f", {_BATCH_SQL} SELECT {_SHOWN} FROM projects WHERE {KEY} NOT IN (SELECT {KEY} FROM batch)"))
def m03(spark, sf):
    return changes.apply_deletes(_base(spark, sf), _batch(spark, sf))[0]


@query("m03_delete_missing", with_projects(
    f", {_BATCH_SQL} SELECT {KEY} FROM batch WHERE {KEY} NOT IN (SELECT {KEY} FROM projects)"))
def m03_missing(spark, sf):
    return changes.apply_deletes(_base(spark, sf), _batch(spark, sf))[1]


@query("m04_upsert", with_projects(
    f", {_BATCH_SQL} SELECT {_SHOWN} FROM projects WHERE {KEY} NOT IN (SELECT {KEY} FROM batch) "
    f"UNION ALL {_NEW_ROW}"))
def m04(spark, sf):
    base = _base(spark, sf)
    new = _batch(spark, sf).select(
        *[F.col(c) if c in (KEY, "name", "year", "budget_total_thousands")
          else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in _COLUMNS])
    return changes.upsert(base, new, order="name")
