"""Queries: sources, nested values and cleaning (S, N, C)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registra.functions import nested
from registra.operators import cleaning, profile
from registra.plans.projects import (
    cards, projects, table, with_cards, with_projects,
)
from registra.plans.registry import dec_round, money, query, sql_strip
from registra.session import shared_dir
from registra.sources import snapshots, tables

# ---- sources ------------------------------------------------------------------------------


@query("s01_read_snapshots", with_cards(
    "SELECT registration_number, year_file, n_name AS okogu, CAST(len(budgets) AS INTEGER) AS budgets "
    "FROM (SELECT *, source_file AS year_file FROM cards)"
))
def s01(spark, sf):
    path = shared_dir(spark, "snapshots")
    raw = cards(spark, sf)
    schema = raw.drop("pos").withColumnRenamed("source_file", "year_file").schema
    raw.drop("pos").withColumnRenamed("source_file", "year_file").write.json(path)
    back = snapshots.read_snapshots(spark, path, schema=schema, lines=True)
    return back.select(
        "registration_number", "year_file", F.col("executor.okogu").alias("okogu"),
        F.size("budgets").alias("budgets"),
    )


def _write_envelopes(cards, path):
    """Documents of many cards each, one per task, with what a reader must not trip over around the cards."""

    def document(batches):
        mark = r'{"note": "a \" b", "cards": ['
        for batch in batches:
            lines = []
            for card in batch.column(0).to_pylist():
                lines.append(mark + card)
                mark = ","
            yield pa.record_batch([pa.array(lines, pa.string())], names=["value"])
        end = '], "more": {"a": {"b": "]"}, "c": [{}]}}'
        yield pa.record_batch([pa.array([end if mark == "," else mark + end])], names=["value"])

    rows = cards.repartition("registration_number").sortWithinPartitions("registration_number", "pos")
    rows.select(F.to_json(F.struct(*cards.drop("pos").columns))).mapInArrow(document, "value string").write.text(path)


@query("s01_envelopes", with_cards(
    "SELECT registration_number, source_file AS year_file, n_name AS okogu, CAST(len(budgets) AS INTEGER) AS budgets, "
    "CAST(row_number() OVER (PARTITION BY source_file, registration_number ORDER BY o_orderkey) AS INTEGER) AS place FROM cards"
))
def s01_envelopes(spark, sf):
    """The cards of a key are in one document, in their order."""
    path = shared_dir(spark, "envelopes")
    raw = cards(spark, sf).withColumnRenamed("source_file", "year_file")
    _write_envelopes(raw, path)
    back = snapshots.read_envelopes(spark, path, raw.drop("pos").schema)
    order = Window.partitionBy("year_file", "registration_number").orderBy("source_file", "pos")
    return back.select(
        "registration_number", "year_file", F.col("executor.okogu").alias("okogu"),
        F.size("budgets").alias("budgets"), F.row_number().over(order).alias("place"),
    )


@query("s02_flatten_structs", with_cards(
    "SELECT registration_number, c_name AS executor_name, CAST(c_custkey AS VARCHAR) AS executor_ogrn, "
    "n_name AS executor_okogu, c_mktsegment AS executor_detail_segment, "
    "c_mktsegment AS work_supervisor_surname, middle AS work_supervisor_name, "
    "c_name AS work_supervisor_patronymic FROM cards"
))
def s02(spark, sf):
    return snapshots.flatten_structs(
        cards(spark, sf).select("registration_number", "executor", "work_supervisor")
    )


@query("s03_union_snapshots",
       "SELECT c_name AS name, c_acctbal AS budget, NULL::VARCHAR AS brand, c_nationkey AS okogu "
       "FROM customer UNION ALL SELECT p_name, p_retailprice, p_brand, NULL FROM part "
       "UNION ALL SELECT s_name, s_acctbal, NULL, s_nationkey FROM supplier")
def s03(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_name name", "c_acctbal budget", "c_nationkey okogu")
    p = table(spark, sf, "part").selectExpr("p_name name", "p_brand brand", "p_retailprice budget")
    s = table(spark, sf, "supplier").selectExpr("s_nationkey okogu", "s_name name", "s_acctbal budget")
    return snapshots.union_snapshots(c, p, s)


@query("s04_with_source",
       "SELECT 'orders.parquet' AS source_file, count(*) AS record_count FROM orders "
       "UNION ALL SELECT 'customer.parquet', count(*) FROM customer")
def s04(spark, sf):
    frames = [
        snapshots.with_source(table(spark, sf, t)).select("source_file")
        for t in ("orders", "customer")
    ]
    tagged = snapshots.union_snapshots(*frames)
    return tagged.groupBy("source_file").agg(F.count(F.lit(1)).alias("record_count"))


_ROUND_TRIP = (
    "SELECT registration_number, executor_name, year, budget_total_thousands FROM projects"
)


def _written(spark, sf):
    path = shared_dir(spark, "clean")
    tables.write_clean(
        projects(spark, sf, "registration_number", "executor_name", "year",
                 "budget_total_thousands"), path)
    return path


@query("s05_write_clean", with_projects(_ROUND_TRIP))
def s05(spark, sf):
    return spark.read.parquet(_written(spark, sf))


@query("s06_read_clean", with_projects(
    "SELECT year, count(*) AS record_count FROM projects GROUP BY year"))
def s06(spark, sf):
    back = tables.read_clean(spark, _written(spark, sf))
    return back.groupBy("year").agg(F.count(F.lit(1)).alias("record_count"))


def _loaded(spark, sf, name):
    path = shared_dir(spark, name)
    frame = cleaning.truncate_text(cleaning.nan_to_null(
        projects(spark, sf, "registration_number", "executor_name", "year")))
    return tables.load_table(frame, name, path)


@query("s07_load_table", "SELECT count(*) AS record_count FROM orders")
def s07(spark, sf):
    _loaded(spark, sf, "registra_s07")
    return spark.table("registra_s07").agg(F.count(F.lit(1)).alias("record_count"))


@query("s08_table_scan", with_projects(
    "SELECT registration_number, executor_name, year FROM projects"))
def s08(spark, sf):
    _loaded(spark, sf, "registra_s08")
    return spark.table("registra_s08")


@query("s09_table_ready",
       "SELECT 'loaded' AS name, count(*) > 0 AS ready FROM orders UNION ALL SELECT 'absent', false")
def s09(spark, sf):
    _loaded(spark, sf, "registra_s09")
    loaded = spark.table("registra_s09").agg(
        F.lit("loaded").alias("name"), (F.count(F.lit(1)) > 0).alias("ready")
    )
    both = {n: tables.table_ready(spark, n) for n in ("registra_s09", "registra_absent")}
    if not both["registra_s09"]:
        loaded = loaded.withColumn("ready", F.lit(False))
    absent = loaded.select(
        F.lit("absent").alias("name"), F.lit(both["registra_absent"]).alias("ready"))
    return loaded.unionByName(absent)


@query("s10_vector_table_check",
       "SELECT count(*) AS row_count, count(*) FILTER (WHERE vec_id IS NULL) AS null_keys, "
       "count(vec_id) - count(DISTINCT vec_id) AS duplicates, "
       "count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_length FROM embeddings")
def s10(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("registration_number"), "embedding",
        F.lit(None).cast("string").alias("source_text"))
    store = tables.empty_vector_table(spark).unionByName(rows)
    return tables.check_vector_table(store, 64)


# ---- nested values ------------------------------------------------------------------------


def _card_value(spark, sf, name, expr):
    return cards(spark, sf).select("pos", expr.alias(name))


@query("n01_join_strings", with_cards(
    "SELECT pos, CASE WHEN len(keyword_list) > 0 THEN array_to_string("
    "list_filter(keyword_list, lambda x: x IS NOT NULL AND x <> ''), '; ') END AS joined FROM cards"))
def n01(spark, sf):
    return _card_value(spark, sf, "joined", nested.join_strings(F.col("keyword_list")))


@query("n02_join_field", with_cards(
    "SELECT pos, nullif(array_to_string(list_filter(rubrics, lambda x: x IS NOT NULL), '; '), '') "
    "AS joined FROM cards"))
def n02(spark, sf):
    return _card_value(spark, sf, "joined", nested.join_field(F.col("rubrics")))


@query("n03_sum_field", with_cards(
    "SELECT pos, nullif(list_sum(list_transform(budgets, "
    "lambda x: coalesce(TRY_CAST(x AS DOUBLE), 0.0))), 0) AS total FROM cards"))
def n03(spark, sf):
    return _card_value(spark, sf, "total", nested.sum_field(F.col("budgets")))


@query("n04_list_count", with_cards(
    "SELECT pos, CAST(coalesce(stages, 0) AS INTEGER) AS stages FROM cards"))
def n04(spark, sf):
    return _card_value(spark, sf, "stages", nested.list_count(F.col("stages")))


@query("n05_join_first_of", with_cards(
    "SELECT pos, array_to_string(list_filter(coexecutors, lambda x: x <> ''), '; ') AS joined "
    "FROM cards"))
def n05(spark, sf):
    return _card_value(
        spark, sf, "joined", nested.join_first_of(F.col("coexecutors"), ["name", "short_name"]))


@query("n06_full_name", with_cards(
    "SELECT pos, trim(c_mktsegment || ' ' || coalesce(middle, '') || ' ' || c_name) AS full_name "
    "FROM cards"))
def n06(spark, sf):
    s = F.col("work_supervisor")
    return _card_value(
        spark, sf, "full_name", nested.full_name(s["surname"], s["name"], s["patronymic"]))


# ---- cleaning -----------------------------------------------------------------------------


@query("c01_drop_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def c01(spark, sf):
    return cleaning.drop_columns(
        table(spark, sf, "orders"),
        ["o_orderstatus", "o_orderdate", "o_orderpriority", "not_there"])


_FILL_COLUMNS = ("registration_number", "annotation", "budget_total_thousands",
                 "supervisor_full_name", "keyword_list", "year")


@query("c02_fill_rates", with_projects(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS filled, count(*) AS total, "
    f"count({c}) / count(*) AS rate FROM projects" for c in _FILL_COLUMNS)))
def c02(spark, sf):
    return profile.fill_rates(projects(spark, sf, *_FILL_COLUMNS))


_SPARSE = ("pos", "reports_number", "udc_note", "never_filled", "start_date")


@query("c03_drop_sparse", with_cards("SELECT pos, reports_number, start_date FROM cards"))
def c03(spark, sf):
    return cleaning.drop_sparse(cards(spark, sf).select(*_SPARSE), 0.30)


@query("c04_drop_empty", with_cards(
    "SELECT pos, reports_number, start_date, "
    "CASE WHEN o_orderkey % 7 = 0 THEN 'rare' END AS udc_note FROM cards"))
def c04(spark, sf):
    return cleaning.drop_empty(cards(spark, sf).select(*_SPARSE))


_DATE = ("coalesce(try_strptime(start_date, '%Y-%m-%d'), try_strptime(start_date, '%d.%m.%Y'))")


@query("c05_parse_dates", with_cards(f"SELECT pos, {_DATE} AS start_date FROM cards"))
def c05(spark, sf):
    return cleaning.parse_dates(cards(spark, sf).select("pos", "start_date"))


@query("c06_with_year", with_cards(
    f"SELECT pos, CAST(year({_DATE}) AS INTEGER) AS year FROM cards"))
def c06(spark, sf):
    dated = cleaning.parse_dates(cards(spark, sf).select("pos", "start_date"))
    return cleaning.with_year(dated).select("pos", "year")


@query("c07_to_numeric", with_cards(
    "SELECT pos, TRY_CAST(reports_number AS DOUBLE) AS reports_number FROM cards"))
def c07(spark, sf):
    return cleaning.to_numeric(cards(spark, sf).select("pos", "reports_number"))


@query("c08_fill_int", with_cards(
    "SELECT pos, CAST(coalesce(trunc(TRY_CAST(reports_number AS DOUBLE)), 0) AS INTEGER) "
    "AS stages_count FROM cards"))
def c08(spark, sf):
    counted = cards(spark, sf).select(
        "pos", F.col("reports_number").try_cast("double").alias("stages_count"))
    return cleaning.fill_int(counted)


_JUNK_SQL = "('', 'Отсутствует', 'Нет', '-', 'None', 'null')"


@query("c09_null_junk", with_cards(
    f"SELECT pos, CASE WHEN {sql_strip('annotation')} NOT IN {_JUNK_SQL} THEN annotation END "
    "AS annotation FROM cards"))
def c09(spark, sf):
    return cleaning.null_junk(cards(spark, sf).select("pos", "annotation"))


@query("c10_dedup_keep_last",
       "SELECT user_id, event_id, ts, event_type, value FROM events QUALIFY row_number() OVER "
       "(PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def c10(spark, sf):
    events = table(spark, sf, "events").drop("props")
    return cleaning.dedup_keep_last(events, "user_id", ["ts", "event_id"])


@query("c11_duplicate_report",
       "SELECT count(*) AS total_rows, count(*) - count(DISTINCT user_id) AS duplicates, "
       + dec_round("(count(*) - count(DISTINCT user_id)) / count(*) * 100", 1)
       + " AS duplicate_percent, count(DISTINCT user_id) AS unique_rows FROM events")
def c11(spark, sf):
    return profile.duplicate_report(table(spark, sf, "events"), "user_id")


@query("c12_truncate_text",
       "SELECT doc_id, substring(text, 1, 2000) AS text, substring(lang, 1, 2000) AS lang "
       "FROM documents")
def c12(spark, sf):
    return cleaning.truncate_text(table(spark, sf, "documents").select("doc_id", "text", "lang"))


@query("c13_nan_to_null",
       "SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events")
def c13(spark, sf):
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    return cleaning.nan_to_null(table(spark, sf, "events").select("event_id", value.alias("value")))


@query("c14_run_summary", with_projects(
    "SELECT count(*) AS record_count, CAST(5 AS INTEGER) AS column_count, "
    "min(year) AS first_year, max(year) AS last_year, "
    + dec_round(f"coalesce({money('budget_total_thousands')}, 0) / 1000000", 1)
    + " AS total_billions, count(DISTINCT executor_name) AS institutions, "
    "(SELECT string_agg(t || ': ' || n, '; ' ORDER BY n DESC, t) FROM "
    "(SELECT nioktr_types AS t, count(*) AS n FROM projects GROUP BY 1 "
    "ORDER BY n DESC, t LIMIT 5)) AS top_types FROM projects"))
def c14(spark, sf):
    return profile.run_summary(projects(
        spark, sf, "registration_number", "year", "budget_total_thousands", "executor_name",
        "nioktr_types"))


@query("c15_clean_records", with_cards(f""", typed AS (
  SELECT registration_number, name,
    CASE WHEN {sql_strip('annotation')} NOT IN {_JUNK_SQL} THEN annotation END AS annotation,
    {_DATE} AS start_date, CAST(year({_DATE}) AS INTEGER) AS year,
    nullif(CASE WHEN len(keyword_list) > 0 THEN array_to_string(
      list_filter(keyword_list, lambda x: x IS NOT NULL AND x <> ''), '; ') END, '') AS keyword_list,
    nullif(list_sum(list_transform(budgets,
      lambda x: coalesce(TRY_CAST(x AS DOUBLE), 0.0))), 0) AS budget_total_thousands,
    CAST(coalesce(stages, 0) AS INTEGER) AS stages_count,
    trim(c_mktsegment || ' ' || coalesce(middle, '') || ' ' || c_name) AS supervisor_full_name,
    TRY_CAST(reports_number AS DOUBLE) AS reports_number, n_name AS executor_okogu,
    source_file, pos
  FROM cards
)
SELECT * EXCLUDE (source_file, pos) FROM typed QUALIFY row_number() OVER (
  PARTITION BY registration_number ORDER BY source_file DESC, pos DESC) = 1"""))
def c15(spark, sf):
    clean = cleaning.clean_records(cards(spark, sf))
    return clean.select(
        "registration_number", "name", "annotation", "start_date", "year", "keyword_list",
        "budget_total_thousands", "stages_count", "supervisor_full_name", "reports_number",
        "executor_okogu")
