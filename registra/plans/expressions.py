"""Queries: text expressions (X1-X9, X12) over names made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from registra.functions import text
from registra.plans.projects import table
from registra.plans.registry import query, quoted, sql_fixed, sql_strip

# Customer names inside typical organisation names.
_FORMS = (
    ("ФГБОУ ВО «", "»"),
    ("Федеральное государственное бюджетное образовательное учреждение высшего образования \"",
     "\""),
    ("государственное автономное учреждение науки  ", " "),
    ("", ""),
)


def _names(spark, sf):
    name = F.col("c_name")
    form = F.lit(None).cast("string")
    for i, (a, b) in enumerate(_FORMS):
        form = F.when(F.col("c_custkey") % len(_FORMS) == i, F.concat(F.lit(a), name, F.lit(b))).otherwise(form)
    return table(spark, sf, "customer").select("c_custkey", form.alias("org"))


NAMES_SQL = "WITH names AS (SELECT c_custkey, CASE c_custkey % 4 " + " ".join(
    f"WHEN {i} THEN {quoted(a)} || c_name || {quoted(b)}" for i, (a, b) in enumerate(_FORMS)
) + " END AS org FROM customer) "


def _sub(expr: str, pattern: str, to: str = "", all_of: bool = True) -> str:
    flags = ", 'g'" if all_of else ""
    return f"regexp_replace({expr}, {quoted(pattern)}, {quoted(to)}{flags})"


def _phrases_sql(phrases) -> str:
    expr = "org"
    for p in phrases:
        expr = _sub(expr, "(?i)" + p)
    return f"trim({_sub(_sub(expr, text.NAME_QUOTES), r'\s+', ' ')})"


@query("x01_norm_keyword",
       "SELECT k, count(*) AS n FROM (SELECT lower(trim(unnest(string_split(text, ' ')))) AS k "
       "FROM documents) GROUP BY k")
def x01(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy(text.norm_keyword(F.col("w")).alias("k")).agg(
        F.count(F.lit(1)).alias("n"))


@query("x02_strip",
       f"SELECT doc_id, {sql_strip(quoted(' ') + ' || chr(160) || text || chr(8195) || chr(10)')} "
       "AS stripped FROM documents")
def x02(spark, sf):
    padded = F.concat(F.lit("  "), "text", F.lit(" \n"))
    return table(spark, sf, "documents").select("doc_id", text.strip(padded).alias("stripped"))


@query("x03_tags",
       "SELECT doc_id, array_to_string(list_slice(list_filter(list_transform("
       f"regexp_split_to_array(text, '[;,]'), lambda x: {sql_strip('x')}), lambda x: x <> ''), 1, 5), "
       "' | ') AS tags FROM documents")
def x03(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(text.tags(F.col("text"), 5), " | ").alias("tags"))


_BARE = "trim(" + _sub(
    f"trim({_sub('org', '(?i)' + text.LEGAL_PREFIX, all_of=False)})",
    f"^[{text.LABEL_QUOTES}]+|[{text.LABEL_QUOTES}]+$") + ")"


@query("x04_clean_org_label",
       f"{NAMES_SQL} SELECT c_custkey, CASE WHEN length({_BARE}) > 4 THEN {_BARE} ELSE org END AS label "
       "FROM names")
def x04(spark, sf):
    return _names(spark, sf).select("c_custkey", text.clean_org_label(F.col("org")).alias("label"))


_SHORT = _phrases_sql(text.SHORT_NAME_PHRASES)


@query("x05_short_name",
       f"{NAMES_SQL} SELECT c_custkey, CASE WHEN length({_SHORT}) > 15 THEN "
       f"substring({_SHORT}, 1, 15) || '…' ELSE {_SHORT} END AS short FROM names")
def x05(spark, sf):
    return _names(spark, sf).select("c_custkey", text.short_name(F.col("org"), 15).alias("short"))


_NODE = _phrases_sql(text.NODE_LABEL_PHRASES)


@query("x06_node_label",
       f"{NAMES_SQL} SELECT c_custkey, substring(CASE WHEN {_NODE} <> '' THEN {_NODE} ELSE org END, 1, 16) "
       "AS institution, substring(org, 1, 16) AS topic FROM names")
def x06(spark, sf):
    org = F.col("org")
    return _names(spark, sf).select(
        "c_custkey", text.node_label(org, "institutions", 16).alias("institution"),
        text.node_label(org, "topics", 16).alias("topic"))


_LONG, _ABBR = text.ABBREVIATIONS[0]


@query("x07_shorten",
       f"SELECT c_custkey, substring(trim(replace({quoted(_LONG + ' ')} || c_name, {quoted(_LONG)}, "
       f"{quoted(_ABBR)})), 1, 25) AS short FROM customer")
def x07(spark, sf):
    org = F.concat(F.lit(_LONG + " "), "c_name")
    return table(spark, sf, "customer").select("c_custkey", text.shorten(org, 25).alias("short"))


@query("x08_registry_link",
       f"SELECT o_orderkey, {quoted(text.REGISTRY_SEARCH_URL)} || url_encode(o_orderpriority || '/#' "
       "|| o_orderkey) AS link FROM orders")
def x08(spark, sf):
    key = F.concat("o_orderpriority", F.lit("/#"), F.col("o_orderkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", text.registry_link(key).alias("link"))


def _budget_sql(c: str, digits: int) -> str:
    return (f"CASE WHEN {c} IS NULL OR {c} = 0 THEN '—' "
            f"WHEN {c} >= 1000000 THEN {sql_fixed(f'{c} / 1000000', 1)} || ' млрд ₽' "
            f"WHEN {c} >= 1000 THEN {sql_fixed(f'{c} / 1000', digits)} || ' млн ₽' "
            f"ELSE replace(format('{{:,}}', CAST(floor({c} + 0.5) AS BIGINT)), ',', chr(160)) "
            "|| ' тыс ₽' END")


def _trend_sql(c: str, digits: int, unit: str) -> str:
    return (f"CASE WHEN {c} >= 1 THEN {sql_fixed(c, digits)} || ' млрд{unit}' "
            f"WHEN {c} > 0 THEN {sql_fixed(f'{c} * 1000', 0)} || ' млн{unit}' ELSE '—' END")


_FINE = "CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_acctbal END"


@query("x09_format_budget",
       f"SELECT c_custkey, {_budget_sql('v', 1)} AS list, {_budget_sql('v * 1000', 0)} AS map, "
       f"{_trend_sql('v / 5000', 1, '')} AS trend, {_trend_sql('v / 5000', 2, ' ₽')} AS trend_full, "
       "CASE WHEN n = 0 THEN '—' WHEN n >= 1000 THEN "
       f"{sql_fixed('n / 1000', 1)} || 'k' ELSE CAST(n AS VARCHAR) END AS count_short, "
       "CASE WHEN n = 0 THEN '—' ELSE replace(format('{:,}', n), ',', chr(160)) || ' проектов' END "
       f"AS count_full FROM (SELECT c_custkey, {_FINE} AS v, c_custkey * 3 AS n FROM customer)")
def x09(spark, sf):
    v = F.when(F.col("c_custkey") % 10 == 0, F.lit(0.0)).otherwise(F.col("c_acctbal"))
    n = F.col("c_custkey") * 3
    return table(spark, sf, "customer").select(
        "c_custkey", text.format_budget(v, "list").alias("list"),
        text.format_budget(v * 1000, "map").alias("map"),
        text.format_budget(v / 5000, "trend").alias("trend"),
        text.format_budget(v / 5000, "trend_full").alias("trend_full"),
        text.format_count(n).alias("count_short"), text.format_count(n, True).alias("count_full"))


@query("x12_prefix",
       "SELECT doc_id, substring(text, 1, 600) AS snippet, substring(text, 1, 2000) AS source_text "
       "FROM documents")
def x12(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", text.prefix(c, 600).alias("snippet"), text.prefix(c, 2000).alias("source_text"))


@query("x12_date_text",
       "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS start FROM orders")
def x12_date(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", text.prefix(F.col("o_orderdate").cast("string"), 10).alias("start"))
