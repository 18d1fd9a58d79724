"""The given tables seen as project records, raw cards, keyword lists and vectors.

Each view joins only what the requested columns need: a left join cannot be dropped by the
optimizer, since it does not know that dimension keys are unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

YEARS = (1996, 2001)  # years of the given orders that take the place of 2020-2025
EDGES = (100_000, 200_000, 300_000)  # budget classes scaled to the given prices

_CUSTOMER = {"name", "executor_name", "executor_ogrn", "rubrics", "executor_okogu", "keyword_list"}
_NATION = {"executor_okogu", "keyword_list"}
_FIRST_LINE = {"supervisor_full_name", "keyword_list"}

COLUMNS = (
    "registration_number", "name", "annotation", "executor_name", "executor_ogrn",
    "executor_okogu", "year", "start_date", "end_date", "nioktr_types", "budget_total_thousands",
    "supervisor_full_name", "keyword_list", "rubrics", "stages_count", "reports_number",
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def projects(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Orders as projects: customer = institution, supplier of the first line = supervisor."""
    wanted = columns or COLUMNS
    need = set(wanted)
    df = table(spark, sf, "orders")
    if need & _CUSTOMER:
        df = df.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    if need & _NATION:
        df = df.join(
            table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
        )
    if "annotation" in need:
        docs = table(spark, sf, "documents").select("doc_id", "text")
        df = df.join(docs, F.col("o_orderkey") == F.col("doc_id"), "left")
    if need & _FIRST_LINE:
        # min of a struct aggregates on the map side: one row per order and task is shuffled
        first = (
            table(spark, sf, "lineitem")
            .groupBy("l_orderkey")
            .agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("first"))
        )
        df = df.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    if "supervisor_full_name" in need:
        people = table(spark, sf, "supplier").select("s_suppkey", "s_name")
        df = df.join(people, F.col("first.l_suppkey") == F.col("s_suppkey"), "left")
    if "keyword_list" in need:
        parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
        df = df.join(parts, F.col("first.l_partkey") == F.col("p_partkey"), "left")

    expressions = {
        "registration_number": lambda: F.col("o_orderkey").cast("string"),
        "name": lambda: F.col("c_name"),
        "annotation": lambda: F.col("text"),
        "executor_name": lambda: F.col("c_name"),
        "executor_ogrn": lambda: F.col("c_custkey").cast("string"),
        "executor_okogu": lambda: F.col("n_name"),
        "year": lambda: F.year("o_orderdate").cast("int"),
        "start_date": lambda: F.col("o_orderdate"),
        "end_date": lambda: F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"),
        "nioktr_types": lambda: F.col("o_orderpriority"),
        "budget_total_thousands": lambda: F.when(
            F.col("o_orderstatus") != "P", F.col("o_totalprice")
        ),
        "supervisor_full_name": lambda: F.col("s_name"),
        "keyword_list": lambda: F.when(
            F.col("p_name").isNotNull(),
            F.concat_ws(
                "; ",
                F.replace("p_name", F.lit(" "), F.lit("; ")),
                "p_brand", "p_type", "c_mktsegment", "n_name",
            ),
        ),
        "rubrics": lambda: F.col("c_mktsegment"),
        "stages_count": lambda: (F.col("o_orderkey") % 7).cast("int"),
        "reports_number": lambda: (F.col("o_custkey") % 5).cast("double"),
    }
    return df.select(*[expressions[c]().alias(c) for c in wanted])


PROJECTS_SQL = """first_line AS (
  SELECT * FROM lineitem
  QUALIFY row_number() OVER (
    PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1
), projects AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS registration_number, c_name AS name,
    d.text AS annotation, c_name AS executor_name, CAST(c_custkey AS VARCHAR) AS executor_ogrn,
    n_name AS executor_okogu, CAST(year(o_orderdate) AS INTEGER) AS year,
    o_orderdate AS start_date, o_orderdate + INTERVAL 90 DAY AS end_date,
    o_orderpriority AS nioktr_types,
    CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS budget_total_thousands,
    s_name AS supervisor_full_name,
    CASE WHEN p_name IS NOT NULL THEN
      concat_ws('; ', replace(p_name, ' ', '; '), p_brand, p_type, c_mktsegment, n_name)
    END AS keyword_list,
    c_mktsegment AS rubrics, CAST(o_orderkey % 7 AS INTEGER) AS stages_count,
    CAST(o_custkey % 5 AS DOUBLE) AS reports_number
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN documents d ON o_orderkey = d.doc_id
  LEFT JOIN first_line ON o_orderkey = l_orderkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN part ON l_partkey = p_partkey
)"""


def with_projects(sql: str) -> str:
    """SQL over ``projects``; start with a comma to add further named queries."""
    return f"WITH {PROJECTS_SQL}{sql}" if sql.startswith(",") else f"WITH {PROJECTS_SQL} {sql}"


def document_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Whole document texts as delimited lists of words."""
    return table(spark, sf, "documents").select(
        F.replace("text", F.lit(" "), F.lit(";")).alias("keyword_list")
    )


DOCUMENT_KEYWORDS_SQL = (
    "docs AS (SELECT doc_id, replace(text, ' ', ';') AS keyword_list FROM documents)"
)


def cards(spark: SparkSession, sf: str) -> DataFrame:
    """Raw nested cards: one per order, keyed by customer, so that keys repeat between files."""
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    df = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(
        n, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    status, text = F.col("o_orderstatus"), F.lit(None).cast("string")

    def by_status(f, o, p):
        return F.when(status == "F", f).when(status == "O", o).otherwise(p)

    def funds(*values):
        return F.array(*[F.struct(v.alias("funds")) for v in values])

    empty = funds(text)
    return df.select(
        F.col("o_custkey").cast("string").alias("registration_number"),
        F.col("c_name").alias("name"),
        by_status(F.lit(" - "), F.lit("Нет"), F.concat(F.lit(" "), "c_name", F.lit(" "))).alias(
            "annotation"
        ),
        by_status(
            F.date_format("o_orderdate", "yyyy-MM-dd"),
            F.date_format("o_orderdate", "dd.MM.yyyy"),
            F.lit("unknown"),
        ).alias("start_date"),
        by_status(
            F.split("o_orderpriority", "[- ]"),
            F.array(F.lit(""), F.col("c_mktsegment"), text),
            F.slice(F.array(F.lit("x")), 1, 0),
        ).alias("keyword_list"),
        F.array("o_orderpriority").alias("nioktr_types"),
        F.array(
            F.struct(F.lit("1").alias("code"), F.col("c_mktsegment").alias("name")),
            F.struct(F.lit("2").alias("code"), by_status(text, F.lit("two"), text).alias("name")),
        ).alias("rubrics"),
        by_status(
            funds(F.col("o_totalprice").cast("string"), text, F.lit("n/a"), F.lit("5")),
            funds(F.lit("0")),
            F.slice(empty, 1, 0),
        ).alias("budgets"),
        F.when(
            F.col("o_custkey") % 5 != 0,
            F.array_repeat(F.struct(F.lit(1).alias("n")), (F.col("o_custkey") % 4).cast("int")),
        ).alias("stages"),
        F.array(
            F.struct(F.col("c_name").alias("name"), F.lit("").alias("short_name")),
            F.struct(F.lit("").alias("name"), status.alias("short_name")),
            F.struct(F.lit("").alias("name"), F.lit("").alias("short_name")),
        ).alias("coexecutors"),
        F.struct(
            F.col("c_name").alias("name"),
            F.col("c_custkey").cast("string").alias("ogrn"),
            F.col("n_name").alias("okogu"),
            F.struct(F.col("c_mktsegment").alias("segment")).alias("detail"),
        ).alias("executor"),
        F.struct(
            F.col("c_mktsegment").alias("surname"),
            by_status(F.col("o_orderpriority"), F.col("n_name"), text).alias("name"),
            F.col("c_name").alias("patronymic"),
        ).alias("work_supervisor"),
        by_status(F.col("o_custkey").cast("string"), F.lit(" 12 "), F.lit("n/a")).alias(
            "reports_number"
        ),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("rare")).alias("udc_note"),
        text.alias("never_filled"),
        F.concat(F.year("o_orderdate").cast("string"), F.lit(".json")).alias("source_file"),
        F.col("o_orderkey").alias("pos"),
    )


CARDS_SQL = """cards AS (
  SELECT CAST(o_custkey AS VARCHAR) AS registration_number, c_name AS name,
    CASE o_orderstatus WHEN 'F' THEN ' - ' WHEN 'O' THEN 'Нет' ELSE ' ' || c_name || ' ' END
      AS annotation,
    CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN 'O' THEN strftime(o_orderdate, '%d.%m.%Y') ELSE 'unknown' END AS start_date,
    CASE o_orderstatus WHEN 'F' THEN regexp_split_to_array(o_orderpriority, '[- ]')
      WHEN 'O' THEN ['', c_mktsegment, NULL] ELSE [] END AS keyword_list,
    [o_orderpriority] AS nioktr_types,
    [c_mktsegment, CASE WHEN o_orderstatus = 'O' THEN 'two' END] AS rubrics,
    CASE o_orderstatus WHEN 'F' THEN [CAST(o_totalprice AS VARCHAR), NULL, 'n/a', '5']
      WHEN 'O' THEN ['0'] ELSE [] END AS budgets,
    CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 4 END AS stages,
    [c_name, o_orderstatus, ''] AS coexecutors,
    c_custkey, n_name, c_mktsegment, c_name, o_orderpriority, o_orderstatus, o_orderkey,
    CASE o_orderstatus WHEN 'F' THEN o_orderpriority WHEN 'O' THEN n_name END AS middle,
    CASE o_orderstatus WHEN 'F' THEN CAST(o_custkey AS VARCHAR) WHEN 'O' THEN ' 12 '
      ELSE 'n/a' END AS reports_number,
    CAST(year(o_orderdate) AS VARCHAR) || '.json' AS source_file, o_orderkey AS pos, o_orderdate
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
)"""


def with_cards(sql: str) -> str:
    return f"WITH {CARDS_SQL}{sql}" if sql.startswith(",") else f"WITH {CARDS_SQL} {sql}"


def vector_store(spark: SparkSession, sf: str) -> DataFrame:
    """The given vectors keyed as projects, with the text of the document of the same number."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("source_text")
    )
    return (
        table(spark, sf, "embeddings")
        .join(docs, F.col("vec_id") == F.col("doc_id"), "left")
        .select(F.col("vec_id").cast("string").alias("registration_number"), "embedding",
                "source_text")
    )


def label_questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question per label: the mean of all its vectors."""
    parts = table(spark, sf, "embeddings").select("label", F.posexplode("embedding"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "v")))  # as long as a vector
    return means.groupBy("label").agg(F.transform(ordered, lambda x: x["v"]).alias("embedding")).select(
        F.col("label").cast("string").alias("question_id"),
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("question"),
        "embedding",
    )


def all_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth of the given vectors as a question."""
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(
        F.col("vec_id").cast("string").alias("question_id"), "embedding"
    )


STORE_SQL = """store AS (
  SELECT CAST(vec_id AS VARCHAR) AS registration_number, CAST(embedding AS DOUBLE[]) AS embedding,
    d.text AS source_text
  FROM embeddings LEFT JOIN documents d ON vec_id = d.doc_id
)"""

LABEL_QUESTIONS_SQL = """questions AS (
  SELECT CAST(label AS VARCHAR) AS question_id, 'label ' || label AS question,
    list(v ORDER BY i) AS embedding
  FROM (
    SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v
    FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i
  ) GROUP BY label
)"""

ALL_QUESTIONS_SQL = """questions AS (
  SELECT CAST(vec_id AS VARCHAR) AS question_id, CAST(embedding AS DOUBLE[]) AS embedding
  FROM embeddings WHERE vec_id % 100 = 0
)"""


def hits_sql(k: int) -> str:
    return f"""hits AS (
  SELECT question_id, registration_number, score,
    CAST(row_number() OVER (
      PARTITION BY question_id ORDER BY score DESC NULLS LAST, registration_number) AS INTEGER) AS rank
  FROM (
    SELECT question_id, registration_number,
      round(list_cosine_similarity(s.embedding, q.embedding), 9) AS score
    FROM questions q CROSS JOIN store s SEMI JOIN projects p USING (registration_number)
  ) QUALIFY rank <= {k}
)"""
