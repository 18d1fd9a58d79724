"""Queries: vectors, search, context and prompts (J1, V, X15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registra.functions.numeric import round_dec
from registra.functions.vectors import cosine
from registra.operators import context, retrieval
from registra.plans.projects import (
    ALL_QUESTIONS_SQL, LABEL_QUESTIONS_SQL, STORE_SQL, all_questions, hits_sql, label_questions,
    projects, table, vector_store, with_projects,
)
from registra.plans.registry import dec_round, query, sql_fixed, sql_strip
from registra.session import shared_dir
from registra.sources.tables import KEY, written
from registra.streaming.incremental import embed_incremental

_TEXT_COLUMNS = (KEY, "annotation")


@query("v01_source_texts", with_projects(
    f"SELECT registration_number, substring(annotation, 1, 2000) AS source_text FROM projects "
    f"WHERE {sql_strip('registration_number')} <> '' AND {sql_strip('annotation')} <> ''"))
def v01(spark, sf):
    return retrieval.source_texts(projects(spark, sf, *_TEXT_COLUMNS), retrieval.TEXT_CUT)


@query("v02_embed_texts", with_projects(
    "SELECT registration_number, CAST(384 AS INTEGER) AS dim, CAST(1 AS DOUBLE) AS length "
    f"FROM projects WHERE {sql_strip('annotation')} <> ''"))
def v02(spark, sf):
    texts = retrieval.source_texts(projects(spark, sf, *_TEXT_COLUMNS))
    vectors = retrieval.embed_texts(texts, retrieval.hashing_encoder)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return vectors.select(
        KEY, F.size("embedding").alias("dim"), F.round(length, 4).alias("length"))


@query("v03_embed_incremental",
       f"SELECT (SELECT count(*) FROM documents WHERE lang = 'en' AND {sql_strip('text')} <> '' "
       "AND doc_id IN (SELECT o_orderkey FROM orders)) AS before, "
       f"(SELECT count(*) FROM documents WHERE {sql_strip('text')} <> '' "
       "AND doc_id IN (SELECT o_orderkey FROM orders)) AS after")
def v03(spark, sf):
    path = shared_dir(spark, "vectors")
    df = projects(spark, sf, *_TEXT_COLUMNS)
    english = table(spark, sf, "documents").where("lang = 'en'").select(
        F.col("doc_id").cast("string").alias(KEY))
    embed_incremental(df.join(english, KEY, "left_semi"), path, retrieval.hashing_encoder)
    return embed_incremental(df, path, retrieval.hashing_encoder)


_HIT_ATTRIBUTES = ("name, annotation, year, executor_name AS institution, nioktr_types, "
                   "budget_total_thousands, keyword_list")


def _search_sql(questions, k, attributes):
    return with_projects(f", {STORE_SQL}, {questions}, {hits_sql(k)} "
                         f"SELECT question_id, registration_number, rank, {attributes}, source_text, "
                         f"{dec_round('score', 3)} AS similarity FROM hits "
                         "JOIN projects USING (registration_number) JOIN store USING (registration_number)")


@query("v04_semantic_search", _search_sql(LABEL_QUESTIONS_SQL, 10, _HIT_ATTRIBUTES))
def v04(spark, sf):
    df = projects(spark, sf, KEY, *retrieval.SEARCH_VIEW)
    return retrieval.semantic_search(vector_store(spark, sf), df, label_questions(spark, sf), 10)


LEAST_RECALL = 0.9


@query("v05_ivf_recall", with_projects(
    f", {STORE_SQL}, {LABEL_QUESTIONS_SQL}, {hits_sql(10)}, n AS (SELECT count(*) AS n FROM hits) "
    "SELECT 'all cells' AS search, n AS expected, n AS found, true AS enough FROM n "
    "UNION ALL SELECT 'bounded', n, n, true FROM n UNION ALL SELECT 'twelve cells', n, NULL, true FROM n"))
def v05(spark, sf):
    """Neighbours found; twelve of sixteen cells find 90 % at least (the given vectors hardly
    cluster), the other searches all of them."""
    store, questions = retrieval.with_records(vector_store(spark, sf), projects(spark, sf, KEY)), label_questions(spark, sf)
    index = retrieval.build_ivf(store, lists=16).save(shared_dir(spark, "ivf"))
    exact = written(retrieval.nearest(store, questions, 10), "exact-hits")
    found = {
        "all cells": retrieval.ivf_search(index, questions, 10, 16),
        "bounded": retrieval.bounded_search(index, questions, 10),
        "twelve cells": retrieval.ivf_search(index, questions, 10, 12),
    }
    parts = [
        retrieval.recall(f, exact).select(
            F.lit(name).alias("search"), "expected", F.when(F.lit(name != "twelve cells"), F.col("found")).alias("found"),
            (F.col("recall") >= LEAST_RECALL).alias("enough"))
        for name, f in found.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("v05_bounded_search", with_projects(
    f", {STORE_SQL}, {ALL_QUESTIONS_SQL}, {hits_sql(10)} "
    "SELECT question_id, registration_number, rank FROM hits"))
def v05_bounded(spark, sf):
    store = retrieval.with_records(vector_store(spark, sf), projects(spark, sf, KEY))
    index = retrieval.build_ivf(store, lists=16).save(shared_dir(spark, "ivf"))
    return retrieval.bounded_search(index, all_questions(spark, sf), 10).select("question_id", KEY, "rank")


@query("v05_ivf_all_cells", with_projects(
    f", {STORE_SQL}, {LABEL_QUESTIONS_SQL}, {hits_sql(10)} "
    "SELECT question_id, registration_number, rank FROM hits"))
def v05_all_cells(spark, sf):
    store = retrieval.with_records(vector_store(spark, sf), projects(spark, sf, KEY))
    index = retrieval.build_ivf(store, lists=16).save(shared_dir(spark, "ivf"))
    hits = retrieval.ivf_search(index, label_questions(spark, sf), 10, probes=16)
    return hits.select("question_id", KEY, "rank")


@query("v06_retrieve_context", _search_sql(
    ALL_QUESTIONS_SQL, 5, "name, year, executor_name AS institution"))
def v06(spark, sf):
    df = projects(spark, sf, KEY, *retrieval.CONTEXT_VIEW)
    return retrieval.retrieve_context(vector_store(spark, sf), df, all_questions(spark, sf))


@query("v06_unanswered",
       "SELECT CAST(vec_id AS VARCHAR) AS question_id FROM embeddings WHERE vec_id % 200 = 0")
def v06_unanswered(spark, sf):
    """Every second question lost its vector, as when its text could not be encoded."""
    store = retrieval.with_records(vector_store(spark, sf), projects(spark, sf, KEY))
    questions = all_questions(spark, sf).withColumn(
        "embedding", F.when(F.col("question_id").cast("bigint") % 200 != 0, F.col("embedding")))
    return retrieval.unanswered(questions, retrieval.nearest_to_all(store, questions, 5))


_CONTEXT_SQL = f"""{STORE_SQL}, {LABEL_QUESTIONS_SQL}, {hits_sql(5)}, contexts AS (
  SELECT question_id, string_agg(
    'Проект: ' || coalesce(name, 'None') || chr(10) || 'Год: ' || coalesce(CAST(year AS VARCHAR), 'None')
    || ' | Организация: ' || coalesce(executor_name, 'None') || chr(10) || 'Описание: '
    || substring(coalesce(source_text, ''), 1, 600),
    chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
  FROM hits JOIN projects USING (registration_number) JOIN store USING (registration_number)
  GROUP BY question_id
)"""


def _contexts(spark, sf):
    df = projects(spark, sf, KEY, *retrieval.CONTEXT_VIEW)
    questions = label_questions(spark, sf)
    return questions, context.build_context(
        retrieval.retrieve_context(vector_store(spark, sf), df, questions))


@query("v07_build_context", with_projects(f", {_CONTEXT_SQL} SELECT * FROM contexts"))
def v07(spark, sf):
    return _contexts(spark, sf)[1]


_INSTRUCTION_SQL = "'" + context.INSTRUCTION.replace("'", "''") + "'"


@query("v08_build_prompts", with_projects(
    f", {_CONTEXT_SQL} SELECT question_id, {_INSTRUCTION_SQL} || chr(10) || chr(10) || 'Запрос: ' || "
    "question || chr(10) || chr(10) || 'Данные о проектах:' || chr(10) || chr(10) || context "
    "|| chr(10) || chr(10) || 'Анализ:' AS prompt FROM contexts JOIN questions USING (question_id)"))
def v08(spark, sf):
    questions, contexts = _contexts(spark, sf)
    return context.build_prompts(contexts, questions)


@query("v08_project_questions", with_projects(
    "SELECT registration_number, 'Расскажи подробнее об этом проекте: \"' || "
    "substring(coalesce(annotation, ''), 1, 80) || "
    "'\". Каковы цели исследования и ожидаемые результаты?' AS question, "
    "'Analyse the research project: \"' || name || '\". ' || chr(10) || 'Budget: ' || "
    "CASE WHEN budget_total_thousands <> 0 THEN "
    f"{sql_fixed('budget_total_thousands / 1000', 1)} || ' million RUB' ELSE 'unknown' END || '. ' || chr(10) || 'Year: ' || year || '.' "
    "|| chr(10) || 'Institution: ' || executor_name || '.' || chr(10) || 'Focus: ' || "
    "coalesce(array_to_string(list_slice(string_split(keyword_list, ';'), 1, 3), ', '), "
    "'general research') || '.' || chr(10) || "
    "'What are the key research goals and potential impact?' AS brief FROM projects"))
def v08_questions(spark, sf):
    df = projects(spark, sf, KEY, "name", "annotation", "budget_total_thousands", "year",
                  "executor_name", "keyword_list")
    brief = context.project_brief(
        F.col("name"), F.col(KEY), F.col("budget_total_thousands"), F.col("year"),
        F.col("executor_name"), F.col("keyword_list"))
    return df.select(
        KEY, context.project_question(F.col("annotation")).alias("question"), brief.alias("brief"))


@query("j01_join_on_key", with_projects(
    f", {STORE_SQL} SELECT registration_number, name, year, len(embedding)::INTEGER AS dim "
    "FROM store JOIN projects USING (registration_number)"))
def j01(spark, sf):
    store = vector_store(spark, sf).select(KEY, F.size("embedding").alias("dim"))
    return store.join(projects(spark, sf, KEY, "name", "year"), KEY)


@query("x15_cosine",
       f"WITH {LABEL_QUESTIONS_SQL} SELECT vec_id, "
       f"{dec_round('list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.embedding)', 3)} "
       "AS similarity FROM embeddings e JOIN questions q ON CAST(label AS VARCHAR) = question_id")
def x15(spark, sf):
    centres = label_questions(spark, sf).select(
        F.col("question_id").cast("int").alias("label"), F.col("embedding").alias("centre"))
    both = table(spark, sf, "embeddings").join(centres, "label")
    similarity = cosine(F.col("embedding"), F.col("centre"))
    return both.select("vec_id", round_dec(similarity, 3).alias("similarity"))
