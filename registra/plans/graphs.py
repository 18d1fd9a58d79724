"""Queries: institution and topic graphs (A16, A25-A27, G, J3, J4, J9, J10, T5, T6, U2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registra.operators import graph, shared
from registra.plans.projects import (
    projects, with_projects,
)
from registra.plans.registry import dec_round, money, query, quoted, sql_strip
from registra.functions.text import LABEL_QUOTES, LEGAL_PREFIX
from registra.sources.tables import KEY

_B = "budget_total_thousands"
_NODE_COLUMNS = ("executor_ogrn", "executor_name", _B)
_LINK_COLUMNS = ("executor_ogrn", "executor_name", "supervisor_full_name")
LIMIT = 300

LINKS_SQL = """links AS (
  SELECT DISTINCT supervisor_full_name AS member, coalesce(executor_ogrn, executor_name) AS grp
  FROM projects WHERE supervisor_full_name IS NOT NULL AND executor_name IS NOT NULL
)"""
PAIRS_SQL = f"""{LINKS_SQL}, pairs AS (
  SELECT a.grp AS source, b.grp AS target, count(DISTINCT a.member) AS weight
  FROM links a JOIN links b ON a.member = b.member AND a.grp < b.grp
  GROUP BY 1, 2 HAVING count(DISTINCT a.member) >= 2
)"""
EDGES_SQL = f"""{PAIRS_SQL}, edges AS (
  SELECT * FROM pairs ORDER BY weight DESC, source, target LIMIT 500
)"""
NODES_SQL = f"""nodes AS (
  SELECT coalesce(executor_ogrn, executor_name) AS id, executor_name AS label, count(*) AS projects,
    {dec_round(f'coalesce({money(_B)}, 0) / 1000000', 1)} AS budget_billions
  FROM projects WHERE executor_name IS NOT NULL GROUP BY executor_ogrn, executor_name
  HAVING count(*) >= 10 ORDER BY projects DESC, id, label LIMIT {LIMIT}
)"""
INTERNAL = ("SELECT source, target, weight FROM edges WHERE source IN (SELECT id FROM nodes) "
            "AND target IN (SELECT id FROM nodes)")


def _links(spark, sf):
    return graph.supervisor_links(projects(spark, sf, *_LINK_COLUMNS))


@query("u02_distinct_pairs", with_projects(f", {LINKS_SQL} SELECT member, grp FROM links"))
def u02(spark, sf):
    return _links(spark, sf)


@query("j03_shared_member_pairs", with_projects(
    f", {PAIRS_SQL} SELECT source, target, weight FROM pairs"))
def j03(spark, sf):
    return shared.shared_member_pairs(_links(spark, sf))


@query("a16_institution_nodes", with_projects(f", {NODES_SQL} SELECT * FROM nodes"))
def a16(spark, sf):
    return graph.institution_nodes(projects(spark, sf, *_NODE_COLUMNS), 10, LIMIT)


@query("a27_institution_edges", with_projects(f", {EDGES_SQL} SELECT * FROM edges"))
def a27(spark, sf):
    return graph.institution_edges(projects(spark, sf, *_LINK_COLUMNS))


@query("j04_keep_internal_edges", with_projects(f", {EDGES_SQL}, {NODES_SQL} {INTERNAL}"))
def j04(spark, sf):
    nodes = graph.institution_nodes(projects(spark, sf, *_NODE_COLUMNS), 10, LIMIT)
    return graph.keep_internal_edges(
        graph.institution_edges(projects(spark, sf, *_LINK_COLUMNS)), nodes)


_BARE = (f"trim(regexp_replace(trim(regexp_replace(label, {quoted('(?i)' + LEGAL_PREFIX)}, '')), "
         + quoted(f"^[{LABEL_QUOTES}]+|[{LABEL_QUOTES}]+$") + ", '', 'g'))")


@query("g01_institution_nodes", with_projects(
    f", {NODES_SQL} SELECT id, CASE WHEN length({_BARE}) > 4 THEN {_BARE} ELSE label END AS label, "
    "projects, budget_billions FROM nodes WHERE (SELECT count(DISTINCT id) FROM nodes) >= 2"))
def g01_nodes(spark, sf):
    return graph.institution_graph_nodes(projects(spark, sf, *_NODE_COLUMNS), 10, LIMIT)


@query("g01_institution_edges", with_projects(f", {EDGES_SQL}, {NODES_SQL} {INTERNAL}"))
def g01_edges(spark, sf):
    return graph.institution_graph(projects(spark, sf, *_LINK_COLUMNS, _B), 10, LIMIT)[1]


@query("j10_neighbours", with_projects(
    f", {EDGES_SQL}, {NODES_SQL}, picked AS (SELECT id FROM nodes ORDER BY projects DESC, id LIMIT 8) "
    "SELECT * FROM (SELECT source AS id, target AS neighbour, weight FROM edges UNION ALL "
    "SELECT target, source, weight FROM edges WHERE source <> target) "
    "WHERE id IN (SELECT id FROM picked)"))
def j10(spark, sf):
    nodes = graph.institution_nodes(projects(spark, sf, *_NODE_COLUMNS), 10, LIMIT)
    return graph.neighbours(_edges(spark, sf), graph.strongest_nodes(nodes))


@query("t06_strongest_nodes", with_projects(
    f", {NODES_SQL} SELECT * FROM nodes ORDER BY projects DESC, id, label LIMIT 8"))
def t06_nodes(spark, sf):
    return graph.strongest_nodes(
        graph.institution_nodes(projects(spark, sf, *_NODE_COLUMNS), 10, LIMIT))


def _edges(spark, sf):
    return graph.institution_edges(projects(spark, sf, *_LINK_COLUMNS))


def _strongest_sql(k):
    return with_projects(
        f", {EDGES_SQL} SELECT * FROM edges ORDER BY weight DESC, source, target LIMIT {k}")


@query("t06_strongest_edges", _strongest_sql(6))
def t06(spark, sf):
    return graph.strongest_edges(_edges(spark, sf))


@query("t06_drawn_edges", _strongest_sql(300))
def t06_drawn(spark, sf):
    return graph.drawn_edges(_edges(spark, sf))


@query("t06_strongest_neighbours", with_projects(
    f", {EDGES_SQL}, {NODES_SQL}, picked AS (SELECT id FROM nodes ORDER BY projects DESC, id LIMIT 8) "
    "SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY weight DESC, neighbour) AS INTEGER) "
    "AS rank FROM (SELECT source AS id, target AS neighbour, weight FROM edges UNION ALL "
    "SELECT target, source, weight FROM edges WHERE source <> target) "
    "WHERE id IN (SELECT id FROM picked) QUALIFY rank <= 5"))
def t06_neighbours(spark, sf):
    nodes = graph.institution_nodes(projects(spark, sf, *_NODE_COLUMNS), 10, LIMIT)
    return graph.strongest_neighbours(_edges(spark, sf), graph.strongest_nodes(nodes))


# ---- topics: the keyword lists of projects ------------------------------------------------

_KEPT = f"lower({sql_strip('w')})"


def _words_sql(cut="", source="projects"):
    return f"""words AS (
  SELECT {KEY} AS doc_id, list_filter(list_transform(string_split(keyword_list, ';'),
    lambda w: {_KEPT}), lambda w: w <> ''){cut} AS words FROM {source} WHERE keyword_list IS NOT NULL
), places AS (
  SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM words
)"""


WORDS_SQL = _words_sql("[1:10]")
WORD_NODES_SQL = f"""nodes AS (
  SELECT w AS id, w AS label, count(*) AS count FROM places GROUP BY w
  ORDER BY count DESC, id LIMIT {LIMIT}
)"""
WORD_PAIRS_SQL = """pairs AS (
  SELECT least(a.w, b.w) AS source, greatest(a.w, b.w) AS target, count(*) AS weight
  FROM places a JOIN places b ON a.doc_id = b.doc_id AND a.i < b.i GROUP BY 1, 2
)"""
WORD_EDGES_SQL = f"""{WORD_PAIRS_SQL}, common AS (
  SELECT * FROM pairs ORDER BY weight DESC, source, target LIMIT 500
), edges AS (
  SELECT source, target, weight FROM common WHERE weight >= 5
  AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)
)"""


def _lists(spark, sf):
    return projects(spark, sf, KEY, "keyword_list")


@query("a25_topic_nodes", with_projects(f", {WORDS_SQL}, {WORD_NODES_SQL} SELECT * FROM nodes"))
def a25(spark, sf):
    return graph.topic_nodes(graph.record_words(_lists(spark, sf), n=graph.WORDS_PER_RECORD), LIMIT)


@query("j09_cooccurrence_pairs", with_projects(f", {_words_sql()}, {WORD_PAIRS_SQL} SELECT * FROM pairs"))
def j09(spark, sf):
    return graph.pair_weights(graph.cooccurrence_pairs(graph.record_words(_lists(spark, sf))))


@query("a26_topic_edges", with_projects(f", {WORDS_SQL}, {WORD_NODES_SQL}, {WORD_EDGES_SQL} SELECT * FROM edges"))
def a26(spark, sf):
    return graph.topic_graph(_lists(spark, sf), LIMIT)[1]


@query("g02_topic_graph",
       with_projects(f", {WORDS_SQL}, {WORD_NODES_SQL}, {WORD_EDGES_SQL} "
       "SELECT id AS a, NULL::VARCHAR AS b, count AS n FROM nodes "
       "UNION ALL SELECT source, target, weight FROM edges"))
def g02(spark, sf):
    nodes, edges = graph.topic_graph(_lists(spark, sf), LIMIT)
    none = F.lit(None).cast("string")
    return nodes.select(F.col("id").alias("a"), none.alias("b"), F.col("count").alias("n")).unionByName(
        edges.select(F.col("source").alias("a"), F.col("target").alias("b"),
                     F.col("weight").alias("n")))


@query("g03_graph_summary",
       with_projects(f", {WORDS_SQL}, {WORD_NODES_SQL}, {WORD_EDGES_SQL} "
       "SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count"))
def g03(spark, sf):
    return graph.graph_summary(*graph.topic_graph(_lists(spark, sf), LIMIT))


SAMPLE = 20_000  # a sampling operator: the records with the first keys


@query("t05_bounded_sample", with_projects(
       f", sampled AS (SELECT * FROM projects WHERE keyword_list IS NOT NULL ORDER BY {KEY} LIMIT {SAMPLE}), "
       f"{_words_sql('[1:10]', 'sampled')}, {WORD_NODES_SQL} SELECT * FROM nodes"))
def t05(spark, sf):
    sample = _lists(spark, sf).where("keyword_list IS NOT NULL").orderBy(KEY).limit(SAMPLE)
    return graph.topic_nodes(graph.record_words(sample, n=graph.WORDS_PER_RECORD), LIMIT)
