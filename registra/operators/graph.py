"""Institution and topic graphs as a frame of nodes and a frame of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.functions.numeric import money_sum, round_dec
from registra.functions.text import BLANK, clean_org_label, strip
from registra.operators.keywords import KEYWORDS
from registra.operators.metrics import BUDGET
from registra.operators.paging import top_k, top_k_per_group
from registra.operators.shared import HEAVY, memberships, top_shared_pairs
from registra.sources.tables import written

# ---- fixed values -------------------------------------------------------------------------
EDGE_LIST = 500  # strongest edges taken before the node filter
WORDS_PER_RECORD = 10
MIN_SHARED_SUPERVISORS = 2
MIN_TOPIC_WEIGHT = 5
MAX_NODES = 300
SHOWN_NODES = 8
SHOWN_EDGES = 6
SHOWN_NEIGHBOURS = 5
DRAWN_EDGES = 300
# ---- end of fixed values ------------------------------------------------------------------

# Words that a plan names at most, and pairs that are counted without looking for these words first.
CHOSEN_WORDS, FEW_PAIRS = 5_000, 20_000_000


def institution_id() -> Column:
    return F.coalesce("executor_ogrn", "executor_name")


def institution_nodes(df: DataFrame, at_least: int = 10, limit: int = 100) -> DataFrame:
    """Institutions with at least ``at_least`` records, the largest ``limit`` of them."""
    _check_limit(limit)
    groups = (
        df.where(F.col("executor_name").isNotNull())
        .groupBy("executor_ogrn", "executor_name")
        .agg(
            F.count(F.lit(1)).alias("projects"),
            round_dec(
                F.coalesce(money_sum(F.col(BUDGET)), F.lit(0.0)) / 1_000_000, 1
            ).alias("budget_billions"),
        )
        .where(F.col("projects") >= at_least)
    )
    nodes = groups.select(
        institution_id().alias("id"),
        F.col("executor_name").alias("label"),
        "projects",
        "budget_billions",
    )
    return nodes.orderBy(F.desc("projects"), F.asc("id"), F.asc("label")).limit(limit)


def _check_limit(limit: int) -> None:
    if not 10 <= limit <= MAX_NODES:
        raise ValueError(f"limit must be 10 to {MAX_NODES}")


def supervisor_links(df: DataFrame) -> DataFrame:
    """Distinct (supervisor, institution id) of records that name both."""
    named = df.where(F.col("executor_name").isNotNull())
    return memberships(named, F.col("supervisor_full_name"), institution_id())


def institution_edges(df: DataFrame, k: int = EDGE_LIST, heavy: int = HEAVY) -> DataFrame:
    """Institution pairs with the most supervisors in common."""
    return top_shared_pairs(supervisor_links(df), k, MIN_SHARED_SUPERVISORS, heavy)


def keep_internal_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    for end in ("source", "target"):
        ids = nodes.select(F.col("id").alias(end)).distinct()
        edges = edges.join(ids, end, "left_semi")
    return edges.select("source", "target", "weight")


def record_words(df: DataFrame, column: str = KEYWORDS, n: int | None = None) -> DataFrame:
    """Non-empty stripped lower-cased keywords of every record, as ``words``; the first ``n`` if given."""
    listed = df.where(F.col(column).isNotNull()).select(column)
    # A separator takes the blanks and empty keywords after it along, so splitting stops after
    # the first n keywords however long the list is.
    blank = BLANK[1:-1]
    start = F.regexp_replace(F.col(column), f"^[;{blank}]+", "")
    parts = F.split(start, f";[;{blank}]*", -1 if n is None else n + 1)
    if n is not None:
        parts = F.slice(parts, 1, n)
    words = F.transform(parts, lambda w: F.lower(strip(w)))
    return listed.select(F.filter(words, lambda w: w != "").alias("words"))


def topic_nodes(words: DataFrame, limit: int | None = 100) -> DataFrame:
    """Most frequent words; every occurrence counts. ``limit=None`` keeps all."""
    counts = (
        words.select(F.explode("words").alias("id"))
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    nodes = counts.select("id", F.col("id").alias("label"), "count")
    if limit is None:
        return nodes
    _check_limit(limit)
    return nodes.orderBy(F.desc("count"), F.asc("id")).limit(limit)


def cooccurrence_pairs(words: DataFrame, drop_self: bool = False) -> DataFrame:
    """Each two words of one record, smaller first; a repeated word pairs with itself.

    All words pair; how many a record may have is for :func:`record_words` to say.
    """
    first = words.select("words", F.posexplode("words").alias("i", "w1"))
    rest = F.slice("words", F.col("i") + 2, F.size("words"))
    both = first.select("w1", F.explode(rest).alias("w2"))
    if drop_self:
        both = both.where(F.col("w1") != F.col("w2"))
    return both.select(F.least("w1", "w2").alias("source"), F.greatest("w1", "w2").alias("target"))


def pair_weights(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def _pair_bounds(words: DataFrame) -> DataFrame:
    """``id`` and ``most``: a word pairs with any other at most so often.

    Its occurrences count as often as the record repeats its most repeated word; where no record
    repeats a word, that is the number of occurrences.
    """
    repeated = F.size("words") > F.size(F.array_distinct("words"))
    times = F.transform(F.array_distinct("words"), lambda w: F.size(F.filter("words", lambda x: x == w)))
    most = F.when(repeated, F.array_max(times)).otherwise(1)
    rows = words.select(F.explode("words").alias("id"), most.alias("times"))
    return rows.groupBy("id").agg(F.sum("times").alias("most"))


def frequent_words(words: DataFrame, k: int = EDGE_LIST) -> DataFrame:
    """The records' words that can be in one of the ``k`` most frequent pairs; no others pair up.

    A pair is no more frequent than its rarer word allows, and the pairs of the most frequent words
    alone give a weight that the ``k``-th pair reaches in any case. Their number, ``sqrt(8 k) + 2``, and of the
    words that reach the weight, ``CHOSEN_WORDS``, are the most that travel with the plan; where more
    words reach it, none is left out. Nor is any where all pairs are few, ``FEW_PAIRS``.
    """
    n = F.size("words").cast("double")
    if (words.agg(F.sum(n * (n - 1) / 2)).first()[0] or 0.0) <= FEW_PAIRS:
        return words
    bounds = written(_pair_bounds(words), "pair-bounds")
    probed = bounds.orderBy(F.desc("most"), F.asc("id")).limit(int((8 * k) ** 0.5) + 2)
    reached = pair_weights(cooccurrence_pairs(_only(words, [r["id"] for r in probed.collect()])))
    last = reached.orderBy(F.desc("weight")).offset(k - 1).limit(1).select("weight").first()
    if last is None:
        return words
    chosen = [r["id"] for r in bounds.where(F.col("most") >= last["weight"]).select("id").limit(CHOSEN_WORDS + 1).collect()]
    return words if len(chosen) > CHOSEN_WORDS else _only(words, chosen)


def _only(words: DataFrame, ids: list[str]) -> DataFrame:
    kept = F.filter("words", lambda w: w.isin(ids)) if ids else F.filter("words", lambda w: F.lit(False))
    return words.select(kept.alias("words")).where(F.size("words") > 1)


def topic_edges(words: DataFrame, nodes: DataFrame, k: int = EDGE_LIST) -> DataFrame:
    """The ``k`` most frequent pairs, then those between nodes that occur often enough."""
    common = (
        pair_weights(cooccurrence_pairs(frequent_words(words, k)))
        .orderBy(F.desc("weight"), F.asc("source"), F.asc("target"))
        .limit(k)
    )
    return keep_internal_edges(common.where(F.col("weight") >= MIN_TOPIC_WEIGHT), nodes)


def institution_graph_nodes(
    df: DataFrame, at_least: int = 10, limit: int = 100, merge_ids: bool = False
) -> DataFrame:
    """Nodes of the graph; none when fewer than two institutions qualify.

    One id under two names gives two nodes unless ``merge_ids``. Edges are not worked out.
    """
    raw = institution_nodes(df, at_least, limit)
    enough = raw.agg(F.count_distinct("id") >= 2).scalar()
    if merge_ids:
        raw = raw.groupBy("id").agg(
            F.max_by("label", F.struct("projects", "label")).alias("label"),
            F.sum("projects").alias("projects"),
            F.sum("budget_billions").alias("budget_billions"),
        )
    return raw.where(enough).withColumn("label", clean_org_label(F.col("label")))


def institution_graph(
    df: DataFrame, at_least: int = 10, limit: int = 100, merge_ids: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; both empty when fewer than two institutions qualify."""
    nodes = institution_graph_nodes(df, at_least, limit, merge_ids)
    return nodes, keep_internal_edges(institution_edges(df), nodes)


def topic_graph(
    df: DataFrame, limit: int = 100, column: str = KEYWORDS, n: int | None = WORDS_PER_RECORD
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from the first ``n`` keywords of each record (None: from all).

    The words of the records are written, so the lists are read once.
    """
    words = written(record_words(df, column, n), "words")
    nodes = topic_nodes(words, limit)
    return nodes, topic_edges(words, nodes)


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    counts = nodes.agg(F.count(F.lit(1)).alias("node_count"))
    edge_count = edges.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("edge_count", edge_count)


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Neighbours of the selected nodes (column ``id``) with the weight of the edge."""
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("neighbour"), "weight")
    back = edges.where(F.col("source") != F.col("target")).select(
        F.col("target").alias("id"), F.col("source").alias("neighbour"), "weight"
    )
    return both.unionByName(back).join(ids.select("id").distinct(), "id", "left_semi")


def _strongest_first() -> list[Column]:
    return [F.desc("weight"), F.asc("source"), F.asc("target")]


def strongest_nodes(nodes: DataFrame, k: int = SHOWN_NODES) -> DataFrame:
    """Largest nodes by records (institutions) or occurrences (topics)."""
    size = "projects" if "projects" in nodes.columns else "count"
    return top_k(nodes, [F.desc(size), F.asc("id"), F.asc("label")], k)


def strongest_edges(edges: DataFrame, k: int = SHOWN_EDGES) -> DataFrame:
    return top_k(edges, _strongest_first(), k)


def drawn_edges(edges: DataFrame) -> DataFrame:
    """Edges a drawing shows."""
    return strongest_edges(edges, DRAWN_EDGES)


def strongest_neighbours(edges: DataFrame, ids: DataFrame, k: int = SHOWN_NEIGHBOURS) -> DataFrame:
    """Neighbours with the strongest edges of each selected node."""
    order = [F.desc("weight"), F.asc("neighbour")]
    return top_k_per_group(neighbours(edges, ids), ["id"], order, k)
