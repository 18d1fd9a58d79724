"""Keywords: trends over years, ranks, stacks, peaks and frequent terms."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registra.functions.numeric import MONEY, money_sum, round_dec
from registra.functions.text import norm_keyword, strip
from registra.operators.filters import valid_keyword, year_between
from registra.operators.metrics import BUDGET, BUDGET_YEARS
from registra.sources.tables import discard, written

KEYWORDS = "keyword_list"
# Most frequent terms that a task sends, and terms that it holds while it counts.
KEPT_TERMS, HELD_TERMS = 4_096, 1 << 19


def explode_keywords(df: DataFrame, column: str = KEYWORDS, sep: str = ";") -> DataFrame:
    """One row per part of the delimited column, as ``keyword_raw``."""
    return df.where(F.col(column).isNotNull()).withColumn(
        "keyword_raw", F.explode(F.split(F.col(column), sep))
    )


def keyword_cells(
    df: DataFrame, years: tuple[int, int] = BUDGET_YEARS, at_least: int = 2
) -> DataFrame:
    """Records and budget per keyword and year.

    Every keyword of a record carries the record's whole budget, and a keyword that occurs twice
    in a record counts twice.
    """
    parts = explode_keywords(
        df.select("year", BUDGET, KEYWORDS).where(year_between(*years))
    ).where(valid_keyword(F.col("keyword_raw")))
    cells = parts.groupBy("year", norm_keyword(F.col("keyword_raw")).alias("keyword")).agg(
        F.count(F.lit(1)).alias("projects"),
        (F.coalesce(money_sum(F.col(BUDGET)), F.lit(0.0)) / 1_000_000).alias("budget_billions"),
    )
    return cells.where(F.col("projects") >= at_least)


def top_keywords(cells: DataFrame, n: int = 12) -> DataFrame:
    """Keywords with the largest totals over the kept cells."""
    totals = cells.groupBy("keyword").agg(F.sum("projects").alias("total"))
    return totals.orderBy(F.desc("total"), F.asc("keyword")).limit(n)


def densify(cells: DataFrame, keys: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Every key in every year; missing cells are 0."""
    grid = keys.withColumn("year", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))))
    return grid.join(cells, ["keyword", "year"], "left").select(
        *keys.columns,
        "year",
        F.coalesce("projects", F.lit(0)).alias("projects"),
        F.coalesce(round_dec(F.col("budget_billions"), 2), F.lit(0.0)).alias("budget"),
    )


def keyword_trends(
    df: DataFrame, n: int = 12, years: tuple[int, int] = BUDGET_YEARS, at_least: int = 2
) -> DataFrame:
    """Grid of the ``n`` strongest keywords over the years.

    The cells of a keyword (at most one per year) are folded into a map, so the cells are built
    once and neither ranking nor filling the grid needs a join.
    """
    if not 5 <= n <= 30:
        raise ValueError("n must be 5 to 30")
    folded = keyword_cells(df, years, at_least).groupBy("keyword").agg(
        F.sum("projects").alias("total"),
        F.map_from_entries(
            F.collect_list(F.struct("year", F.struct("projects", "budget_billions")))
        ).alias("cells"),
    )
    top = folded.orderBy(F.desc("total"), F.asc("keyword")).limit(n)
    grid = top.withColumn("year", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))))
    cell = F.try_element_at("cells", F.col("year"))
    return grid.select(
        "keyword",
        "total",
        "year",
        F.coalesce(cell["projects"], F.lit(0)).alias("projects"),
        F.coalesce(round_dec(cell["budget_billions"], 2), F.lit(0.0)).alias("budget"),
    )


def active_topics(grid: DataFrame) -> DataFrame:
    """Rows of keywords with any positive value in any year. A keyword has one row per year."""
    live = F.bool_or((F.col("projects") > 0) | (F.col("budget") > 0))
    marked = grid.withColumn("_live", live.over(Window.partitionBy("keyword")))
    return marked.where("_live").drop("_live")


def year_totals(grid: DataFrame) -> DataFrame:
    return grid.groupBy("year").agg(
        F.sum("projects").alias("projects"),
        F.sum(F.col("budget").cast(MONEY)).cast("double").alias("budget"),
    )


def _topic_order() -> list[Column]:
    return [F.desc("total"), F.asc("keyword")]


def yearly_rank(grid: DataFrame, metric: str = "projects") -> DataFrame:
    """Rank of each keyword within its year, 1 first; ties keep the topic order."""
    w = Window.partitionBy("year").orderBy(F.desc(metric), *_topic_order())
    return grid.withColumn("rank", F.row_number().over(w))


def rank_in_year(grid: DataFrame, year: int | None = None, metric: str = "projects") -> DataFrame:
    """Ranking of one year, the last one by default."""
    chosen = grid.agg(F.max("year")).scalar() if year is None else F.lit(year)
    return yearly_rank(grid.where(F.col("year") == chosen), metric)


def stack_bands(grid: DataFrame, metric: str = "projects") -> DataFrame:
    """Bottom and top of each keyword when the keywords of a year are stacked in topic order."""
    dtype = "bigint" if metric == "projects" else MONEY
    value = F.col(metric).cast(dtype)
    w = (
        Window.partitionBy("year")
        .orderBy(*_topic_order())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    top = F.sum(value).over(w)
    out = "bigint" if metric == "projects" else "double"
    return grid.select(
        "keyword",
        "total",
        "year",
        F.col(metric).alias("val"),
        (top - value).cast(out).alias("bottom"),
        top.cast(out).alias("top"),
    )


def stack_max(bands: DataFrame) -> DataFrame:
    """Height of the tallest stack, at least 1."""
    return bands.agg(F.greatest(F.max("top").cast("double"), F.lit(1.0)).alias("stack_max"))


def peak_year(grid: DataFrame, metric: str = "projects") -> DataFrame:
    """Year with the largest value of each keyword, the earliest on ties."""
    best = F.max(F.struct(F.col(metric).alias("val"), (-F.col("year")).alias("back")))
    return grid.groupBy("keyword").agg(best.alias("best")).select(
        "keyword", (-F.col("best.back")).alias("peak_year"), F.col("best.val").alias("peak_value")
    )


def share_of_max(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Value divided by the maximum of the frame or of its group.

    The maximum is aggregated and joined back instead of taken over a window, so one large group
    never has to pass through one task. A maximum of 0 counts as 1.
    """
    top = F.max(F.col(column))
    if not by:
        best = df.agg(top.alias("_top")).scalar()
        return df.withColumn("share", F.col(column) / F.coalesce(F.nullif(best, F.lit(0)), F.lit(1)))
    best = df.groupBy(*[F.col(b).alias(f"_by_{b}") for b in by]).agg(top.alias("_top"))
    same = reduce(and_, [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by])
    share = F.col(column) / F.coalesce(F.nullif("_top", F.lit(0)), F.lit(1))
    return df.join(best, same).select(*df.columns, share.alias("share"))


def _parts(df: DataFrame, column: str, sep: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(F.split(F.col(column), sep).alias("parts"))


def _local_counts(df: DataFrame, column: str, sep: str) -> DataFrame:
    """``term`` and ``n``, counted within Arrow batches; parts are counted as written and then normalised."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pc.value_counts(pc.list_flatten(batch.column(0)))
            yield pa.record_batch([found.field(0).cast(pa.string()), found.field(1)], names=["part", "n"])

    counts = _parts(df, column, sep).mapInArrow(count, "part string, n bigint")
    return counts.select(F.lower(strip(F.col("part"))).alias("term"), "n").where(F.col("term") != "")


def _summaries(df: DataFrame, column: str, sep: str, kept: int) -> DataFrame:
    """What each task counted of its ``kept`` most frequent terms.

    ``term``, ``n`` (its count at least) and ``credit``; where ``term`` is null, ``n`` is the count that a term
    may have in the task without being listed. A listed term may have up to ``n + that - credit``.
    A task holds ``HELD_TERMS`` terms, or four times ``kept``; beyond that it drops the rarer half, and what
    a dropped term may have had counts for all.
    """
    most = max(HELD_TERMS, 4 * kept)

    def largest(table: pa.Table, size: int) -> tuple[pa.Table, int]:
        """The ``size`` most frequent rows, and the count of the next."""
        if len(table) <= size:
            return table, 0
        order = pc.sort_indices(table, [("n", "descending")])
        return table.take(order[:size]), table["n"][order[size].as_py()].as_py()

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lost = pa.table({"term": pa.array([], pa.string()), "n": pa.array([], pa.int64())}), 0
        for batch in batches:
            both = pa.concat_tables([held, pa.Table.from_batches([batch]).cast(held.schema)])
            held = both.group_by("term").aggregate([("n", "sum")]).rename_columns(["term", "n"])
            if len(held) > most:
                held, dropped = largest(held, most // 2)
                lost += dropped
        held, unlisted = largest(held, kept)
        yield pa.record_batch(
            [pa.concat_arrays([*held["term"].chunks, pa.nulls(1, pa.string())]),
             pa.concat_arrays([*held["n"].chunks, pa.array([unlisted + lost])]),
             pa.array([unlisted] * len(held) + [0], pa.int64())], names=["term", "n", "credit"])

    return _local_counts(df, column, sep).mapInArrow(summarise, "term string, n bigint, credit bigint")


def top_terms(df: DataFrame, column: str = KEYWORDS, sep: str = "[;,]", n: int = 20, kept: int = KEPT_TERMS) -> DataFrame:
    """Most frequent stripped lower-cased parts.

    Every task sends its ``kept`` most frequent terms, so rare ones are not shuffled, and a bound on
    what it does not send. Terms that may be among the first ``n`` by these bounds are candidates. If a term
    that no task sent might be, more is asked for once, and failing that all terms are counted. Where the bounds
    of the candidates are not exact, one more pass counts them alone.
    """
    best = [F.desc("count"), F.asc("term")]
    for size in (kept, 16 * kept):
        sent = written(_summaries(df, column, sep, size), "term-summaries")
        unseen = sent.where("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        bounds = sent.where("term IS NOT NULL").groupBy("term").agg(
            F.sum("n").alias("count"), (F.sum(-F.col("credit")) + unseen).alias("slack"))
        bounds = written(bounds, "term-bounds")
        discard(sent)
        last = bounds.orderBy(F.desc("count")).offset(n - 1).limit(1).select("count").first()
        least = last["count"] if last else 0
        if unseen < least or unseen == 0:
            break
    else:
        return _counted(_local_counts(df, column, sep)).orderBy(*best).limit(n)
    chosen = bounds.where(F.col("count") + F.col("slack") >= least)
    if chosen.where("slack > 0").isEmpty():
        return chosen.select("term", "count").orderBy(*best).limit(n)
    asked = _local_counts(df, column, sep).join(chosen.select("term"), "term", "left_semi")
    return _counted(asked).orderBy(*best).limit(n)


def _counted(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("n").alias("count"))
