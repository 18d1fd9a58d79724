"""Data profiles: fill rates, duplicates, summaries, quantiles and histograms."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registra.functions.numeric import money_sum, round_dec
from registra.operators.metrics import BUDGET, top_groups
from registra.sources.tables import KEY, discard, written

DIGIT_BITS = 16


def _filled(df: DataFrame):
    """Non-null count per column; NaN counts as missing, as in a data frame of numbers."""
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        floating = isinstance(f.dataType, (T.DoubleType, T.FloatType))
        yield f.name, F.count(F.when(~F.isnan(c), c) if floating else c)


def fill_rates(df: DataFrame) -> DataFrame:
    """One row per column: filled rows, all rows, rate. A single pass over the frame."""
    entries = [F.struct(F.lit(n).alias("column"), c.alias("filled")) for n, c in _filled(df)]
    counts = df.agg(F.count(F.lit(1)).alias("total"), F.array(*entries).alias("entries"))
    rate = F.when(F.col("total") > 0, F.col("entry.filled") / F.col("total"))
    return counts.select("total", F.explode("entries").alias("entry")).select(
        "entry.column", "entry.filled", "total", rate.alias("rate")
    )


def fill_rates_row(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Row count and non-null count per column, as one aggregated row on the driver."""
    counts = [c.alias(f"c{i}") for i, (_, c) in enumerate(_filled(df))]
    row = df.agg(F.count(F.lit(1)).alias("n"), *counts).first()
    return row["n"], {name: row[f"c{i}"] for i, name in enumerate(df.columns)}


def duplicate_report(df: DataFrame, key: str = KEY) -> DataFrame:
    """Rows, repeated rows, percent repeated, unique rows. Null keys repeat each other."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rows, unique = F.coalesce(F.sum("n"), F.lit(0).cast("bigint")), F.count(F.lit(1))
    return per_key.agg(
        rows.alias("total_rows"),
        (rows - unique).alias("duplicates"),
        F.when(rows > 0, round_dec((rows - unique) / rows * 100, 1)).alias("duplicate_percent"),
        unique.alias("unique_rows"),
    )


def run_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, first and last year, budget in billions, institutions, top five types."""
    top = top_groups(df, "nioktr_types", 5).agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("projects")).alias("neg"), "nioktr_types"))
        ).alias("t")
    )
    names = F.array_join(
        F.transform("t", lambda x: F.concat(x["nioktr_types"], F.lit(": "), -x["neg"])), "; "
    )
    return df.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        round_dec(F.coalesce(money_sum(F.col(BUDGET)), F.lit(0.0)) / 1_000_000, 1).alias(
            "total_billions"
        ),
        F.count_distinct("executor_name").alias("institutions"),
    ).withColumn("top_types", top.select(names).scalar())


def exact_median(
    df: DataFrame, column: str, accuracy: int = 10_000, finish: int = 100_000
) -> float | None:
    """Median without sorting the column or holding its values in one task.

    An approximate quantile with a known rank error brackets the two middle ranks. Each round
    narrows the bracket some thousand times, until at most ``finish`` distinct values remain;
    only these, with their counts, come to the driver.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(
        F.col("v").isNotNull() & ~F.isnan("v")
    )
    slack = 3.0 / accuracy
    first = values.agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("v", [0.5 - slack, 0.5 + slack], accuracy).alias("edges"),
    ).first()
    n = first["n"]
    if n == 0:
        return None
    ranks = [(n - 1) // 2, n // 2]
    inside, below, edges = values, 0, first["edges"]
    if n <= accuracy:  # the slack is narrower than one row
        edges = values.agg(F.min("v"), F.max("v")).first()
    while True:
        low, high = edges
        chosen = F.col("v").between(low, high)
        cut = inside.agg(
            F.count_if(F.col("v") < low).alias("below"), F.count_if(chosen).alias("size")
        ).first()
        below, inside = below + cut["below"], inside.where(chosen)
        counts = inside.groupBy("v").agg(F.count(F.lit(1)).alias("n")).limit(finish + 1).collect()
        if len(counts) <= finish:
            break
        at = [(r - below + 0.5) / cut["size"] for r in ranks]
        asked = [max(0.0, at[0] - slack), min(1.0, at[1] + slack)]
        edges = inside.agg(F.percentile_approx("v", asked, accuracy)).first()[0]
    middle, seen, wanted = [], below, list(ranks)
    for v, count in sorted((r["v"], r["n"]) for r in counts):
        seen += count
        while wanted and wanted[0] < seen:
            middle.append(v)
            wanted.pop(0)
    return (middle[0] + middle[1]) / 2


def _ordered(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles."""
    bits = values.view(np.int64)
    return np.where(bits < 0, ~bits, bits | np.int64(-(1 << 63))).view(np.uint64)


def _double(ordered: int) -> float:
    bits = ordered ^ (1 << 63) if ordered >> 63 else ~ordered & ((1 << 64) - 1)
    return struct.unpack("<d", struct.pack("<Q", bits))[0]


def _digit_counts(values: DataFrame, shift: int, above: list[int]) -> dict[int, np.ndarray]:
    """How often each digit at ``shift`` occurs among the values whose upper digits are ``above``."""
    size = 1 << DIGIT_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(above), size), np.int64)
        for batch in batches:
            x = _ordered(batch.column(0).to_numpy(zero_copy_only=False))
            digits = ((x >> np.uint64(shift)) & np.uint64(size - 1)).astype(np.int64)
            upper = x >> np.uint64(shift) >> np.uint64(DIGIT_BITS)  # two steps: a shift by 64 is not defined
            for i, prefix in enumerate(above):
                counts[i] += np.bincount(digits[upper == np.uint64(prefix)], minlength=size)
        at, digit = np.nonzero(counts)
        columns = [pa.array(at), pa.array(digit), pa.array(counts[at, digit])]
        yield pa.record_batch(columns, names=["i", "digit", "n"])

    found = values.mapInArrow(count, "i bigint, digit bigint, n bigint")
    rows = found.groupBy("i", "digit").agg(F.sum("n").alias("n")).toArrow()  # at most 2 x 65,536
    out = {prefix: np.zeros(size, np.int64) for prefix in above}
    for i, prefix in enumerate(above):
        mine = rows.filter(pc.equal(rows["i"], i))
        out[prefix][mine["digit"].to_numpy()] = mine["n"].to_numpy()
    return out


def radix_median(df: DataFrame, column: str) -> float | None:
    """Median by radix selection over the bits of the values, in four passes whatever they are.

    Each pass counts one digit of 16 bits of the values that agree with a middle one in the digits
    before, which gives its next digit. Tasks send counts, and only counts come to the driver. The values
    are written once, so the passes do not repeat the plan behind them. Null and NaN are left out.
    """
    numbers = df.select(F.col(column).cast("double").alias("v"))
    values = written(numbers.where(F.col("v").isNotNull() & ~F.isnan("v")), "values")
    ranks: list[int] = []
    middle = [0, 0]
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        counts = _digit_counts(values, shift, sorted(set(middle)))
        if not ranks:
            n = int(counts[0].sum())
            if n == 0:
                return None
            ranks = [(n - 1) // 2, n // 2]
        for i, prefix in enumerate(middle):
            upto = np.cumsum(counts[prefix])
            digit = int(np.searchsorted(upto, ranks[i], side="right"))
            ranks[i] -= int(upto[digit - 1]) if digit else 0
            middle[i] = prefix << DIGIT_BITS | digit
    discard(values)
    low, high = map(_double, middle)
    return low if low == high else (low + high) / 2


def numeric_profile(df: DataFrame, column: str = BUDGET) -> DataFrame:
    """Non-null count and share, sum, mean and exact median."""
    count, rows = F.count(column), F.count(F.lit(1))
    median = radix_median(df, column)
    return df.agg(
        count.alias("filled"),
        round_dec(count / rows, 6).alias("share"),
        round_dec(money_sum(F.col(column)), 2).alias("sum"),
        round_dec(money_sum(F.col(column)) / count, 2).alias("mean"),
    ).withColumn("median", round_dec(F.lit(median).cast("double"), 4))


def log_histogram(df: DataFrame, column: str = BUDGET, bins: int = 50) -> DataFrame:
    """Equal-width bins of log10 over positive values; the last bin includes its upper edge.

    Every bin is listed, empty ones with 0.
    """
    logs = df.where(F.col(column) > 0).select(F.log10(F.col(column)).alias("x"))
    edge = logs.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if edge["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, count bigint")
    lo, width = edge["lo"], (edge["hi"] - edge["lo"]) / bins
    if width == 0:  # a single value sits in a bin range of width one around it
        lo, width = lo - 0.5, 1.0 / bins
    place = F.floor((F.col("x") - lo) / width)
    counts = logs.groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin",
        round_dec(lo + F.col("bin") * width, 6).alias("low"),
        round_dec(lo + (F.col("bin") + 1) * width, 6).alias("high"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("count"),
    )
