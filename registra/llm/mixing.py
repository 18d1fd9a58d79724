"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source has the same expected number of copies, the source's target divided by
its size. Whole copies are given at once. The fractions are rounded dependently: two documents with
fractional copies meet, and words move at random from one to the other until one of them is
whole; the other goes on. Each move keeps the words of the pair and every document's expectation.

Documents of a source meet in leaves of bounded size; each leaf passes on one document at most, and
the leaves are combined the same way, level by level, until one document is left in each source.
That one is rounded to the nearer side, so a source misses its target by half of one document at
most. Pairs, order and chance come from hashes of keys, so reruns agree.

Repeated rows (equal key, size and source) are one unit with a multiplicity and share its copies
evenly. Null keys and sources are values like any other; documents without words take nothing.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registra.sources.tables import written

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # taken words as a fraction of all words
MOST_COPIES = 2
LEAF = 256
#: Copies of one row that a task writes at a time.
ROWS_AT_ONCE = 1 << 16

UNIT = "struct<id: bigint, size: bigint, n: bigint, base: bigint, p: double>"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _ranked(sources: DataFrame) -> DataFrame:
    """``rank`` of each source by code point, null last, from 1; no task holds all sources."""
    parts = written(
        sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()),
        "sources",
    )
    local = parts.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")))
    # one row per partition
    before = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")
    )
    return local.join(before, F.col("part") == F.col("p")).select("source", "source_size", (F.col("before") + F.col("at")).alias("rank"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """``source``, ``source_size``, ``rank`` and ``target`` for a table of ``source`` and ``source_size``.

    Sources in code point order, null last, weigh ``weights``, repeating, and share ``share`` of all
    words; a target stops at ``most`` times its source, and the excess goes to the others by weight
    until none is above. Each round is one aggregate; only sums come to the driver.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    table = written(
        _ranked(sources).withColumn("weight", F.get(cycle, F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int")).cast("bigint")),
        "source-weights",
    )

    def exact(x: int) -> Column:
        return F.lit(Decimal(x)).cast("decimal(38,0)")

    def wide(name: str) -> Column:
        return F.col(name).cast("decimal(18,0)")

    row = table.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, weight = int(row["size"] or 0), int(row["weight"] or 0)
    free = share[0] * total  # words to share out, times share[1]
    count = -1
    while True:
        # a source is full when most * size <= weight * free / (share[1] * all weights)
        full = wide("source_size") * exact(most * share[1] * weight).cast("decimal(20,0)") <= wide("weight") * exact(free).cast("decimal(20,0)")
        row = table.agg(
            F.count_if(full).alias("n"), F.sum(F.when(full, F.col("source_size"))).alias("size"), F.sum(F.when(~full, F.col("weight"))).alias("weight")
        ).first()
        if row["n"] == count or not row["weight"]:
            break
        count, weight = row["n"], int(row["weight"])
        free = share[0] * total - share[1] * most * int(row["size"] or 0)
    level = F.col("weight").cast("double") * F.lit(float(free)) / F.lit(float(share[1] * max(weight, 1)))
    return table.select("source", "source_size", "rank", F.least(F.col("source_size") * F.lit(float(most)), level).alias("target"))


def _let(value: Column, use) -> Column:
    """Work out ``value`` once and use it in an expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _meet(state: Column, x: Column, seed: int) -> Column:
    """The carried document meets ``x``: one becomes whole, the other is carried on."""

    def changed(unit: Column, p: Column) -> Column:
        return F.struct(*[unit[f].alias(f) for f in ("id", "size", "n", "base")], p.alias("p"))

    def moved(r: Column) -> Column:
        c, up, down = r["c"], r["up"], r["down"]
        rise = r["u"] * (up + down) < down
        first = F.when(rise, r["room"] <= r["other"]).otherwise(r["held"] <= r["space"])  # the carried one becomes whole
        c_p = F.when(first, F.when(rise, 1.0).otherwise(0.0)).otherwise(F.when(rise, c["p"] + up / c["size"]).otherwise(c["p"] - down / c["size"]))
        x_p = F.when(~first, F.when(rise, 0.0).otherwise(1.0)).otherwise(F.when(rise, x["p"] - up / x["size"]).otherwise(x["p"] + down / x["size"]))
        x_p, c_p = (F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) for p in (x_p, c_p))
        whole = F.when(first, changed(c, c_p)).otherwise(changed(x, x_p))
        rest = F.when(first, changed(x, x_p)).otherwise(changed(c, c_p))
        return F.struct(rest.alias("c"), F.array_append(state["out"], whole).alias("out"))

    c = state["c"]
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), c["id"], c["size"], x["id"], x["size"]), 11) / F.lit(float(1 << 53))
    room, other = (1 - c["p"]) * c["size"], x["p"] * x["size"]
    held, space = c["p"] * c["size"], (1 - x["p"]) * x["size"]
    facts = F.struct(
        c.alias("c"), chance.alias("u"), room.alias("room"), other.alias("other"), held.alias("held"), space.alias("space"),
        F.least(room, other).alias("up"), F.least(held, space).alias("down"),
    )
    return F.when(c.isNull(), F.struct(x.alias("c"), state["out"].alias("out"))).otherwise(_let(facts, moved))


def _leaf(units: DataFrame, seed: int) -> DataFrame:
    """One row per leaf: the documents that became whole, and the one that did not."""
    unit = F.struct(*[F.col(f) for f in ("id", "size", "n", "base", "p")])
    listed = F.transform(
        F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed), "id", "size").alias("h"), unit.alias("x")))), lambda e: e["x"]
    )
    start = F.struct(F.lit(None).cast(UNIT).alias("c"), F.array().cast(f"array<{UNIT}>").alias("out"))
    grouped = units.groupBy("rank", "leaf").agg(listed.alias("units"))
    return grouped.select("rank", "leaf", F.aggregate("units", start, lambda s, x: _meet(s, x, seed)).alias("s")).select("rank", "leaf", "s.*")


def mix(sized: DataFrame, seed: int = 0, leaf: int = LEAF, **share) -> DataFrame:
    """``id``, ``size``, ``source``, ``source_size``, ``target`` and ``taken`` words for each row of ``id``, ``size``, ``source``.

    ``share`` goes to ``targets``. A document is taken a whole number of times.
    """
    units = written(sized.groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("n")), "units")
    sources = units.groupBy("source").agg(
        F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).cast("bigint").alias("source_size")
    )
    table = written(targets(sources, **share), "targets")
    # every source's own number of leaves
    spread = units.where("size > 0").groupBy("source").agg(F.ceil(F.count(F.lit(1)) / leaf).alias("leaves"))
    named = table.join(spread.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("s"), "source_size", "target", "rank", F.coalesce("leaves", F.lit(1)).alias("leaves")
    )
    named = written(named, "source-leaves")
    copies = F.when(F.col("size") > 0, F.col("n") * F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = units.join(named, F.col("source").eqNullSafe(F.col("s"))).select(
        "rank", "id", "size", "n", copies.alias("copies"),
        F.pmod(F.xxhash64(F.lit(seed), "id", "size"), F.col("leaves")).alias("leaf"),
    )
    placed = written(
        placed.select("rank", "leaf", "id", "size", "n", F.floor("copies").cast("bigint").alias("base"), (F.col("copies") - F.floor("copies")).alias("p")),
        "placed",
    )
    done = [placed.where("p = 0").select("rank", "id", "size", "n", F.col("base").alias("total"))]
    most = named.agg(F.max("leaves").alias("m")).first()["m"] or 1
    layer, level = placed.where("p > 0"), seed
    while True:
        level += 1
        layer = written(_leaf(layer, level), "level")
        whole = layer.select("rank", F.explode("out").alias("x")).select(
            "rank", "x.id", "x.size", "x.n", (F.col("x.base") + F.col("x.p").cast("bigint")).alias("total")
        )
        done.append(whole)
        if most <= 1:
            break
        most = -(-most // leaf)
        layer = layer.where("c is not null").select("rank", F.floor(F.col("leaf") / leaf).cast("bigint").alias("leaf"), "c.*")
    last = layer.where("c is not null").select(
        "rank", "c.id", "c.size", "c.n", (F.col("c.base") + F.when(F.col("c.p") >= 0.5, 1).otherwise(0)).alias("total")
    )
    result = last
    for part in done:
        result = result.union(part)
    # each unit back to its rows, in pieces so that no task writes a large unit alone
    pieces = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / ROWS_AT_ONCE).cast("bigint")))
    rows = result.select("*", pieces.alias("piece"))
    at = F.explode(F.sequence(F.col("piece") * ROWS_AT_ONCE, F.least("n", (F.col("piece") + 1) * ROWS_AT_ONCE) - 1))
    rows = rows.select("rank", "id", "size", "n", "total", at.alias("at"))
    taken = F.col("size") * (F.floor(F.col("total") / F.col("n")) + F.when(F.col("at") < F.col("total") % F.col("n"), 1).otherwise(0))
    named = named.select(F.col("rank").alias("r"), F.col("s").alias("source"), "source_size", "target")
    return rows.join(named, F.col("rank") == F.col("r")).select("id", "size", "source", "source_size", "target", taken.cast("bigint").alias("taken"))
