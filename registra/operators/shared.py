"""Pairs of groups that share members, without spelling out every pair of a large member.

A member that belongs to ``d`` groups would yield ``d * (d - 1) / 2`` pairs. Both forms below are
exact and rest on the same index: members are ordered by how many groups they have, and a group is
filed only under those members that a pair of the wanted weight must share.

A pair of weight ``w`` shares a member besides the ``w - 1`` most frequent ones of either group, so
each group may leave these aside. With ``cut`` as the least member that a group leaves aside, all
shared members below both cuts meet in the index, and all others are left aside by the group with
the lesser cut.

All pairs (:func:`shared_member_pairs`): only heavy members, of more than ``heavy`` groups, are left
aside; the others make at most ``heavy`` pairs per link. How many of the members left aside a pair
shares is settled by comparing the two lists and looking up the rest of the lesser-cut one.

Before either, where that shuffles less: groups meet in two members at once (:func:`_pairs_by_twos`), so that pairs
of weight one, nearly all where members are spread at random, are not spelled out.

The best ``k`` pairs (:func:`top_shared_pairs`):

* *Equal groups are one class.* Overlaps are worked out per pair of classes, and a pair of classes is
  spelled out only as far as a top list can reach: ties are broken by id, so the pair of the i-th and
  the j-th id is preceded by all pairs of earlier ids.
* *The weight to reach rises.* The best pairs among the largest classes give a weight that the list
  reaches in any case. It drops smaller classes, shortens what the others are filed under, and so
  lets more classes be compared, which raises it again.
* *Pairs that meet are sifted by signatures*, bit sets of the members of a class: members of one that
  are not in the other are known to be missing. What passes is counted exactly.

A member that many groups are filed under is dealt out as blocks of one side, and the number of
tasks follows the number of pairs, not the number of links.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registra.operators.paging import top_k_per_group
from registra.sources.tables import discard, written

HEAVY = 2_000
#: Pairs that a task works out.
PAIRS_PER_TASK = 4_000_000
#: Pairs that the blocks of a member make; a member of more than ``heavy`` groups makes more.
PAIRS_PER_BLOCK = 1_000_000
#: Pairs that a probe may make, to raise the weight before all classes are compared.
PROBED_PAIRS = 5_000_000
#: Pairs that are counted without any of this.
FEW_PAIRS = 20_000_000
#: Members of a group up to which its pairs of members are spelled out.
FEW_MEMBERS = 64
#: Rows a link, with those of every shuffle, up to which a top list is made from pairs of members.
ROWS_PER_LINK = 32
#: Longs in the bit set of a class.
SIGNATURE = 4
_BITS = tuple(f"s{i}" for i in range(SIGNATURE))


def memberships(df: DataFrame, member: Column, group: Column) -> DataFrame:
    """Distinct (member, grp) with neither side null."""
    pairs = df.select(member.alias("member"), group.alias("grp"))
    return pairs.where(F.col("member").isNotNull() & F.col("grp").isNotNull()).distinct()


def _sizes(links: DataFrame) -> DataFrame:
    """Members of two groups or more, with their number."""
    return links.groupBy("member").agg(F.count(F.lit(1)).alias("size")).where("size > 1")


def _meetings(sizes: DataFrame) -> tuple[int, int]:
    """Pairs that meet in some member, once per member, and the size of the largest member."""
    row = sizes.agg(F.sum(F.col("size").cast("double") * F.col("size")) / 2, F.max("size")).first()
    return int(row[0] or 0), int(row[1] or 0)


def _met(rows: DataFrame, sizes: DataFrame, meetings: int, carried: tuple[str, ...], heavy: int) -> DataFrame:
    """Pairs ``source < target`` that meet in a member, once per member, with what each row carried.

    Few links make many pairs, so both sides are dealt to a number of tasks that follows the pairs;
    it also keeps adaptive execution from merging the small-looking inputs.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-meetings // PAIRS_PER_TASK))
    rows = rows.join(sizes, "member")
    cut = F.ceil(F.col("size") * F.least("size", F.lit(heavy)) / PAIRS_PER_BLOCK)
    blocks = F.greatest(F.ceil(F.col("size") / heavy), cut).cast("int")
    a, b = ([F.struct(*carried).alias(n)] if carried else [] for n in "ab")
    left = rows.select(
        "member", F.col("grp").alias("source"), *a,
        F.pmod(F.xxhash64("grp"), blocks).cast("int").alias("block"),
    )
    right = rows.select(
        "member", F.col("grp").alias("target"), *b,
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
    )
    place = ["member", "block"]
    both = left.repartition(tasks, *place).join(right.repartition(tasks, *place), place)
    return both.where(F.col("source") < F.col("target")).drop(*place)


def _all_weights(links: DataFrame, sizes: DataFrame, meetings: int, heavy: int) -> DataFrame:
    met = _met(links, sizes, meetings, (), heavy)
    return met.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def _twos(lists: DataFrame) -> DataFrame:
    """Each two members of a group, the lesser first."""
    first = lists.select("grp", "members", F.posexplode("members").alias("i", "first"))
    rest = F.slice("members", F.col("i") + 2, F.size("members"))
    return first.select("grp", "first", F.explode(rest).alias("second"))


def _pairs_by_twos(links: DataFrame, sizes: DataFrame, most: int, heavy: int) -> DataFrame | None:
    """All pairs of groups with at least two shared members, met in two members at once.

    A pair that shares ``w`` members meets ``w * (w - 1) / 2`` times, which gives its weight; pairs that share one
    member never meet. Pairs with a group of more than ``FEW_MEMBERS`` members meet member by member. None where
    this shuffles more than ``most`` rows, or more than ``heavy`` groups hold the same two members.
    """
    spark = links.sparkSession
    numbered = written(sizes.withColumn("id", F.monotonically_increasing_id()), "numbered_members")
    rows = written(links.join(numbered, "member").select(F.col("id").alias("member"), "grp", "size"), "met_links")
    groups = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("meets"))
    n, few = F.col("n").cast("double"), F.col("n") <= FEW_MEMBERS
    spelled, large = groups.agg(F.sum(F.when(few, n * (n - 1) / 2)), F.sum(F.when(~few, F.col("meets")))).first()
    rest = most - int(large or 0) - 3 * int(spelled or 0)
    if rest < 0:
        discard(numbered, rows)
        return None
    many = written(groups.where(~few).select("grp"), "large_groups")
    lists = rows.join(many, "grp", "left_anti") if large else rows
    lists = lists.groupBy("grp").agg(F.array_sort(F.collect_list("member")).alias("members")).where(F.size("members") > 1)
    lists = written(lists, "member_lists")
    key = ["first", "second"]
    twos = _twos(lists).groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    twos = written(twos, "twos")
    meetings, largest = _meetings(twos)
    if meetings > rest or largest > heavy:
        discard(numbered, rows, many, lists, twos)
        return None
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-meetings // PAIRS_PER_TASK))
    met = _twos(lists).join(twos.select(*key), key, "left_semi").repartition(tasks, *key)
    both = met.withColumnRenamed("grp", "source").join(met.withColumnRenamed("grp", "target"), key)
    times = both.where(F.col("source") < F.col("target")).groupBy("source", "target").agg(F.count(F.lit(1)).alias("c"))
    pairs = times.select("source", "target", F.round((F.sqrt(8 * F.col("c") + 1) + 1) / 2).cast("bigint").alias("weight"))
    if not large:
        return pairs
    flagged = rows.join(many.withColumn("large", F.lit(True)), "grp", "left").fillna(False, "large")
    touched = flagged.where("large").select("member").distinct()
    flagged = written(flagged.join(touched, "member", "left_semi").drop("size"), "touched_links")
    shared = written(_sizes(flagged), "sizes")
    beside = _met(flagged, shared, _meetings(shared)[0], ("large",), heavy).where("a.large OR b.large")
    beside = beside.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))
    return pairs.unionByName(beside.where("weight > 1"))


def shared_member_pairs(
    links: DataFrame, at_least: int = 2, heavy: int = HEAVY
) -> DataFrame:
    """All pairs ``source < target`` of groups with ``weight >= at_least`` shared members.

    ``links`` is the result of :func:`memberships`. They are written once, since the plan reads
    them several times.
    """
    if at_least < 2:
        raise ValueError("pairs must share at least two members")
    links = written(links, "links")
    sizes = written(_sizes(links), "sizes")
    meetings, largest = _meetings(sizes)
    pairs = _pairs_by_twos(links, sizes, meetings, heavy) if meetings > FEW_PAIRS else None
    if pairs is not None:
        return pairs.where(F.col("weight") >= at_least)
    if largest <= heavy:
        return _all_weights(links, sizes, meetings, heavy).where(F.col("weight") >= at_least)
    heavy_links = written(links.join(sizes.where(F.col("size") > heavy), "member"), "heavy_links")
    order = [F.desc("size"), F.desc("member")]
    kept_aside = top_k_per_group(heavy_links, ["grp"], order, at_least - 1, "place")
    asides = kept_aside.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("size", "member"))).alias("aside"))

    # a group files the links below the members it leaves aside; at most at_least - 1 are listed
    none = F.array().cast(asides.schema["aside"].dataType)
    rows = links.join(sizes, "member").join(asides, "grp", "left")
    below = F.col("aside").isNull() | (F.struct("size", "member") < F.get("aside", F.lit(0)))
    rows = written(rows.where(below).select("member", "grp", F.coalesce("aside", none).alias("aside")), "filed")
    sizes = written(_sizes(rows), "sizes")
    met = (
        _met(rows, sizes, _meetings(sizes)[0], ("aside",), heavy)
        .groupBy("source", "target", F.col("a.aside").alias("a"), F.col("b.aside").alias("b"))
        .agg(F.count(F.lit(1)).alias("met"))
    )

    # a shared member that did not meet is left aside by the group with the lesser cut; no cut is the greatest
    a, b = F.col("a"), F.col("b")
    a_first = (F.size(b) == 0) | ((F.size(a) > 0) & (F.get(a, F.lit(0)) <= F.get(b, F.lit(0))))
    lesser, other = F.when(a_first, a).otherwise(b), F.when(a_first, b).otherwise(a)
    both = (F.size(a) > 0) | (F.size(b) > 0)
    met = met.select(
        "source", "target", (F.col("met") + F.size(F.array_intersect(a, b))).alias("met"),
        F.when(both, F.filter(F.array_except(lesser, other), lambda m: (F.size(other) == 0) | (m < F.get(other, F.lit(0))))).alias("asked"),
        F.when(a_first, F.col("target")).otherwise(F.col("source")).alias("grp"),
    )
    open_ones = F.size("asked") > 0
    settled = met.where(~F.coalesce(open_ones, F.lit(False))).select("source", "target", F.col("met").alias("weight"))
    asked = met.where(open_ones).select("source", "target", "met", "grp", F.explode("asked.member").alias("member"))
    known = heavy_links.select("member", "grp", F.lit(1).alias("hit"))
    looked_up = (
        asked.join(known, ["member", "grp"], "left").groupBy("source", "target", "met")
        .agg(F.count("hit").alias("hits")).select("source", "target", (F.col("met") + F.col("hits")).alias("weight"))
    )
    return settled.unionByName(looked_up).where(F.col("weight") >= at_least)


def _marks(links: DataFrame) -> DataFrame:
    """Size of every group and two independent 64-bit hashes of its members.

    The hashes aggregate without collecting the members of a group anywhere. Groups that agree in
    all three are taken to have the same members.
    """
    return links.groupBy("grp").agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.xxhash64("member")).alias("h1"),
            F.bit_xor(F.xxhash64(F.lit("second"), "member")).alias("h2"),
        ).alias("cls")
    )


def _summaries(links: DataFrame) -> DataFrame:
    """Size ``n`` of every group and its signature: a bit for each member, by hash."""
    place = F.pmod(F.xxhash64("member"), F.lit(64 * SIGNATURE)).cast("int")
    flag = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)))
    bits = [
        F.bit_or(F.when(F.shiftright(place, 6) == i, flag).otherwise(F.lit(0).cast("bigint"))).alias(s)
        for i, s in enumerate(_BITS)
    ]
    return links.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *bits)


def _most_shared(a: Column, b: Column) -> Column:
    """No more members than this can be shared: bits of one that the other lacks are missing members."""

    def of(x: Column, y: Column) -> Column:
        missing = [F.bit_count(x[s].bitwiseAND(F.bitwise_not(y[s]))) for s in _BITS]
        return x["n"] - reduce(add, missing)

    return F.least(of(a, b), of(b, a))


def _pairs_from(links: DataFrame, weight: int, heavy: int) -> DataFrame:
    """All pairs of groups with at least ``weight`` shared members, by prefix, signature and count."""
    rows = links.join(_sizes(links), "member")
    rows = written(rows.join(_summaries(rows).where(F.col("n") >= weight), "grp"), "sized_links")
    order = [F.desc("size"), F.desc("member")]
    aside = top_k_per_group(rows.select("grp", "member", "size"), ["grp"], order, weight - 1, "place")
    filed = rows.join(aside.select("grp", "member"), ["grp", "member"], "left_anti").drop("size") if weight > 1 else rows.drop("size")
    sizes = written(_sizes(filed), "sizes")
    met = _met(filed, sizes, _meetings(sizes)[0], ("n", *_BITS), heavy).where(_most_shared(F.col("a"), F.col("b")) >= weight)
    # the members of the smaller group are looked up in the other
    fewer = F.col("a.n") <= F.col("b.n")
    asked = met.select(
        F.when(fewer, F.col("source")).otherwise(F.col("target")).alias("grp"),
        F.when(fewer, F.col("target")).otherwise(F.col("source")).alias("other"),
    ).distinct()
    members = rows.select("grp", "member")
    there = rows.select(F.col("grp").alias("other"), "member")
    counted = (
        asked.join(members, "grp").join(there, ["other", "member"], "left_semi")
        .groupBy("grp", "other").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= weight)
    )
    return counted.select(F.least("grp", "other").alias("source"), F.greatest("grp", "other").alias("target"), "weight")


def _reached_weight(links: DataFrame, k: int, at_least: int, heavy: int) -> int:
    """A weight that the ``k``-th best pair has at least, from pairs of the largest groups.

    As many groups are compared as make at most ``PROBED_PAIRS`` meetings, but no fewer than have
    ``4 * k`` pairs.
    """
    sizes = links.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    count, least = sizes.count(), int((8 * k) ** 0.5) + 2
    most = least
    while most * 16 < count:
        most *= 8
    if most * 2 > count:
        return at_least
    while True:
        chosen = sizes.orderBy(F.desc("n"), F.asc("grp")).limit(most)
        few = written(links.join(chosen.select("grp"), "grp", "left_semi"), "probed_links")
        shared = _sizes(few)
        meetings = _meetings(shared)[0]
        if meetings <= PROBED_PAIRS or most == least:
            found = _all_weights(few, shared, meetings, heavy)
            last = found.orderBy(F.desc("weight")).offset(k - 1).limit(1).select("weight").first()
            discard(few)
            return max(at_least, last["weight"]) if last else at_least
        discard(few)
        most = max(least, most // 8)


def _heavy_pairs(links: DataFrame, k: int, at_least: int, heavy: int = HEAVY) -> DataFrame:
    """Pairs of groups, by classes of equal groups, as far as the best ``k`` can reach."""
    ids = written(top_k_per_group(_marks(links), ["cls"], [F.asc("grp")], k + 1, "place"), "classes")
    held = ids.groupBy("cls").agg(F.count(F.lit(1)).alias("held"))
    one = ids.where(F.col("place") == 1).join(held, "cls").select("grp", "cls", "held")
    repeated = not ids.where("place > 1").isEmpty()
    of_class = written(links.join(one.select("grp"), "grp", "left_semi"), "class_links") if repeated else links
    least = _reached_weight(of_class, k, at_least, heavy)
    a = one.select(F.col("grp").alias("source"), F.col("cls").alias("cls_a"), F.col("held").alias("held_a"))
    b = one.select(F.col("grp").alias("target"), F.col("cls").alias("cls_b"), F.col("held").alias("held_b"))
    columns = ["cls_a", "cls_b", "held_a", "held_b", "weight"]
    crossed = _pairs_from(of_class, least, heavy).join(a, "source").join(b, "target").select(*columns)
    inside = one.where((F.col("held") > 1) & (F.col("cls.n") >= at_least)).select(
        F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"), F.col("held").alias("held_a"),
        F.col("held").alias("held_b"), F.col("cls.n").alias("weight"),
    )
    classes = written(crossed.union(inside), "class_pairs")

    # Pairs of classes that come after k better pairs are not needed. One row per weight here.
    same = F.col("cls_a") == F.col("cls_b")
    many = F.when(same, F.col("held_a") * (F.col("held_a") - 1) / 2).otherwise(
        F.col("held_a") * F.col("held_b")
    )
    per_weight = classes.groupBy("weight").agg(F.sum(F.least(many, F.lit(k))).alias("pairs"))
    better = F.sum("pairs").over(Window.orderBy(F.desc("weight")))
    enough = per_weight.withColumn("better", better).where(F.col("better") >= k)
    floor = F.coalesce(enough.agg(F.max("weight")).scalar(), F.lit(0))

    first = ids.select(F.col("cls").alias("cls_a"), F.col("grp").alias("x"), F.col("place").alias("i"))
    second = ids.select(F.col("cls").alias("cls_b"), F.col("grp").alias("y"), F.col("place").alias("j"))
    i = F.col("i")
    # before (i, j) come i * j - 1 pairs, or fewer by the triangle when both are of one class
    lowest = F.when(same, i + 1).otherwise(1)
    highest = F.when(same, F.floor((k + i * (i + 1) / 2) / i)).otherwise(F.floor(F.lit(k) / i))
    highest = F.least(highest, F.col("held_b")).cast("int")
    return (
        classes.where(F.col("weight") >= floor)
        .join(first, "cls_a")
        .where(lowest <= highest)
        .withColumn("j", F.explode(F.sequence(lowest, highest)))
        .join(second, ["cls_b", "j"])
        .select(
            F.least("x", "y").alias("source"), F.greatest("x", "y").alias("target"), "weight"
        )
    )


def top_shared_pairs(
    links: DataFrame, k: int = 500, at_least: int = 2, heavy: int = HEAVY
) -> DataFrame:
    """The ``k`` pairs with the most shared members, ties by source and target.

    Where all links make few pairs, ``FEW_PAIRS``, these are counted; the result is the same. Else members
    of one group and groups of fewer than ``at_least`` other members go first.
    """
    links = written(links, "links")
    best = [F.desc("weight"), F.asc("source"), F.asc("target")]
    sizes = written(_sizes(links), "sizes")
    meetings = _meetings(sizes)[0]
    if meetings <= FEW_PAIRS:
        found = _all_weights(links, sizes, meetings, heavy).where(F.col("weight") >= at_least)
        return found.orderBy(*best).limit(k)
    found = _pairs_by_twos(links, sizes, min(meetings, ROWS_PER_LINK * links.count()), heavy) if at_least > 1 else None
    if found is not None:
        return found.where(F.col("weight") >= at_least).orderBy(*best).limit(k)
    shared = links.join(sizes.select("member"), "member", "left_semi")
    groups = shared.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)
    shared = written(shared.join(groups.select("grp"), "grp", "left_semi"), "shared_links")
    discard(links, sizes)
    return _heavy_pairs(shared, k, at_least, heavy).orderBy(*best).limit(k)
