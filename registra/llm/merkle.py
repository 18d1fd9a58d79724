"""Merkle manifest of a table: one tree per group, one tree over the groups, an audit path per row.

Rows of a group are leaves in key order; every run of ``arity`` neighbours (the last may be shorter,
even one) has a parent, until one node is left, the group's root. The roots of the groups, in group
order, are the leaves of the tree above.

A level is a table of nodes with their index in the group. It is joined with itself once for each
sibling, on the computed index of that sibling (XOR for two, slot offsets otherwise); the nodes in
slot zero then hold their whole run and emit the parent. Levels are written, so no level works
out the ones below again. Audit paths come back down: a node's path is its siblings followed by its
parent's path, so a row meets one parent in each join and no group is ever in one task.

Keys ascend, null first; rows of one key go by their digest, so repeated rows are interchangeable.
Null is a group like any other and the first. A row alone in its group is the group's root, a group
alone the manifest's. An empty table has an empty manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registra.sources.tables import discard, written

ARITY = 3


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _hash(digests: Column) -> Column:
    """Digest of digests; each counts as its hexadecimal text."""
    return F.unhex(F.sha2(_hex(digests), 256))


def leaf_digest(*values: Column) -> Column:
    """Digest (binary) of a row: ``-`` for null, else byte length, colon and value, one after another."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows of ``grp``, ``key``, ``h`` with ``gid``, ``idx`` and ``n``: group number, place in the group, group size.

    Rows are sorted by range partitions and numbered by the sizes of the pieces that groups have in
    the partitions before. Numbers of groups ascend in group order.
    """
    rows = written(rows, "manifest-digests")  # range partitioning reads its rows twice, the texts behind them only once
    at = F.monotonically_increasing_id()
    ordered = rows.repartitionByRange("grp", "key", "h").sortWithinPartitions("grp", "key", "h")
    ordered = written(ordered.withColumns({"part": F.shiftright(at, 33), "at": at}), "manifest-rows")
    # one row for each group and partition it reaches
    pieces = ordered.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    group = Window.partitionBy("grp")
    pieces = pieces.select(
        F.col("grp").alias("g"), F.col("part").alias("p"), "first", F.min("first").over(group).alias("gid"), F.sum("c").over(group).alias("n"),
        F.coalesce(F.sum("c").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    met = ordered.join(pieces, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
    placed = met.select(*rows.columns, "gid", (F.col("before") + F.col("at") - F.col("first")).alias("idx"), "n")
    placed = written(placed, "manifest-leaves")
    discard(rows, ordered)
    return placed


def _sibling(idx: Column, offset: int, arity: int) -> Column:
    if arity == 2:
        return idx.bitwiseXOR(F.lit(1).cast("bigint"))
    slot = idx % arity
    return idx - slot + (slot + offset) % arity


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes with the joined digests of their siblings on the left and on the right."""
    out, found = nodes, []
    for offset in range(1, arity):
        other = nodes.select(F.col("gid").alias("g"), F.col("idx").alias("i"), F.col("h").alias(f"s{offset}"))
        place = _sibling(F.col("idx"), offset, arity)
        out = out.join(other, (F.col("gid") == F.col("g")) & (place == F.col("i")), "left").drop("g", "i")
        found.append(F.struct(place.alias("at"), F.col(f"s{offset}").alias("h")))
    siblings = F.array_sort(F.array(*found))

    def joined(side) -> Column:
        kept = F.filter(siblings, lambda s: s["h"].isNotNull() & side(s["at"]))
        return F.aggregate(kept, F.lit(b""), lambda a, s: F.concat(a, s["h"]))

    left, right = joined(lambda at: at < F.col("idx")), joined(lambda at: at > F.col("idx"))
    return out.select(*nodes.columns, left.alias("left"), right.alias("right"))


def _climb(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of nodes that have a parent, from below, and the roots (``gid``, ``level``, ``h``).

    ``leaves`` holds ``gid``, ``idx``, ``n``, ``h`` and any columns that only the lowest level keeps.
    """
    most = leaves.agg(F.max("n").alias("n")).first()["n"] or 1
    nodes, levels, roots = leaves, [], None
    while True:
        tops = nodes.where("n = 1").select("gid", F.lit(len(levels)).alias("level"), "h")
        roots = tops if roots is None else roots.union(tops)
        if most <= 1:
            return levels, written(roots, "manifest-roots")
        levels.append(written(_with_siblings(nodes.where("n > 1"), arity), "manifest-level"))
        most = -(-most // arity)
        nodes = levels[-1].where(F.col("idx") % arity == 0).select(
            "gid", F.floor(F.col("idx") / arity).cast("bigint").alias("idx"), F.ceil(F.col("n") / arity).cast("bigint").alias("n"),
            _hash(F.concat("h", "right")).alias("h"),
        )


def _descend(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """``leaves`` with ``path`` and ``up``, what their root carries.

    ``tops`` holds ``gid``, ``level``, ``path`` (of the root) and ``up`` for every group.
    """

    def root(level: int) -> DataFrame:
        return tops.where(F.col("level") == level).select("gid", F.lit(0).cast("bigint").alias("idx"), "path", "up")

    above = root(len(levels))
    for level in range(len(levels) - 1, -1, -1):
        parents = above.select(F.col("gid").alias("g"), F.col("idx").alias("i"), F.col("path").alias("rest"), "up")
        nodes = levels[level]
        parent = F.floor(F.col("idx") / arity).cast("bigint")
        joined = nodes.join(parents, (F.col("gid") == F.col("g")) & (parent == F.col("i")))
        kept = [c for c in nodes.columns if c not in ("left", "right")] if level == 0 else ["gid", "idx"]
        path = F.concat(F.array(F.struct("left", "right")), "rest")
        found = joined.select(*kept, path.alias("path"), "up")
        if level:
            above = found.unionByName(root(level))
    alone = leaves.where("n = 1").join(root(0).drop("idx"), "gid").select(*leaves.columns, "path", "up")
    return found.select(*leaves.columns, "path", "up").union(alone) if levels else alone


def manifest(docs: DataFrame, key: str, group: str, leaf: Column, carried: Column | None = None, arity: int = ARITY) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``leaf``, ``subroot``, ``root``, ``path`` and ``carried``.

    ``leaf`` is the row's digest (see :func:`leaf_digest`), ``carried`` any further value of the row.
    ``path`` lists, from the leaf up to the root, the joined digests of the siblings on the ``left``
    and on the ``right`` at each level; both may be empty. Digests are binary.
    """
    if arity < 2:
        raise ValueError("a run has two nodes at least")
    carried = F.lit(None).cast("string") if carried is None else carried
    rows = docs.select(F.col(group).alias("grp"), F.col(key).alias("key"), leaf.alias("h"), carried.alias("carried"))
    leaves = _placed(rows).drop("grp")
    levels, roots = _climb(leaves, arity)
    # the tree above: groups ascend with their numbers
    groups = _placed(roots.select(F.lit(0).alias("grp"), F.col("gid").alias("key"), "h", "level")).drop("grp")
    upper, one = _climb(groups, arity)
    none = F.array().cast("array<struct<left: binary, right: binary>>")
    one = one.select("gid", "level", none.alias("path"), F.struct(F.col("h").alias("root")).alias("up"))
    above = _descend(groups, upper, one, arity).select(
        F.col("key").alias("gid"), "level", "path", F.struct(F.col("h").alias("subroot"), F.col("up.root").alias("root")).alias("up")
    )
    found = _descend(leaves, levels, written(above, "manifest-groups"), arity)
    return found.select(F.col("key").alias(key), F.col("h").alias("leaf"), "up.subroot", "up.root", "path", "carried")


def proof_digest(path: Column) -> Column:
    """Hexadecimal digest of all siblings of a path, level by level, left to right."""
    siblings = F.aggregate(path, F.lit(b""), lambda a, p: F.concat(a, p["left"], p["right"]))
    return _hex(_hash(siblings))


def folded_root(leaf: Column, path: Column) -> Column:
    """The root (binary) that a leaf digest gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda a, p: _hash(F.concat(p["left"], a, p["right"])))
