"""Near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint is cut into segments. Two fingerprints that differ in few bits differ in very few bits
of at least one segment, so each fingerprint is filed under every value within a small Hamming
distance of each of its segments, and only fingerprints filed together are compared in full.

Null and empty texts have fingerprint zero and link like any other; rows with a null id take part,
but never name a class. Repeated rows and copies share one fingerprint, so a group of copies of any
size counts as one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registra.llm import bitsets
from registra.llm.components import components
from registra.llm.words import LOWER, runs, slices, spans
from registra.sources.tables import discard, written

SEED = 42
#: Rows of one key that a task compares among themselves; keys with more are dealt out in blocks.
BLOCK_ROWS = 4096
#: Rows of one key up to which all pairs are tried; larger groups are searched link by link.
SMALL_GROUP = 256
#: Comparisons that cost as much as filing a fingerprint under one value, which has to be shuffled and sorted.
FILING = 20
#: A fingerprint that more than one in so many rows has is joined by broadcast; there can be no more than this many.
MOST_HOT = 10_000


def fingerprints(column: pa.Array, shingle: int) -> np.ndarray:
    """Unsigned 64-bit fingerprints of a text column."""
    out = np.zeros(len(column), np.uint64)
    for first, last, data, offsets in slices(column):
        starts, ends, before = spans(data, offsets)
        if not len(starts):
            continue
        # the words in lower case, each followed by one space
        lengths = ends - starts
        owner = np.repeat(np.arange(len(starts)), lengths)
        text = np.full(int(lengths.sum()) + len(starts), 0x20, np.uint8)
        source = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        text[np.arange(len(owner)) + owner] = LOWER[data[source]]
        text_ends = np.cumsum(lengths + 1) - 1
        text_starts = text_ends - lengths

        words = np.diff(before)
        counts = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
        row = np.repeat(np.arange(len(words)), counts)
        head = before[:-1][row] + np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
        tail = np.minimum(head + shingle, before[1:][row]) - 1
        blob, digest = text.tobytes(), xxhash.xxh64_intdigest
        hashes = np.array(
            [digest(blob[a:b], SEED) for a, b in zip(text_starts[head].tolist(), text_ends[tail].tolist())], np.uint64
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        some = np.flatnonzero(counts)
        ones = np.add.reduceat(bits, (np.cumsum(counts) - counts)[some], axis=0, dtype=np.int64)
        major = np.packbits(2 * ones > counts[some, None], axis=1, bitorder="little")
        out[first + some] = np.ascontiguousarray(major).view(np.uint64)[:, 0]
    return out


def fingerprint(text: str, shingle: int):
    """Column of signed fingerprints of the text column."""

    @F.arrow_udf("bigint")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(fingerprints(column, shingle).view(np.int64))

    return run(F.col(text))


def segments(count: int, distance: int) -> list[tuple[int, int, int]]:
    """Shift, width and search radius of each segment.

    With radii that sum to ``distance - segments + 1``, two fingerprints within ``distance`` lie within
    the radius in some segment. More, shorter segments file each fingerprint under fewer values but
    bring more strangers together; the number is chosen for the least weighted sum of both at
    ``count`` fingerprints. Any choice gives the same links.
    """
    best = None
    for n in range(1, distance + 2):
        widths = [64 // n + (i < 64 % n) for i in range(n)]
        spare = distance - n + 1
        radii = [spare // n + (i < spare % n) for i in range(n)]
        filed = [sum(_choose(w, r) for r in range(radius + 1)) for w, radius in zip(widths, radii)]
        if sum(filed) > 5000:
            continue
        cost = FILING * count * sum(filed) + count * count / 2 * sum(f / 2.0**w for f, w in zip(filed, widths))
        if best is None or cost < best[0]:
            shifts = np.cumsum([0, *widths[:-1]])
            best = cost, [(int(s), w, r) for s, w, r in zip(shifts, widths, radii)]
    return best[1]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _filed(fp, plan: list[tuple[int, int, int]], places: bool = True):
    """Array of the keys a fingerprint is filed under: segment number in the top byte, then the value.

    Without ``places`` only the keys of its own values.
    """
    parts = []
    for i, (shift, width, radius) in enumerate(plan):
        own = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit(_signed((1 << width) - 1)))
        if len(plan) > 1:
            own = own.bitwiseOR(F.lit(i << 56))
        masks = [sum(1 << b for b in at) for r in range(radius + 1) for at in combinations(range(width), r)]
        if not places or len(masks) == 1:
            parts.append(F.array(own))
        else:
            near = F.array(*[F.lit(_signed(m)).cast("bigint") for m in masks])
            parts.append(F.transform(near, own.bitwiseXOR))
    return F.concat(*parts)


def _group_links(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys: all of small runs, a spanning forest of large ones."""
    cuts = runs(keys)
    sizes = np.diff(cuts)
    left, right = [], []
    run_size = np.repeat(sizes, sizes)
    at = np.flatnonzero((run_size > 1) & (run_size <= SMALL_GROUP))
    lag = 1
    while len(at):
        at = at[at + lag < len(keys)]
        at = at[keys[at] == keys[at + lag]]
        near = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= distance]
        left.append(fps[near])
        right.append(fps[near + lag])
        lag += 1
    for g in np.flatnonzero(sizes > SMALL_GROUP):
        rest = np.unique(fps[cuts[g]: cuts[g + 1]])
        while len(rest):
            # grow one component: each member is compared only with those not reached yet
            frontier, rest = [rest[0]], rest[1:]
            while frontier and len(rest):
                one = frontier.pop()
                near = np.bitwise_count(rest ^ one) <= distance
                if near.any():
                    found = rest[near]
                    left.append(np.full(len(found), one))
                    right.append(found)
                    frontier.extend(found)
                    rest = rest[~near]
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def links(nodes: DataFrame, distance: int, plan: list[tuple[int, int, int]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fp``) at most ``distance`` bits apart.

    They connect the same fingerprints as all links do, though in crowded groups not every pair is
    listed. A key with more than ``block_rows`` own fingerprints is dealt out as pairs of blocks, so
    a task holds two blocks at most.
    """
    fp = F.col("fp")
    filed = nodes.select("fp", F.explode(_filed(fp, plan)).alias("key"))
    hot = (
        nodes.select(F.explode(_filed(fp, plan, places=False)).alias("key"))
        .groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
    )
    if hot.isEmpty():
        cells = filed.withColumn("cell", F.lit(0).cast("bigint"))
    else:
        around = [
            F.when(F.shiftrightunsigned("key", 56) == i, F.transform(
                F.array(*[F.lit(_signed(sum(1 << b for b in at))).cast("bigint") for r in range(radius + 1) for at in combinations(range(width), r)]),
                lambda m: F.col("key").bitwiseXOR(m),
            ))
            for i, (_, width, radius) in enumerate(plan)
        ]
        crowded = written(
            hot.select("n", F.explode(F.coalesce(*around)).alias("key"))
            .groupBy("key").agg(F.ceil(F.sum("n") / block_rows).cast("bigint").alias("blocks")),
            "crowded-keys",
        )
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("blocks", F.lit(1)) - 1))
        cells = (
            filed.join(crowded, "key", "left").withColumn("mine", F.coalesce(mine, F.lit(0).cast("bigint")))
            .select("fp", "key", "mine", other.alias("other"))
            .select("fp", "key", (F.least("mine", "other") * (1 << 31) + F.greatest("mine", "other")).alias("cell"))
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            key, cell, fps = held
            last = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
            last = last[-1] + 1 if len(last) else 0
            if last:
                yield linked(key[:last], cell[:last], fps[:last])
                held = [x[last:] for x in held]
        if held is not None:
            yield linked(*held)

    def linked(key, cell, fps):
        run = np.zeros(len(key), np.int64)
        cuts = runs(key)
        run[cuts[1:-1]] = 1
        cuts = runs(cell)
        run[cuts[1:-1]] = 1
        a, b = _group_links(np.cumsum(run), fps.view(np.uint64), distance)
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return (
        cells.select("key", "cell", "fp").repartition("key", "cell").sortWithinPartitions("key", "cell")
        .mapInArrow(compare, "a bigint, b bigint")
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """``key``, ``tk`` (hash of the text), ``fp``, ``root`` and ``component_id`` for each row of ``docs``.

    ``fp`` is the signed fingerprint of the row's word shingles, ``root`` names the component of
    fingerprints linked at most ``distance`` bits apart, and ``component_id`` is the smallest key in
    it, the row's own included (null where no row of the component has a key).
    """
    return _near_duplicates(docs, key, text, shingle, distance)[0]


def _near_duplicates(docs: DataFrame, key: str, text: str, shingle: int, distance: int) -> tuple[DataFrame, list[DataFrame]]:
    """The classes, and the tables they are read from."""
    prints = written(
        docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("tk"), fingerprint(text, shingle).alias("fp")), "fingerprints"
    )
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "fingerprint-nodes")
    total = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    roots = written(components(links(nodes, distance, segments(total["nodes"], distance))), "roots")
    linked = roots.join(nodes, roots["node"] == nodes["fp"]).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(least, "root").select("fp", "root", "least")
    classes = written(
        nodes.join(linked, "fp", "left").select(
            "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component_id"),
            (F.col("n") * MOST_HOT > total["rows"]).alias("hot"),
        ),
        "fingerprint-classes",
    )
    hot = F.broadcast(classes.where("hot"))  # fewer than MOST_HOT
    rare = prints.join(hot, "fp", "left_anti").join(classes.where("not hot"), "fp")
    found = prints.join(hot, "fp").unionByName(rare)
    return found.select(F.col("id").alias(key), "tk", "fp", "root", "component_id"), [prints, nodes, roots, classes]


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` with one row of each class of near duplicates: that of the smallest key.

    Of several rows with that key the one whose text has the least hash stays, and of equal rows
    one; so it is for all rows of a class without any key. Only rows that may go are shuffled.
    """
    found, tables = _near_duplicates(docs.select(key, text), key, text, shingle, distance)
    rows = written(
        found.groupBy(F.col(key).cast("bigint").alias("id"), "tk").agg(
            F.first("root").alias("root"), F.first("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")
        ),
        "classes",
    )
    discard(*tables)
    first = rows.where("id <=> component_id")
    head = first.groupBy(F.col("root").alias("r")).agg(F.min("tk").alias("head"))
    first = first.join(head, F.col("root") == F.col("r")).select("id", "tk", (F.col("tk") == F.col("head")).alias("stays"), "n")
    others = rows.where("not id <=> component_id")
    odd = first.union(others.select("id", "tk", F.lit(False), "n"))
    odd = written(odd.where("not stays or n > 1").select("id", "tk", "stays"), "going")
    discard(rows)
    sure, maybe = bitsets.split(docs, odd, key, text)
    known = bitsets.match(maybe, odd.withColumnRenamed("stays", "__stays"), key, "left")
    once = known.where("__stays").dropDuplicates([key, "__tk"])
    return sure.union(known.where("__stays is null").select(*docs.columns)).union(once.select(*docs.columns))
