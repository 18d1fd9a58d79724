"""Benchmark passages in documents, found by greedy string tiling.

Documents and test items are sequences of tokens: runs of letters and digits, A-Z in lower case.
Runs of ``least`` tokens that both hold are the seeds of a join; each joined pair is tiled: the
longest matches that do not overlap are marked first, found by running Karp-Rabin with ever shorter
search lengths, until nothing of ``least`` tokens is left. The share of the item's tokens under
tiles does not depend on the order of its parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registra.llm import bitsets
from registra.llm.words import LOWER, NOT_ALNUM, slices, spans, window_hashes, windows, word_hashes
from registra.sources.tables import written

LEAST = 5
COVERAGE = 0.5
#: Pairs that a task tiles, up to so many tasks. Cost only, never the result.
PAIRS_PER_TASK, MOST_TASKS = 500, 20_000


def _tokens(column: pa.Array):
    """First row, token boundaries by row, and token hashes, for each slice."""
    for first, _, data, offsets in slices(column):
        starts, ends, before = spans(data, offsets, NOT_ALNUM)
        yield first, before, word_hashes(LOWER[data], starts, ends)


@F.arrow_udf(T.ArrayType(T.LongType()))
def token_hashes(column: pa.Array) -> pa.Array:
    sizes, values = [np.zeros(1, np.int64)], [np.zeros(0, np.uint64)]
    for _, before, hashes in _tokens(column):
        sizes.append(np.diff(before))
        values.append(hashes)
    offsets = np.cumsum(np.concatenate(sizes)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).view(np.int64)))


def _seeds(least: int, flags=None):
    """Column function: distinct hashes of all runs of ``least`` tokens, or those that ``flags`` lets through."""

    @F.arrow_udf("array<bigint>")
    def run(column: pa.Array) -> pa.Array:
        out: list[np.ndarray] = []
        none = np.zeros(0, np.int64)
        for _, before, hashes in _tokens(column):
            at = windows(before, least)
            seeds = window_hashes(hashes, at, least)
            if flags is not None:
                some = bitsets.hit(flags.value, seeds)
                at, seeds = at[some], seeds[some]
            row = np.searchsorted(before, at, side="right") - 1
            cut = np.searchsorted(row, np.arange(len(before)))
            out += [
                np.unique(seeds[a:b]).view(np.int64) if b > a else none
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())
            ]
        offsets = np.cumsum([0, *map(len, out)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([none, *out])))

    return run.asNondeterministic()  # else a filter on the seeds would look for them twice


class _Rolled:
    """Rolling hashes of a token sequence in which tokens get marked."""

    def __init__(self, tokens: np.ndarray):
        self.tokens, self.free = tokens, np.ones(len(tokens), bool)

    def unmarked(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows without a marked token."""
        if len(self.tokens) < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        marked = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(marked[length:] == marked[:-length])
        return at, window_hashes(self.tokens, at, length)

    def open(self, start: int, length: int) -> bool:
        """Whether a window is still unmarked, if since it was only windows of its length got marked."""
        return bool(self.free[start] and self.free[start + length - 1])


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles ``(length, item start, document start)`` of two token sequences, the longest first.

    Among tiles of equal length the first in the item goes first, then the first in the document. A
    search length is tried by comparing rolling hashes of all unmarked windows, so the work of one
    length is linear even where all tokens are equal, and an item of n tokens has fewer than
    sqrt(2 n) different lengths of tiles.
    """
    one, many = _Rolled(item), _Rolled(doc)
    tiles: list[tuple[int, int, int]] = []
    top = min(len(item), len(doc))
    while (length := _longest(one, many, least, top)) >= least:
        tiles += _mark(one, many, length)
        top = length - 1
    return tiles


def _longest(one: _Rolled, many: _Rolled, least: int, top: int) -> int:
    """The greatest length up to ``top`` at which both have an equal unmarked window; 0 below ``least``."""

    def common(length: int) -> bool:
        return bool(np.isin(one.unmarked(length)[1], many.unmarked(length)[1]).any())

    if top < least or not common(least):
        return 0
    low, step = least, least
    while low + step <= top and common(low + step):  # ever longer, then between the last two
        low, step = low + step, 2 * step
    high = min(top, low + step - 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if common(middle) else (low, middle - 1)
    return low


def _mark(one: _Rolled, many: _Rolled, length: int) -> list[tuple[int, int, int]]:
    """Mark the matches of the greatest length that do not overlap, in the order of the item."""
    at_i, hash_i = one.unmarked(length)
    at_d, hash_d = many.unmarked(length)
    order = np.argsort(hash_d, kind="stable")
    at_d, hash_d = at_d[order], hash_d[order]
    first, last = np.searchsorted(hash_d, hash_i, "left"), np.searchsorted(hash_d, hash_i, "right")
    tiles, reached = [], {}
    for n in np.flatnonzero(first < last).tolist():
        i = int(at_i[n])
        if not one.open(i, length):
            continue
        begin, end = int(first[n]), int(last[n])
        place = reached.get(begin, begin)
        while place < end and not many.open(at_d[place], length):
            place += 1
        reached[begin] = place  # what is marked stays marked
        if place < end and np.array_equal(one.tokens[i: i + length], many.tokens[at_d[place]: at_d[place] + length]):
            d = int(at_d[place])
            one.free[i: i + length] = False
            many.free[d: d + length] = False
            tiles.append((length, i, d))
    return tiles


def _parts(tokens: np.ndarray, before: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of each row that lie in windows from ``at``, and how many are left of each row.

    What lies between shrinks to its first token, which is replaced by a value found nowhere.
    """
    keep = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(keep, at, 1)
    np.add.at(keep, at + least, -1)
    keep = np.cumsum(keep)[:-1] > 0
    left = np.concatenate([[True], keep[:-1]])
    left[before[:-1][before[:-1] < len(tokens)]] = True
    gap = ~keep & left
    out = tokens.copy()
    out[gap] = np.arange(int(gap.sum()), dtype=np.uint64)
    some = keep | gap
    return out[some], np.diff(np.concatenate([[0], np.cumsum(some)])[before])


def _suspect(least: int, flags):
    """Column function: the seeds of a text that ``flags`` lets through, and the tokens under them."""

    @F.arrow_udf("struct<seeds: array<bigint>, near: array<bigint>>")
    def run(column: pa.Array) -> pa.Array:
        none = np.zeros(0, np.int64)
        seeds, near, sizes = [], [none], [np.zeros(1, np.int64)]
        for _, before, hashes in _tokens(column):
            at = windows(before, least)
            found = window_hashes(hashes, at, least)
            some = bitsets.hit(flags.value, found)
            at, found = at[some], found[some]
            row = np.searchsorted(before, at, side="right") - 1
            cut = np.searchsorted(row, np.arange(len(before)))
            hit = np.diff(cut) > 0
            seeds += [np.unique(found[a:b]).view(np.int64) if b > a else none for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            parts, left = _parts(hashes, before, at, least)
            near.append(parts[np.repeat(hit, left)].view(np.int64))
            sizes.append(np.where(hit, left, 0))
        offsets = [np.cumsum([0, *map(len, seeds)]), np.cumsum(np.concatenate(sizes))]
        values = [np.concatenate([none, *seeds]), np.concatenate(near)]
        lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v)) for o, v in zip(offsets, values)]
        return pa.StructArray.from_arrays(lists, ["seeds", "near"])

    return run.asNondeterministic()  # else a filter on the seeds would look for them twice


def _array(value) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False)


def _near(doc: np.ndarray, item: np.ndarray, least: int) -> np.ndarray:
    """The parts of a document that hold seeds of the item, each cut off by a token found nowhere."""
    row = np.array([0, len(doc)])
    at = windows(row, least)
    some = np.isin(window_hashes(doc, at, least), window_hashes(item, windows(np.array([0, len(item)]), least), least))
    return _parts(doc, row, at[some], least)[0]


def rare_seeds(tokens: np.ndarray, seeds: np.ndarray, counts: np.ndarray, least: int, coverage: float) -> np.ndarray:
    """The seeds of an item one of which every document shares that covers it to ``coverage``.

    The most frequent seeds that together cover less of the item are left out: a document that shares
    only those cannot reach the coverage, since a tile lies under shared seeds. ``seeds`` are those that
    occur in documents at all, ``counts`` their numbers of documents.
    """
    order = np.lexsort((seeds, -counts))
    rank = np.empty(len(seeds), np.int64)
    rank[order] = np.arange(len(seeds))
    own = window_hashes(tokens, np.arange(max(0, len(tokens) - least + 1)), least)
    ascending = np.argsort(seeds)
    place = np.searchsorted(seeds[ascending], own)
    known = place < len(seeds)
    known[known] = seeds[ascending][place[known]] == own[known]
    when = np.full(len(own), len(seeds))
    when[known] = rank[ascending[place[known]]]
    covered_by = np.full(len(tokens), len(seeds))  # rank of the seed that first covers a token
    for j in range(least):
        part = covered_by[j: j + len(when)]
        np.minimum(part, when, out=part)
    covered = np.searchsorted(np.sort(covered_by), np.arange(len(seeds) + 1))
    left_out = max(0, int((covered / len(tokens) < coverage).sum()) - 1)
    return seeds[order[left_out:]]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    least: int = LEAST, coverage: float = COVERAGE,
) -> DataFrame:
    """Pairs of a document and a test item whose tokens the document covers to ``coverage`` or more.

    Columns: ``key``, ``tk`` (hash of the text), ``item``, ``n_tokens`` of the item, ``covered``
    tokens, ``coverage``, ``n_tiles``, ``longest`` tile. Each different pair comes once, however
    often its rows are repeated; null keys are kept. Null and empty texts, and items of fewer than
    ``least`` tokens, match nothing. Benchmarks of any size: only bit sets of their seeds, of
    bounded size, travel to the tasks.

    A pair is formed only on the item's rarest seeds, one of which a document must share to reach
    ``coverage`` (``rare_seeds``): phrases common to many items and documents pair nothing. Of a
    document only the tokens under seeds are kept.
    """
    spark = docs.sparkSession
    items = written(
        benchmark.select(F.col(item).alias("item"), F.col(text).alias("text"))
        .select("item", F.xxhash64("text").alias("ik"), token_hashes(F.col("text")).alias("item_tokens"), _seeds(least)(F.col("text")).alias("seeds"))
        .where(F.size("seeds") > 0).dropDuplicates(["item", "ik"]),
        "benchmark-items",
    )
    seeds = items.select("item", "ik", F.explode("seeds").alias("seed"))
    flags = spark.sparkContext.broadcast(bitsets.build(seeds, "seed", seeds.count()))
    suspects = written(
        docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
        .withColumn("found", _suspect(least, flags)(F.col("text"))).where(F.size("found.seeds") > 0)
        .select("id", F.xxhash64("text").alias("tk"), "found.seeds", F.col("found.near").alias("doc_tokens")),
        "suspects",
    )
    hits = suspects.select("id", "tk", F.explode("seeds").alias("seed"))

    @F.arrow_udf("array<bigint>")
    def rare(item_tokens: pa.Array, seeds: pa.Array, counts: pa.Array) -> pa.Array:
        found = [
            rare_seeds(_array(t).view(np.uint64), _array(s).view(np.uint64), _array(c), least, coverage).view(np.int64)
            for t, s, c in zip(item_tokens, seeds, counts)
        ]
        return pa.array(found, pa.list_(pa.int64()))

    counted = (
        seeds.join(hits.groupBy("seed").agg(F.count(F.lit(1)).alias("n")), "seed")
        .groupBy("item", "ik").agg(F.sort_array(F.collect_list(F.struct("seed", "n"))).alias("known"))
        .select(F.col("item").alias("k_item"), F.col("ik").alias("k_ik"), "known")
    )
    anchors = written(
        items.join(counted, F.col("item").eqNullSafe(F.col("k_item")) & (F.col("ik") == F.col("k_ik")))
        .select("item", "ik", F.explode(rare(F.col("item_tokens"), F.col("known.seed"), F.col("known.n"))).alias("seed")),
        "anchors",
    )
    listed = spark.sparkContext.broadcast(bitsets.build(anchors, "seed", anchors.count()))
    pairs = written(hits.where(bitsets.member(listed, F.col("seed"))).join(anchors, "seed").select("id", "tk", "item", "ik").distinct(), "pairs")
    tasks = min(MOST_TASKS, 1 + pairs.count() // PAIRS_PER_TASK)  # by pairs, since their bytes do not tell the work
    tokens = suspects.select(F.col("id").alias("d_id"), F.col("tk").alias("d_tk"), "doc_tokens").dropDuplicates(["d_id", "d_tk"])
    item_tokens = items.select(F.col("item").alias("i_item"), F.col("ik").alias("i_ik"), "item_tokens")
    joined = (
        pairs.join(tokens, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("tk") == F.col("d_tk")))
        .join(item_tokens, F.col("item").eqNullSafe(F.col("i_item")) & (F.col("ik") == F.col("i_ik")))
        .select("id", "tk", "item", "doc_tokens", "item_tokens").repartition(tasks, "id", "tk", "item")
    )
    fields = "n_tokens: bigint, covered: bigint, n_tiles: bigint, longest: bigint"

    @F.arrow_udf(f"struct<{fields}>")
    def tiled(doc_tokens: pa.Array, item_tokens: pa.Array) -> pa.Array:
        rows = []
        for d, i in zip(doc_tokens, item_tokens):
            one, many = _array(i).view(np.uint64), _array(d).view(np.uint64)
            tiles = tile(one, _near(many, one, least), least)
            rows.append((len(one), sum(t[0] for t in tiles), len(tiles), max((t[0] for t in tiles), default=0)))
        names = ["n_tokens", "covered", "n_tiles", "longest"]
        return pa.StructArray.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names)

    return (
        joined.select("id", "tk", "item", tiled("doc_tokens", "item_tokens").alias("t"))
        .select(F.col("id").alias(key), "tk", F.col("item"), "t.n_tokens", "t.covered", (F.col("t.covered") / F.col("t.n_tokens")).alias("coverage"), "t.n_tiles", "t.longest")
        .where(F.col("coverage") >= coverage).withColumnRenamed("item", item)
    )
