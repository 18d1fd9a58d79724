"""Exact repeats of long word sequences, found by fixed-block anchors.

Each document is cut into non-overlapping reference blocks of half the window length. A window that
stands in two documents contains a whole reference block of either, so probing the block index with
every rolling window of block length tells which blocks are shared. Places of hits are not extended
word by word: all windows of shared blocks are matched over the corpus by 96 bits of hash, without
comparing words, and the union of matching windows is the maximal repeat.

Nothing is paired: all occurrences of a window meet through its smallest document only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registra.llm import bitsets
from registra.llm.words import slices, spans, window_hashes, windows, word_hashes
from registra.sources.tables import discard, written

ROW = "id bigint, tk bigint"
#: Candidate windows that a task settles among themselves before it sends them on.
HELD_WINDOWS = 1 << 16


def _hashed(column: pa.Array, block: int):
    """Row offset, word boundaries by row, block-window starts and their hashes, for each slice."""
    for first, last, data, offsets in slices(column):
        starts, ends, before = spans(data, offsets)
        at = windows(before, block)
        yield first, before, at, window_hashes(word_hashes(data, starts, ends), at, block)


def _row_of(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.searchsorted(before, words, side="right") - 1


def _blocks(texts: DataFrame, block: int) -> DataFrame:
    """Hashes of all reference blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, before, at, hashes in _hashed(batch.column(2), block):
                whole = (at - before[_row_of(before, at)]) % block == 0
                yield pa.record_batch([pa.array(hashes[whole].view(np.int64))], names=["h"])

    return texts.mapInArrow(run, "h bigint")


def _probes(texts: DataFrame, block: int, flags) -> DataFrame:
    """Every rolling window that may equal a reference block: its hash, document, and if it is a block itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, before, at, hashes in _hashed(batch.column(2), block):
                some = np.flatnonzero(bitsets.hit(flags.value, hashes))
                row = _row_of(before, at[some])
                whole = (at[some] - before[row]) % block == 0
                yield pa.record_batch(
                    [pa.array(hashes[some].view(np.int64)), pa.array(ids[first + row]), pa.array(whole)], names=["h", "id", "whole"]
                )

    return texts.mapInArrow(run, "h bigint, id bigint, whole boolean")


def _candidates(texts: DataFrame, block: int, flags) -> DataFrame:
    """Windows of two blocks all of whose reference blocks are repeated.

    Rows with ``k`` are windows to be matched over the corpus: ``k`` holds the hash of the first half,
    ``at`` the upper bits of that of the second half and the window's place. Where the windows a task holds have a
    window in several documents, only the smallest goes on; for the others the answer is already known, and
    they come as ranges of words, from ``at`` to ``stop``, without ``k``. So a window of a third of all documents sends one
    row per ``HELD_WINDOWS`` candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, rows = [], 0, 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for first, before, at, hashes in _hashed(batch.column(2), block):
                if not len(at):
                    continue
                row = _row_of(before, at)
                place = at - before[row]
                shared = np.zeros(len(at), bool)
                whole = np.flatnonzero(place % block == 0)
                shared[whole] = bitsets.hit(flags.value, hashes[whole])
                # a repeated window holds one or two reference blocks of its own document, each of them shared
                index = np.flatnonzero(np.diff(before)[row] - place >= 2 * block)
                ahead = -place[index] % block
                index = index[shared[index + ahead] & shared[index + np.where(ahead == 0, block, ahead)]]
                of = first + row[index]
                parts.append((rows + of, ids[of], keys[of], place[index], hashes[index], hashes[index + block]))
                held += len(index)
                if held >= HELD_WINDOWS:
                    yield _settle(parts, 2 * block)
                    parts, held = [], 0
            rows += batch.num_rows
        if held:
            yield _settle(parts, 2 * block)

    return texts.mapInArrow(run, f"{ROW}, k bigint, at bigint, stop bigint")


def _settle(parts, length: int) -> pa.RecordBatch:
    columns = [np.concatenate(x) for x in zip(*parts)]
    order = np.lexsort((columns[1], columns[5], columns[4]))
    row, ids, keys, place, h1, h2 = (c[order] for c in columns)
    new = np.ones(len(row), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    later = np.flatnonzero(ids > ids[new][np.cumsum(new) - 1])
    on = np.ones(len(row), bool)
    on[later] = False
    on = np.flatnonzero(on)
    on = on[np.lexsort((place[on], row[on]))]
    head, stop = _ranges(row[later], place[later], length)
    head = later[head]
    none = pa.nulls(len(head), pa.int64())
    columns = [
        [pa.array(ids[head]), pa.array(ids[on])],
        [pa.array(keys[head]), pa.array(keys[on])],
        [none, pa.array(h1[on].view(np.int64))],
        [pa.array(place[head]), pa.array((h2[on] >> np.uint64(32) << np.uint64(32) | place[on].astype(np.uint64)).view(np.int64))],
        [pa.array(stop), pa.nulls(len(on), pa.int64())],
    ]
    return pa.record_batch([pa.concat_arrays(c) for c in columns], names=["id", "tk", "k", "at", "stop"])


def _ranges(row: np.ndarray, place: np.ndarray, length: int):
    """Merge windows into ranges; gives the index of each range's first window (in the input) and its end."""
    order = np.lexsort((place, row))
    r, p = row[order], place[order]
    if not len(r):
        return order, p
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (p[1:] > p[:-1] + length)
    heads = np.flatnonzero(new)
    tails = np.r_[heads[1:], len(r)] - 1
    return order[heads], p[tails] + length


def _cut(texts: pa.Array, ranges: pa.Array | None) -> pa.Array:
    """Structs of the number of words, the number removed, and the kept words joined by one space."""
    n_words, n_removed, kept = [], [], []
    ranges = iter(ranges) if ranges is not None else repeat(None)
    for text, gone in zip(texts, ranges):
        text, gone = text.as_py(), gone.as_py() if gone is not None else None
        words = (text or "").encode().split()
        n_words.append(len(words))
        if gone:
            flags = np.zeros(len(words) + 1, np.int64)
            pairs = np.array([(g["start"], g["stop"]) for g in gone])
            np.add.at(flags, pairs[:, 0], 1)
            np.add.at(flags, pairs[:, 1], -1)
            stay = np.cumsum(flags)[:-1] == 0
            n_removed.append(int(len(words) - stay.sum()))
            words = [w for w, s in zip(words, stay.tolist()) if s]
        else:
            n_removed.append(0)
        kept.append(b" ".join(words).decode())
    return pa.StructArray.from_arrays(
        [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
        ["n_words", "n_removed", "kept"],
    )


CUT = T.StructType().add("n_words", "long").add("n_removed", "long").add("kept", "string")


@F.arrow_udf(CUT)
def _whole(texts: pa.Array) -> pa.Array:
    return _cut(texts, None)


@F.arrow_udf(CUT)
def _shortened(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    return _cut(texts, ranges)


def _whole_unless(flags):
    """Column function: ``_whole`` of the rows whose hash is not listed, null for the others."""

    @F.arrow_udf(CUT)
    def run(texts: pa.Array, hashes: pa.Array) -> pa.Array:
        listed = pa.array(bitsets.hit(flags.value, hashes.to_numpy(zero_copy_only=False).view(np.uint64)))
        return pc.if_else(listed, None, _cut(pc.if_else(listed, None, texts), None))

    return run.asNondeterministic()  # else the filter on its result would work it out twice


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame | None:
    """Word ranges to remove: ``id``, ``tk`` (hash of the text), ``ranges`` (array of start and stop).

    A word goes if a window of ``window`` words over it also stands in a row with a smaller key; all
    occurrences count, and windows are judged on the input. Rows without a key neither lose words
    nor make others lose them; rows of equal key do not count against each other. None: no repeats.
    ``window`` must be even.
    """
    if window % 2:
        raise ValueError("the window must have an even number of words")
    block, spark = window // 2, docs.sparkSession
    texts = docs.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"), F.xxhash64(text).alias("tk"), F.col(text).alias("text")
    )
    blocks = written(_blocks(texts, block), "blocks")
    count = blocks.count()
    if not count:
        return None
    index = spark.sparkContext.broadcast(bitsets.build(blocks, "h", count))
    discard(blocks)
    shared = written(
        _probes(texts, block, index).groupBy("h")
        .agg(F.min("id").alias("a"), F.max("id").alias("b"), F.max("whole").alias("whole"))
        .where("a < b and whole").select("h"),
        "shared-blocks",
    )
    count = shared.count()
    if not count:
        return None
    index = spark.sparkContext.broadcast(bitsets.build(shared, "h", count))
    discard(shared)
    found = _candidates(texts, block, index)
    # of the windows a task holds at a time only those of one document get here, so no window's group is large
    dealt = found.where("k is not null").select("k", "at", "id", "tk").repartition("k")
    same = Window.partitionBy("k", "half")
    start = F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    later = (
        dealt.withColumn("half", F.shiftright("at", 32)).withColumn("first", F.min("id").over(same))
        .where("id > first").select("id", "tk", start.alias("start"), (start + window).alias("stop"))
    )
    known = found.where("k is null").select("id", "tk", F.col("at").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))
    gone = known.union(later)
    # repeated rows give the same ranges: each is kept once, so an array is bounded by one text
    ranges = written(gone.groupBy("id", "tk").agg(F.collect_set(F.struct("start", "stop")).alias("ranges")), "ranges")
    return ranges


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """The rows of ``docs`` with ``__cut``: number of words, number removed, kept words joined by one space.

    See ``repeats`` for what is removed. Null and blank texts have no words and keep the empty text.
    Only texts that lose words are shuffled.
    """
    gone = repeats(docs, key, text, window)
    if gone is None:
        return docs.withColumn("__cut", _whole(F.col(text)))
    flags = bitsets.named(gone)
    row = bitsets.row_hash(key, text)
    plain = docs.withColumn("__cut", _whole_unless(flags)(F.col(text), row)).where("__cut is not null")
    listed = docs.where(bitsets.member(flags, row)).withColumn("__tk", F.xxhash64(text))
    cut = bitsets.match(listed, gone.withColumnRenamed("ranges", "__ranges"), key, "left")
    return plain.union(cut.withColumn("__cut", _shortened(F.col(text), F.col("__ranges"))).select(*docs.columns, "__cut"))
