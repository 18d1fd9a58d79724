"""Harmonic packing of tokenized documents into sequences of fixed capacity.

Class ``k`` holds the lengths from above ``capacity / (k + 1)`` to ``capacity / k``, and a sequence of
the class takes ``k`` pieces, whatever their order. Documents may be cut, so each is cut where classes end:
whole sequences first, then again and again the greatest class end that fits what is left.
All pieces of a class then have one length, ``k`` of them fill a sequence but for fewer than ``k`` tokens, and
a document is cut into about three pieces besides its whole sequences.

Tasks cut and number their pieces of each class on their own. The numbers of pieces that the tasks
before have in a class say where a task's pieces go on, so no piece is shuffled to be packed and a class leaves
at most one sequence unfilled, not one per task. The pieces of those, fewer than a sequence of each class
whatever the input, are put together first fit, longest first.

Null texts are empty; an empty text is its closing identifier. Rows of equal or null key are packed
each on its own. An empty table gives no pieces.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registra.llm.words import slices
from registra.sources.tables import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
CAPACITY = 1024
#: Identifier that closes every document.
CLOSING = 0
#: Bytes of text whose words are looked up together.
READ_AT_ONCE = 1 << 21
#: Words whose identifiers a task remembers, and the longest.
REMEMBERED, MEMORABLE = 1 << 19, 24
#: Words that are encoded in one call.
ENCODED_AT_ONCE = 1 << 12
#: Bytes of identifiers that a task gives out at a time.
GIVEN_AT_ONCE = 1 << 21


def class_end(length: int, capacity: int) -> int:
    """The greatest length up to ``length`` that ends a class."""
    return capacity // (capacity // (length + 1) + 1)


def rest_lengths(capacity: int) -> list[list[int]]:
    """How what is left after whole sequences is cut, for each length below the capacity."""
    cuts: list[list[int]] = [[]]
    for length in range(1, capacity):
        end = class_end(length, capacity)
        cuts.append([end, *cuts[length - end]])
    return cuts


_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
# without those of the special token, which must stay whole
_MARK = np.array([0x21 <= b < 0x7F and not chr(b).isalnum() and chr(b) not in "<|>" for b in range(256)])
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def part_starts(data: np.ndarray) -> np.ndarray:
    """Places of a text's bytes before which it may be cut: its parts are encoded alike apart and together.

    The tokenizer starts anew at white space after another character, at a mark after a letter, and at
    a letter after a single line break. For characters other than white space only ASCII and those of two
    bytes from U+00C0 on are taken, so nothing is cut after others.
    """
    cut = np.zeros(len(data), bool)
    plain = (data > 0x20) & (data < 0x7F)
    plain[1:] |= (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
    cut[1:] = (_SPACE[data[1:]] & plain[:-1]) | (_MARK[data[1:]] & _LETTER[data[:-1]])
    cut[2:] |= _LETTER[data[2:]] & (data[1:-1] == 0x0A) & plain[:-2]
    return np.flatnonzero(cut)


def _sections(column) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Bytes, row boundaries and whether the last row ends here, of slices; a longer text comes in several."""
    for first, last, data, offsets in slices(column, READ_AT_ONCE):
        start = 0
        while last - first == 1 and len(data) - start > READ_AT_ONCE:
            size = READ_AT_ONCE
            while not len(at := part_starts(data[start: start + size])) and start + size < len(data):
                size *= 2
            if not len(at):
                break
            stop = start + int(at[-1])
            yield data[start:stop], np.array([0, stop - start]), False
            start = stop
        yield data[start:], offsets if last - first > 1 else np.array([0, len(data) - start]), True


class _Encoder:
    """Identifiers of texts; every distinct part of a slice is encoded once, and short parts are remembered."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.special_id, special = next(iter(self.tokenizer.get_added_tokens_decoder().items()))
        self.special = special.content
        self.known: dict[str, bytes] = {}

    def _encode(self, parts: list[str]) -> list[bytes]:
        """Identifiers of each part; the vocabulary's special token between them keeps them apart."""
        if self.special in "".join(parts):
            return [array("I", self.tokenizer.encode(p, add_special_tokens=False).ids).tobytes() for p in parts]
        coded = self.tokenizer.encode_batch_fast([self.special.join(parts)], add_special_tokens=False)[0]
        ids = array("I", coded.ids)
        at = np.flatnonzero(np.frombuffer(ids, np.uint32) == self.special_id).tolist()
        blob = ids.tobytes()
        return [blob[4 * i: 4 * j] for i, j in zip([0, *(x + 1 for x in at)], [*at, len(ids)])]

    def _parts(self, parts: list[str]) -> list[bytes]:
        found = list(map(self.known.get, parts))
        new = [i for i, x in enumerate(found) if x is None]
        for start in range(0, len(new), ENCODED_AT_ONCE):
            some = new[start: start + ENCODED_AT_ONCE]
            for i, blob in zip(some, self._encode([parts[i] for i in some])):
                found[i] = blob
        if len(self.known) > REMEMBERED:
            self.known.clear()
            new = range(len(parts))
        self.known.update((parts[i], found[i]) for i in new if len(parts[i]) <= MEMORABLE)
        return found

    def rows(self, column) -> Iterator[np.ndarray]:
        """Identifiers of every text of a column; null is empty."""
        held: list[np.ndarray] = []  # of a text whose last section is still to come
        for data, offsets, ends in _sections(column):
            cut = np.zeros(len(data), bool)
            cut[part_starts(data)] = True
            cut[offsets[:-1][np.diff(offsets) > 0]] = True
            starts = np.flatnonzero(cut)
            bounds = np.append(starts, len(data)).astype(np.int32)
            parts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
            coded = parts.dictionary_encode()
            which = coded.indices.to_numpy()
            blobs = self._parts(coded.dictionary.to_pylist())
            sizes = np.fromiter(map(len, blobs), np.int32, len(blobs)) // 4
            flat = np.frombuffer(b"".join(blobs), "<u4")
            size = sizes[which]
            before = np.zeros(len(size) + 1, np.int32)  # a section has fewer bytes, and so identifiers, than fit
            np.cumsum(size, out=before[1:])
            first = np.cumsum(sizes, dtype=np.int32) - sizes
            at = np.repeat(first[which] - before[:-1], size)
            at += np.arange(before[-1], dtype=np.int32)
            ids = flat[at]
            cuts = before[np.searchsorted(starts, offsets)]
            for i in range(len(offsets) - 1):
                held.append(ids[cuts[i]: cuts[i + 1]])
                if ends or i < len(offsets) - 2:
                    yield np.concatenate(held)
                    held.clear()


def cut(docs: DataFrame, key: str, text: str, vocabulary: str, capacity: int, closing: int) -> DataFrame:
    """Pieces of all documents.

    ``key``, ``start`` (identifiers of the document before the piece), ``length``, ``ids``
    (little-endian unsigned 32-bit), ``doc_tokens``, and the piece's task ``part`` and its number
    ``at`` among the task's pieces of that length.
    """
    with open(vocabulary, encoding="utf-8") as f:
        table = docs.sparkSession.sparkContext.broadcast(f.read())  # a fixed file, under 3 MB
    names = ["key", "start", "length", "ids", "doc_tokens", "part", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder = _Encoder(table.value)
        rests, used = rest_lengths(capacity), np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        rows, starts, lengths, totals, blobs, size = [], [], [], [], [], 0

        def give(keys: pa.Array) -> pa.RecordBatch:
            n = np.array(lengths, np.int64)
            at = np.empty(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            same, first, count = np.unique(n[order], return_index=True, return_counts=True)
            at[order] = np.arange(len(n)) - np.repeat(first - used[same], count)
            used[same] += count
            columns = [
                keys.take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(n), pa.array(blobs, pa.binary()),
                pa.array(totals, pa.int64()), pa.array(np.full(len(n), part, np.int64)), pa.array(at),
            ]
            for x in (rows, starts, lengths, totals, blobs):
                x.clear()
            return pa.record_batch(columns, names=names)

        for batch in batches:
            for row, ids in enumerate(encoder.rows(batch.column(1))):
                ids = np.append(ids, np.array([closing], "<u4"))
                start = 0
                whole, rest = divmod(len(ids), capacity)
                for length in [capacity] * whole + rests[rest]:
                    blobs.append(ids[start: start + length].tobytes())
                    rows.append(row)
                    starts.append(start)
                    lengths.append(length)
                    totals.append(len(ids))
                    start += length
                    size += 4 * length
                    if size >= GIVEN_AT_ONCE:
                        yield give(batch.column(0))
                        size = 0
            yield give(batch.column(0))
            size = 0

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, part bigint, at bigint"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def first_fit(left: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Places for ``left[length]`` pieces of each length, longest first: length, number, sequence and offset.

    Also the number of sequences. Fewer pieces of a length than fill a sequence come in, so there are as
    many at most as the harmonic sum over all lengths, about ``capacity * ln(capacity)``.
    """
    fill: list[int] = []
    places = []
    for length in sorted(left, reverse=True):
        at = 0  # sequences before are too full for this length
        for i in range(left[length]):
            while at < len(fill) and fill[at] + length > capacity:
                at += 1
            if at == len(fill):
                fill.append(0)
            places.append((length, i, at, fill[at]))
            fill[at] += length
    return places, len(fill)


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, closing: int = CLOSING,
    value: Column | None = None,
) -> DataFrame:
    """Pieces of all documents with their place: ``sequence_id`` (from 0, without gaps) and ``offset``.

    Besides ``key``, ``start``, ``length``, ``ids`` and ``doc_tokens`` as in :func:`cut`; ``value``, an expression
    over these, takes the place of ``ids`` where the identifiers themselves are not wanted and need not
    be written. Pieces stand in a sequence one after another from 0. Only the number of pieces of
    each length comes to the driver.
    """
    spark = docs.sparkSession
    pieces = cut(docs, key, text, vocabulary, capacity, closing)
    pieces = written(pieces if value is None else pieces.withColumn("ids", value), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), "n")
    counts = written(counts, "piece-counts")  # a row per task and class end; its size decides whether it is sent to the pieces
    totals = {r["l"]: r["n"] for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect()}  # as many as class ends

    bases, base, left = [], 0, {}
    for length in sorted(totals, reverse=True):
        full, left[length] = divmod(totals[length], capacity // length)
        bases.append((length, capacity // length, full, base))
        base += full
    places, _ = first_fit(left, capacity)
    bases = spark.createDataFrame(bases, "bl bigint, per bigint, full bigint, base bigint")
    places = spark.createDataFrame([(n, i, base + s, o) for n, i, s, o in places], "pl bigint, i bigint, s bigint, o bigint")

    number = F.col("before") + F.col("at")
    own = counts.select("p", "l", "before").join(F.broadcast(bases), F.col("l") == F.col("bl")).drop("bl")
    numbered = pieces.join(own, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l"))).withColumn("number", number)
    rest = F.col("number") - F.col("full") * F.col("per")
    placed = numbered.join(F.broadcast(places), (F.col("length") == F.col("pl")) & (rest == F.col("i")), "left")  # bounded by the capacity
    regular = F.col("base") + F.floor(F.col("number") / F.col("per")).cast("bigint")
    return placed.select(
        F.col("key").alias(key), "start", "length", "ids", "doc_tokens",
        F.coalesce("s", regular).alias("sequence_id"), F.coalesce("o", F.col("number") % F.col("per") * F.col("length")).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``ids`` (of its pieces in order, unpadded) and ``starts`` (offsets of the pieces)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence is bounded by the capacity
    listed = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return listed.select("sequence_id", joined.alias("ids"), F.transform("parts", lambda p: p["offset"]).alias("starts"))
