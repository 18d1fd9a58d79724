"""Transcript parsing: roles by a hidden Markov model, then canonical chat turns.

A transcript is lines of text in order. Each line shows a speaker marker or none and a shape (blank,
question, long, other). Hidden states are the first and the further lines of each role's turns; the
Viterbi path gives every line its role, so turns without a marker, and lines that only look like a
marker, are settled by what stands around them.

A transcript may be of any length. It is cut into blocks; a block is summed up as the best score from
each state before it to each state at its end, these tables multiply in the max-plus sense, and a
tree over blocks finds the state at each border. Then all blocks are decoded at once. The path is that
of a single pass; equal scores go to the state listed first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.sources.tables import written

ROLES = ("system", "user", "assistant")
#: Places in a block, and blocks in a node of the tree.
BLOCK = 64
FAN = 256

# Names that mark a speaker
NAMES = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q"),
    "assistant": ("assistant", "ai", "bot", "model", "answer", "a"),
}
SHAPES = ("blank", "question", "long", "other")
LONG = 200

N = 2 * len(ROLES)  # states: first and further lines of each role
START = N


def marker(names: tuple[str, ...]) -> str:
    return r"(?i)^\s*(?:#{1,6}\s*|\*\*|<\|)?(?:" + "|".join(names) + r")\s*(?:(?:\*\*)?\s*:(?:\*\*)?|\|>)\s*"


def model() -> tuple[np.ndarray, np.ndarray]:
    """Log scores: transitions from each state or the start, and emissions of marker and shape."""
    move = np.full((N + 1, N), 1e-6)
    first = {r: 2 * i for i, r in enumerate(ROLES)}
    follow = {"system": {"user": 0.9, "assistant": 0.1}, "user": {"assistant": 0.97, "user": 0.03}, "assistant": {"user": 0.95, "assistant": 0.05}}
    for role, at in first.items():
        for state in (at, at + 1):
            move[state, at + 1] = 0.55
            for other, p in follow[role].items():
                move[state, first[other]] = 0.45 * p
    move[START] = 1e-9
    move[START, [first["system"], first["user"], first["assistant"]]] = 0.2, 0.7, 0.1
    shape = {"system": (0.05, 0.02, 0.30, 0.63), "user": (0.05, 0.30, 0.15, 0.50), "assistant": (0.08, 0.07, 0.35, 0.50)}
    emit = np.zeros((N, len(ROLES) + 1, len(SHAPES)))
    for i, role in enumerate(ROLES):
        for further in (0, 1):
            mark = np.full(len(ROLES) + 1, 0.01)
            if not further:
                mark[i] = 0.90
            mark[-1] = 1 - mark[:-1].sum()
            emit[2 * i + further] = mark[:, None] * np.array(shape[role])[None, :]
    return np.log(move), np.log(emit.reshape(N, -1))


def observation(line: Column) -> Column:
    """Number of the line's marker and shape."""
    mark = F.lit(len(ROLES))
    for i, role in reversed(list(enumerate(ROLES))):
        mark = F.when(line.rlike(marker(NAMES[role])), i).otherwise(mark)
    shape = F.when(line.rlike(r"^\s*$"), 0).when(line.rlike(r"\?\s*$"), 1).when(F.length(line) > LONG, 2).otherwise(3)
    return (mark * len(SHAPES) + shape).cast("int")


def table_of(seen: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Best score from each state before these lines (or the start) to each state at the last one."""
    best = move + emit[:, seen[0]]
    for o in seen[1:].tolist():
        best = (best[:, :, None] + move[None, :N, :]).max(1) + emit[:, o]
    return best


def decode(seen: np.ndarray, entry: int, last: int, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """States of these lines on the best path from ``entry`` to ``last``."""
    best = move[entry] + emit[:, seen[0]]
    back = []
    for o in seen[1:].tolist():
        ways = best[:, None] + move[:N]
        back.append(ways.argmax(0))
        best = ways.max(0) + emit[:, o]
    path = [last]
    for way in reversed(back):
        path.append(int(way[path[-1]]))
    return np.array(path[::-1], np.int32)


def borders(tables: np.ndarray, entry: int, last: int | None) -> list[int]:
    """State at the end of each of some successive tables."""
    best, back = tables[0][entry], []
    for t in tables[1:]:
        ways = best[:, None] + t[:N]
        back.append(ways.argmax(0))
        best = ways.max(0)
    path = [int(best.argmax()) if last is None else last]
    for way in reversed(back):
        path.append(int(way[path[-1]]))
    return path[::-1]


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first ``keys`` columns of sorted batches."""
    held: list[pa.Table] = []
    name = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        values = list(zip(*(batch.column(i).to_pylist() for i in range(keys))))
        cut = 0
        for i, value in enumerate(values):
            if value != name:
                if held or i > cut:
                    yield pa.concat_tables([*held, table.slice(cut, i - cut)])
                held, cut, name = [], i, value
        if cut < len(values):
            held.append(table.slice(cut))
    if held:
        yield pa.concat_tables(held)


def _dealt(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*by).sortWithinPartitions(*by, *order)


def _solve(blocks: DataFrame) -> DataFrame:
    """``c``, ``b``, ``entry`` and ``last`` state for the blocks ``c``, ``b``, ``t`` (table) of all transcripts."""

    def fold(batches):
        for group in _grouped(batches, 2):
            tables = np.array(group["t"].to_pylist()).reshape(-1, N + 1, N)
            best = tables[0]
            for t in tables[1:]:
                best = (best[:, :, None] + t[None, :N, :]).max(1)
            yield pa.record_batch([group["c"].combine_chunks().slice(0, 1), group["g"].combine_chunks().slice(0, 1), pa.array([best.ravel().tolist()])], names=["c", "b", "t"])

    def place(batches):
        for group in _grouped(batches, 2):
            entry, last = group["entry"][0].as_py(), group["last"][0].as_py()
            ends = borders(np.array(group["t"].to_pylist()).reshape(-1, N + 1, N), entry, last)
            yield pa.record_batch(
                [group["c"].combine_chunks(), group["b"].combine_chunks(), pa.array([entry, *ends[:-1]], pa.int32()), pa.array(ends, pa.int32())],
                names=["c", "b", "entry", "last"],
            )

    def most(df: DataFrame) -> int:
        return df.groupBy("c").count().agg(F.max("count").alias("n")).first()["n"] or 0

    levels = [blocks]
    while most(levels[-1]) > FAN:
        up = levels[-1].select("c", F.floor(F.col("b") / FAN).cast("bigint").alias("g"), "b", "t")
        levels.append(written(_dealt(up, ["c", "g"], ["b"]).mapInArrow(fold, "c string, b bigint, t array<double>"), "folded"))
    solved = None
    for level in reversed(levels):
        if solved is None:
            ready = level.select("c", F.lit(0).cast("bigint").alias("g"), "b", "t", F.lit(START).alias("entry"), F.lit(None).cast("int").alias("last"))
        else:
            above = solved.select(F.col("c").alias("uc"), F.col("b").alias("g"), "entry", "last")
            ready = level.join(above, (F.col("c") == F.col("uc")) & (F.floor(F.col("b") / FAN) == F.col("g"))).select("c", "g", "b", "t", "entry", "last")
        solved = _dealt(ready, ["c", "g"], ["b"]).mapInArrow(place, "c string, b bigint, entry int, last int")
    return solved


def parse(pieces: DataFrame, key: str = "conv_id", place: str = "turn", text: str = "text") -> DataFrame:
    """Roles and canonical text of transcript pieces (one or more lines each), in order of ``place``.

    Returns ``key``, ``place``, ``role`` of the piece's first line, ``n_lines``, ``n_turns`` begun in
    the piece, ``rendered`` and ``copies``. In ``rendered`` each turn begins with a line ``<|role|>``,
    and markers are taken out; joined by line breaks in order, the pieces are the canonical chat.

    Repeated rows (equal key, place and text) are one piece with their number in ``copies``. Pieces of
    one place go by the hash of their text, a null place first; rows with a null key are transcripts
    of their own; a null text is an empty line.
    """
    id_, at, value = F.col(key), F.col(place).cast("bigint"), F.coalesce(F.col(text), F.lit(""))
    rows = (
        pieces.groupBy(id_.alias("id"), at.alias("place"), value.alias("text")).agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("h", F.xxhash64("text"))
        .withColumn("c", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("\x00"), F.xxhash64("place", "text").cast("string"))))
        .withColumn("b", F.floor(F.coalesce("place", F.lit(0).cast("bigint")) / BLOCK).cast("bigint"))
        .withColumn("lines", F.split("text", r"\r?\n", -1))
        .withColumn("seen", F.transform("lines", observation))
    )
    rows = written(rows.select("c", "b", "place", "h", "id", "lines", "seen", "copies"), "pieces")
    move, emit = model()

    def tables(batches):
        for group in _grouped(batches, 2):
            seen = np.concatenate(group["seen"].combine_chunks().to_numpy(zero_copy_only=False))
            table = table_of(seen, move, emit)
            yield pa.record_batch([group["c"].combine_chunks().slice(0, 1), group["b"].combine_chunks().slice(0, 1), pa.array([table.ravel().tolist()])], names=["c", "b", "t"])

    def states(batches):
        for group in _grouped(batches, 2):
            seen = group["seen"].combine_chunks()
            sizes = np.array([len(x) for x in seen])
            path = decode(np.concatenate(seen.to_numpy(zero_copy_only=False)), group["entry"][0].as_py(), group["last"][0].as_py(), move, emit)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(path))
            yield pa.record_batch([group[n].combine_chunks() for n in ("id", "place", "lines", "copies")] + [found], names=["id", "place", "lines", "copies", "states"])

    blocks = written(_dealt(rows.select("c", "b", "place", "h", "seen"), ["c", "b"], ["place", "h"]).mapInArrow(tables, "c string, b bigint, t array<double>"), "blocks")
    solved = _solve(blocks).select(F.col("c").alias("sc"), F.col("b").alias("sb"), "entry", "last")
    joined = rows.join(solved, (F.col("c") == F.col("sc")) & (F.col("b") == F.col("sb"))).select("c", "b", "place", "h", "id", "lines", "seen", "copies", "entry", "last")
    kind = pieces.schema[key].dataType.simpleString()
    found = _dealt(joined, ["c", "b"], ["place", "h"]).mapInArrow(
        states, f"id {kind}, place bigint, lines array<string>, copies bigint, states array<int>"
    )
    names = F.array(*[F.lit(r) for r in ROLES])

    def role(state: Column) -> Column:
        return F.get(names, F.floor(state / 2).cast("int"))

    any_marker = "|".join(f"(?:{marker(NAMES[r])[4:]})" for r in ROLES)
    shown = F.zip_with(
        "lines", "states",
        lambda line, s: F.when(s % 2 == 0, F.concat(F.lit("<|"), role(s), F.lit("|>\n"), F.regexp_replace(line, "(?i)" + any_marker, ""))).otherwise(line),
    )
    return found.select(
        F.col("id").alias(key), F.col("place").alias(place), role(F.get("states", F.lit(0))).alias("role"),
        F.size("lines").cast("bigint").alias("n_lines"), F.size(F.filter("states", lambda s: s % 2 == 0)).cast("bigint").alias("n_turns"),
        F.array_join(shown, "\n").alias("rendered"), "copies",
    )
