"""Phrase collocations by SON partitioning.

Documents are dealt to a fixed number of shards by a hash of their text. A phrase that occurs
``support`` times in a language occurs, in at least one shard, as large a share of that as the shard has of
the language's words. So each shard is mined completely at its proportionally lowered support, level
by level: words, then pairs of words frequent in the shard, then longer phrases all of whose
pairs are. What is frequent in any shard is a candidate, and one more pass counts all candidates
over all documents, by their text.

The number of shards is fixed, so the lowered support does not sink as the input grows; a shard is
mined by as many tasks as it has data, which add up their counts by a shuffle. While mining, phrases
go by 48 bits of hash, and languages by 13: chance equality only adds candidates. Sets of frequent phrases
reach the tasks as bit sets of bounded size, which let through more, never less.

Texts are lower-cased (A-Z) and split at the punctuation of ``BREAKS`` into pieces; words are
separated by blanks and tabs, and phrases stay within a piece. Null texts are empty, null
languages are ``und``. Long texts are read in sections. An empty table gives no phrases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registra.llm import bitsets
from registra.llm.words import LOWER, SLICE_BYTES, mix, slices, spans, window_hashes, word_hashes
from registra.operators.paging import top_k_per_group
from registra.sources.tables import discard, written

SUPPORT, LONGEST, KEPT, INSIDE = 100, 5, 2000, 100
SHARD_BITS = 3
LANGUAGE_BITS = 13
HASH_BITS = 64 - SHARD_BITS - LANGUAGE_BITS
BREAKS = ".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"
#: Words whose phrases are counted in a task before they go on.
HELD_WORDS = 1 << 19

_BREAK = np.isin(np.arange(256), [ord(c) for c in BREAKS])
_GAP = _BREAK | np.isin(np.arange(256), [0x20, 0x09])
_HASH = np.uint64((1 << HASH_BITS) - 1)


def _sections(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and row boundaries of slices; a text longer than a slice is cut between words."""
    for first, last, data, offsets in slices(column):
        if last - first > 1 or len(data) <= SLICE_BYTES:
            yield first, data, offsets
            continue
        start = 0
        while start < len(data):
            stop = min(start + SLICE_BYTES, len(data))
            while stop < len(data) and not _GAP[data[stop]]:
                gaps = np.flatnonzero(_GAP[data[stop: stop + SLICE_BYTES]])
                stop = min(stop + (int(gaps[0]) if len(gaps) else SLICE_BYTES), len(data))
            yield first, data[start:stop], np.array([0, stop - start])
            start = stop


class _Block:
    """Consecutive words of a batch: hashes, rows, words left in the piece, and their texts if wanted.

    Phrases are counted where they start; ``stop`` is the first word whose phrases the next block counts.
    """

    def __init__(self, hashes, piece, row, texts, stop):
        self.hashes, self.row, self.texts, self.stop = hashes, row, texts, stop
        last = np.append(np.flatnonzero(piece[1:] != piece[:-1]), len(piece) - 1)
        at = np.arange(len(piece))
        self.room = last[np.searchsorted(last, at)] - at + 1 if len(piece) else at

    def starts(self, k: int, stop: int | None = None) -> np.ndarray:
        return np.flatnonzero(self.room[:stop] >= k)

    def keys(self, at: np.ndarray, k: int, language: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Mining keys of the phrases of ``k`` words from ``at``: group of the row above, hash below."""
        row = self.row[at]
        value = mix(window_hashes(self.hashes, at, k) + language[row])
        return (value & _HASH) | (group[row] << np.uint64(HASH_BITS))


def _blocks(column, with_texts: bool) -> Iterator[_Block]:
    parts: list[tuple] = []
    held, breaks = 0, 0

    def block(more: bool) -> _Block:
        hashes, piece, row = (np.concatenate([p[i] for p in parts]) for i in range(3))
        texts = pa.concat_arrays([p[3] for p in parts]) if with_texts else None
        stop = max(len(hashes) - LONGEST + 1, 0) if more else len(hashes)
        parts[:] = [(hashes[stop:], piece[stop:], row[stop:], texts[stop:] if with_texts else None)]
        return _Block(hashes, piece, row, texts, stop)

    for first, data, offsets in _sections(column):
        low = LOWER[data]
        starts, ends, before = spans(low, offsets, _GAP)
        passed = np.cumsum(_BREAK[low])
        row = first + np.repeat(np.arange(len(offsets) - 1), np.diff(before))
        piece = breaks + passed[starts] + row  # rises at every break and every row
        breaks += int(passed[-1]) if len(passed) else 0
        texts = None
        if with_texts:
            bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
            texts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(low[~_GAP[low]]))
        parts.append((word_hashes(low, starts, ends), piece, row, texts))
        held += len(starts)
        if held >= HELD_WORDS:
            yield block(True)
            held = 0
    if parts:
        yield block(False)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _mined(texts: DataFrame, found: Callable[[_Block, np.ndarray, np.ndarray], list[np.ndarray]]) -> DataFrame:
    """Keys and counts, by shard, of the phrases that ``found`` gives for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language, group = _numbers(batch.column("language")), _numbers(batch.column("grp"))
            for block in _blocks(batch.column("text"), False):
                keys, counts = np.unique(np.concatenate(found(block, language, group)), return_counts=True)
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(counts)], names=["k", "n"])

    return texts.mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))


def _group_of(key: str) -> Column:
    return F.shiftrightunsigned(key, HASH_BITS)


def local_supports(words: DataFrame, support: int) -> DataFrame:
    """``g`` and ``least``: the support of each group (shard and language), by its share of the language's words.

    There are as many rows as group numbers at most, 65,536.
    """
    sizes = words.groupBy(_group_of("k").alias("g")).agg(F.sum("n").alias("n"))
    all_words = F.sum("n").over(Window.partitionBy(F.shiftright("g", SHARD_BITS)))
    share = F.lit(support).cast("decimal(18,0)") * F.col("n")
    return sizes.select("g", F.ceil(share / all_words).cast("bigint").alias("least"))


def _frequent(mined: DataFrame, supports: DataFrame, name: str) -> DataFrame:
    least = F.broadcast(supports)  # bounded, see local_supports
    return written(mined.join(least, _group_of("k") == F.col("g")).where("n >= least").select("k"), name)


def _flags(keys: DataFrame):
    return keys.sparkSession.sparkContext.broadcast(bitsets.build(keys, "k", keys.count()))


def _chain(block: _Block, fits: np.ndarray, k: int) -> np.ndarray:
    """Starts of phrases of ``k`` words whose parts all fit; ``fits`` says which starts of the shorter ones do."""
    width = k - 1
    at = block.starts(k)
    return at[fits[at] & fits[at + 1]] if width else at


def candidates(texts: DataFrame, support: int, longest: int) -> DataFrame:
    """Keys, without the shard, of all phrases that are frequent in some shard."""
    words = written(_mined(texts, lambda b, language, group: [b.keys(np.arange(b.stop), 1, language, group)]), "shard-words")
    supports = written(local_supports(words, support), "local-supports")
    frequent = [_frequent(words, supports, "frequent-words")]
    discard(words)
    known = _flags(frequent[0])

    def pairs(block: _Block, language, group) -> list[np.ndarray]:
        fits = bitsets.hit(known.value, block.keys(np.arange(len(block.hashes)), 1, language, group))
        at = _chain(block, fits, 2)
        return [block.keys(at[at < block.stop], 2, language, group)]

    frequent.append(_frequent(_mined(texts, pairs), supports, "frequent-pairs"))
    paired = _flags(frequent[1])

    def longer(block: _Block, language, group) -> list[np.ndarray]:
        fits, out = np.zeros(len(block.hashes), bool), [np.zeros(0, np.uint64)]
        at = block.starts(2)
        fits[at] = bitsets.hit(paired.value, block.keys(at, 2, language, group))
        for k in range(3, longest + 1):
            at = _chain(block, fits, k)
            fits = np.zeros(len(fits), bool)
            fits[at] = True
            out.append(block.keys(at[at < block.stop], k, language, group))
        return out

    frequent.append(_frequent(_mined(texts, longer), supports, "frequent-phrases"))
    shardless = F.col("k").bitwiseAND(F.lit(~(((1 << SHARD_BITS) - 1) << HASH_BITS)))
    union = frequent[0].union(frequent[1]).union(frequent[2]).select(shardless.alias("k")).distinct()
    union = written(union, "candidates")
    discard(supports, *frequent)
    return union


def count_phrases(texts: DataFrame, keys: DataFrame, longest: int) -> DataFrame:
    """``lang``, ``phrase`` and ``n``: exact counts of the candidates; the number of all words where ``phrase`` is null."""
    flags = _flags(keys)
    no_shard = ~np.uint64((1 << SHARD_BITS) - 1)

    def counted(block: _Block, language, group, langs: pa.Array) -> Iterator[pa.RecordBatch]:
        fits = np.ones(len(block.hashes), bool)
        for k in range(1, longest + 1):
            at = _chain(block, fits, k)
            keys = block.keys(at, k, language, group)
            hit = bitsets.hit(flags.value, keys)
            at, keys = at[hit], keys[hit]
            fits = np.zeros(len(fits), bool)
            fits[at] = True
            own = at < block.stop
            _, first, counts = np.unique(keys[own], return_index=True, return_counts=True)
            first = at[own][first]
            words = [block.texts.take(pa.array(first + i)) for i in range(k)]
            phrases = pc.binary_join_element_wise(*words, " ") if k > 1 else words[0]
            yield pa.record_batch([langs.take(pa.array(block.row[first])), phrases, pa.array(counts)], names=["lang", "phrase", "n"])
        rows, counts = np.unique(block.row[: block.stop], return_counts=True)
        yield pa.record_batch([langs.take(pa.array(rows)), pa.nulls(len(rows), pa.string()), pa.array(counts)], names=["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language, group = _numbers(batch.column("language")), _numbers(batch.column("grp")) & no_shard
            for block in _blocks(batch.column("text"), True):
                yield from counted(block, language, group, batch.column("lang"))

    return texts.mapInArrow(run, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(18,0)")


def scored(counts: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of all phrases of two words or more.

    ``counts`` holds all frequent phrases, words too, and the totals, as :func:`count_phrases` gives them.
    The score is that of the lowest-scoring cut in two, worked out in decimals.
    """
    known = counts.where("phrase is not null")
    totals = counts.where("phrase is null").select(F.col("lang").alias("t"), F.col("n").alias("words"))
    words = F.split("phrase", " ")
    phrases = known.where(F.size(words) > 1).select("lang", "phrase", F.col("n").alias("a"), words.alias("w"))
    phrases = phrases.join(totals, F.col("lang") == F.col("t")).drop("t")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.withColumns(
        {"left": F.array_join(F.slice("w", 1, F.col("k")), " "), "right": F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ")}
    ).drop("w")
    for part, name in (("left", "l"), ("right", "r")):
        of = known.select(F.col("lang").alias("kl"), F.col("phrase").alias("kp"), F.col("n").alias(name))
        cuts = cuts.join(of, (F.col("lang") == F.col("kl")) & (F.col(part) == F.col("kp"))).drop("kl", "kp", part)
    top = F.lit(1000).cast("decimal(4,0)") * _exact("a") * _exact("words")
    cuts = cuts.withColumns({"top": top, "below": _exact("l") * _exact("r")}).withColumn("score", F.expr("top div below"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "a", F.col("words").alias("n")).agg(best).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def contained(counts: DataFrame) -> DataFrame:
    """``lang``, ``phrase`` and ``most``: the count of the most frequent longer phrase that holds the phrase."""
    w = F.split("phrase", " ")
    longer = counts.where("phrase is not null").select("lang", "n", w.alias("w")).where("size(w) > 2")
    sized = longer.select("lang", "n", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("k"))
    parts = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.array_join(F.slice("w", i, F.col("k")), " "))
    return sized.select("lang", "n", F.explode(parts).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, longest: int = LONGEST, kept: int = KEPT, inside: int = INSIDE
) -> DataFrame:
    """The ``kept`` best phrases of 2 to ``longest`` words of each language.

    ``lang``, ``rank``, ``phrase``, ``a`` (its count), ``l`` and ``r`` (counts of its two parts), ``n`` (words of
    the language) and ``score``. Phrases occur ``support`` times or more; one that lies in a
    longer phrase with at least ``inside`` percent of its count goes. Ties by count, then phrase.
    """
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases have 2 to {LONGEST} words")
    name = F.coalesce(F.col(lang), F.lit(UNKNOWN))
    shard = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 64 - SHARD_BITS)
    language = F.xxhash64(name)
    group = F.shiftleft(F.shiftrightunsigned(language, 64 - LANGUAGE_BITS), SHARD_BITS).bitwiseOR(shard)
    texts = docs.select(F.col(text).alias("text"), name.alias("lang"), language.alias("language"), group.alias("grp"))
    keys = candidates(texts, support, longest)
    counts = count_phrases(texts, keys, longest).where(F.col("phrase").isNull() | (F.col("n") >= support))
    counts = written(counts, "phrase-counts")
    held = contained(counts).select(F.col("lang").alias("hl"), F.col("phrase").alias("hp"), "most")
    rows = scored(counts).join(held, (F.col("lang") == F.col("hl")) & (F.col("phrase") == F.col("hp")), "left")
    rows = rows.where(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a"))).drop("hl", "hp", "most")
    best = top_k_per_group(rows, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], kept)
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
