"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text, one from words that mark toxic texts and one
from ordinary text. A window is a word; it is compressed with either dictionary, and the pair of
lengths says which kind of text explains it better. Zstandard stores very short input as it is, so
a window is its word written ``REPEAT`` times. Lengths are calibrated on the labelled texts: the log
odds of each pair of lengths, then a logistic model of a text's strongest window, its number of
toxic windows and its length.

Words are runs of letters and digits in lower case. A text without a window (null or
empty, for instance) gets the share of toxic texts as its score. Equal texts get equal scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.llm.words import NOT_ALNUM, mix, slices, spans, word_hashes

#: Labelled texts that the model is fitted on, and their greatest length in characters.
SAMPLE = {1: 1500, 0: 3000}
SAMPLE_CHARS = 50_000
DICTIONARY_BYTES = 16_384
LEVEL = 6
REPEAT = 3
#: Least log-likelihood ratio of a word that marks toxic text, counted in different neighbourhoods.
MARK = 18.0
CACHED_WINDOWS = 1 << 20
THRESHOLD = 0.3

Bin = tuple[int, int, int]


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    odds: dict[Bin, float]
    weights: tuple[float, ...]
    share: float  # of toxic texts among all labelled ones


class _Lengths:
    """Compressed lengths of windows, kept by the hash of their word for as many as ``CACHED_WINDOWS``.

    What is kept changes the speed only. A word has the number of its bin, which ``bins`` lists.
    """

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.pair = [
            zstandard.ZstdCompressor(
                level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            for content in (toxic, ordinary)
        ]
        self.bins: dict[Bin, int] = {}
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def _measure(self, word: bytes) -> int:
        window = b" " + (word + b" ") * REPEAT
        toxic, ordinary = [len(c.compress(window)) for c in self.pair]
        found = min(len(word), 24), max(-4, min(12, ordinary - toxic)), min(toxic, 40)
        return self.bins.setdefault(found, len(self.bins))

    def numbers_of(self, hashes: np.ndarray, blob: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The bin numbers of different words, which come with their hashes in order and their places in ``blob``."""
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        numbers = np.zeros(len(hashes), np.int32)
        numbers[known] = self.numbers[at[known]]
        new = np.flatnonzero(~known)
        numbers[new] = [self._measure(blob[a:b]) for a, b in zip(starts[new].tolist(), ends[new].tolist())]
        if len(self.hashes) + len(new) > CACHED_WINDOWS:
            self.hashes, self.numbers = hashes[:CACHED_WINDOWS], numbers[:CACHED_WINDOWS]
        elif len(new):
            self.hashes = np.insert(self.hashes, at[new], hashes[new])
            self.numbers = np.insert(self.numbers, at[new], numbers[new])
        return numbers


def _windows(column: pa.Array, lengths: _Lengths) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slice: windows before each row and in all, and the bin number of each window."""
    for _, _, data, offsets in slices(column, prepare=pc.utf8_lower):
        starts, ends, before = spans(data, offsets, NOT_ALNUM)
        hashes, where, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        yield before, lengths.numbers_of(hashes, data.tobytes(), starts[where], ends[where])[which]


def _seen(column: pa.Array, lengths: _Lengths) -> Counter:
    """How many windows fall into each bin."""
    total = np.zeros(0, np.int64)
    for _, numbers in _windows(column, lengths):
        counts = np.bincount(numbers, minlength=len(lengths.bins))
        counts[: len(total)] += total
        total = counts
    return Counter({b: int(n) for b, n in zip(lengths.bins, total.tolist()) if n})


def _features(column: pa.Array, lengths: _Lengths, odds: dict[Bin, float]) -> np.ndarray:
    """For each text the strongest window, the logs of its numbers of strong, marked and all windows, and one."""
    parts = [np.zeros((0, 5))]
    for before, numbers in _windows(column, lengths):
        count = np.diff(before)
        some = np.flatnonzero(count)
        x = np.zeros((len(count), 5))
        if len(some):
            values, at = np.array([odds.get(b, 0.0) for b in lengths.bins])[numbers], before[some]
            x[some, 0] = np.maximum.reduceat(values, at)
            for place, limit in ((1, 2), (2, 1)):
                x[some, place] = np.log1p(np.add.reduceat(values > limit, at, dtype=np.int64))
        x[:, 3] = np.log1p(count)
        x[:, 4] = 1.0
        parts.append(x)
    return np.concatenate(parts)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _neighbourhoods(column: pa.Array) -> tuple[Counter, dict[int, bytes]]:
    """Different pairs of neighbours of each word hash; copies of a passage count once."""
    words, places, texts = [], [], {}
    for _, _, data, offsets in slices(column, prepare=pc.utf8_lower):
        starts, ends, before = spans(data, offsets, NOT_ALNUM)
        hashes = word_hashes(data, starts, ends)
        first = np.zeros(len(hashes) + 1, bool)
        first[before] = True
        left = np.where(first[:-1], np.uint64(1), np.roll(hashes, 1))
        right = np.where(first[1:], np.uint64(2), np.roll(hashes, -1))
        words.append(hashes)
        places.append(mix(hashes + mix(left * np.uint64(3) + right)))
        unique, where = np.unique(hashes, return_index=True)
        blob = data.tobytes()
        texts.update({h: blob[starts[i]: ends[i]] for h, i in zip(unique.tolist(), where.tolist()) if h not in texts})
    if not words:
        return Counter(), texts
    _, where = np.unique(np.concatenate(places), return_index=True)
    unique, counts = np.unique(np.concatenate(words)[where], return_counts=True)
    return Counter(dict(zip(unique.tolist(), counts.tolist()))), texts


def _marks(toxic: pa.Array, ordinary: pa.Array) -> list[bytes]:
    """Words that mark toxic text, the strongest last."""
    t, texts = _neighbourhoods(toxic)
    o, _ = _neighbourhoods(ordinary)
    n_t, n_o = sum(t.values()), sum(o.values())
    if not n_t or not n_o:
        return []
    share = n_t / (n_t + n_o)
    found = []
    for word, n in t.items():
        m = o[word]
        expected = (n + m) * share
        if n <= expected or n / n_t < 4 * m / n_o:
            continue
        ratio = 2 * (n * np.log(n / expected) + (m * np.log(m / ((n + m) * (1 - share))) if m else 0.0))
        if ratio >= MARK:
            found.append((ratio, texts[word]))
    return [w for _, w in sorted(found)]


def train(texts: list[str], toxic: list[int], share: float | None = None) -> Model:
    """Dictionaries and calibration from labelled texts.

    ``share`` is that of toxic texts where the sample was drawn from, by which scores are shifted;
    None: that of the sample. Without texts of both kinds every score is the share.
    """
    label = np.array(toxic, np.int64)
    column = pa.array(texts, pa.string())
    kinds = [column.filter(pa.array(label == k)) for k in (1, 0)]
    pad = b"\n" * 16  # the last bytes of a dictionary are never matched
    marks = _marks(*kinds)
    bad = b"".join(b" " + w for w in marks)[-DICTIONARY_BYTES:] + b" " + pad
    plain = "\n".join((t or "")[: DICTIONARY_BYTES // 16] for t in kinds[1].to_pylist()[:32]).lower().encode()
    good = b" " + plain[:DICTIONARY_BYTES] + pad
    lengths = _Lengths(bad, good)
    seen = [_seen(kinds[1], lengths), _seen(kinds[0], lengths)]
    n_o, n_t = sum(seen[0].values()), sum(seen[1].values())
    odds: dict[Bin, float] = {}
    if n_o and n_t:
        prior = n_t / (n_t + n_o)
        for b in seen[0] | seen[1]:
            odds[b] = float(np.log((seen[1][b] + 0.2 * prior) / n_t) - np.log((seen[0][b] + 0.2 * (1 - prior)) / n_o))
    x, w = _features(column, lengths, odds), np.zeros(5)
    if len(label):
        for _ in range(50):
            p = _logistic(x @ w)
            hessian = x.T @ (x * (p * (1 - p))[:, None]) + 0.01 * np.eye(5)
            w += np.linalg.solve(hessian, x.T @ (label - p) - 0.01 * w)
    own = float(label.mean()) if len(label) else 0.0
    share = own if share is None else share
    if 0 < own < 1 and 0 < share < 1:
        w[-1] += np.log(share / (1 - share)) - np.log(own / (1 - own))
    else:
        w[:] = 0.0
        w[-1] = np.log((share + 1e-9) / (1 - share + 1e-9))
    return Model(bad, good, odds, tuple(w.tolist()), share)


def training_rows(
    docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic"
) -> tuple[list[str], list[int], float]:
    """Texts and labels, and the share of toxic ones in all that may be learned from.

    The texts are those of at most ``SAMPLE`` keys of each kind, those with the least hash; of the rows of
    a key the one with the least hash of its text is taken.
    ``learn`` is a condition on ``__id``. Texts over ``SAMPLE_CHARS`` characters are not learned from.
    """
    known = labels.select(F.col(key).alias("__id"), F.col(label).cast("int").alias("__label")).where(learn)
    known = known.where("__id is not null and __label is not null").groupBy("__id").agg(F.max("__label").alias("__label"))
    share = known.agg(F.avg("__label").alias("share")).first()["share"] or 0.0
    order = [F.xxhash64("__id"), F.col("__id")]
    chosen = None
    for kind, most in SAMPLE.items():
        some = known.where(F.col("__label") == kind).orderBy(*order).limit(most)
        chosen = some if chosen is None else chosen.union(some)
    # one row of each key, so bounded by SAMPLE
    rows = (
        docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
        .join(F.broadcast(chosen), F.col("__key") == F.col("__id"))
        .where(F.length("__text") <= SAMPLE_CHARS)
        .groupBy("__id", "__label").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text")).toArrow()
    )
    rows = sorted(zip(rows["__id"].to_pylist(), rows["__label"].to_pylist(), rows["__text"].to_pylist()))
    return [r[2] for r in rows], [r[1] for r in rows], share


def score(model, text: str) -> Column:
    """Column of scores from 0 to 1; ``model`` is the broadcast tuple of a ``Model``."""

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        m = Model(*model.value)
        known = _MODELS.get(m.weights)
        if known is None:
            _MODELS.clear()
            known = _MODELS[m.weights] = _Lengths(m.toxic, m.ordinary)
        x = _features(column, known, m.odds)
        scores = _logistic(x @ np.array(m.weights))
        scores[x[:, 3] == 0] = m.share  # no window
        return pa.array(scores, pa.float64())

    return run.asNondeterministic()(F.col(text))  # else a filter on the score would work it out twice


#: Compressors of the model in use in this process.
_MODELS: dict[tuple[float, ...], _Lengths] = {}


def scored(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``__score``; the model learns from the labels that ``learn`` admits."""
    model = train(*training_rows(docs, labels, learn, key, text))
    return docs.withColumn("__score", score(docs.sparkSession.sparkContext.broadcast(tuple(model)), text))
