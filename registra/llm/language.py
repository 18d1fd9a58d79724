"""Language identification by a bidirectional gated recurrent network over bytes.

Text is read in windows of ``LENGTH`` bytes; one recurrent network reads each window forwards and one
backwards, both from a zero state, and every byte is labelled from the two states at its place. A
text's probabilities are the mean over all its bytes. The networks are trained here, in numpy, by
backpropagation through time, on windows of a bounded sample of labelled texts.

The gates use the piecewise linear sigmoid ``clip(0.2 x + 0.5, 0, 1)``. Null texts and texts without a
letter are ``und`` with score 0; so is every text when nothing can be learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.llm.words import slices

LENGTH = 64
HIDDEN = 8
#: Labelled texts of each language that windows are drawn from, and windows drawn from each.
SAMPLE_TEXTS = 4000
WINDOWS_PER_TEXT = 16
STEPS, BATCH, RATE = 200, 192, 0.02
#: Bytes a task labels at a time.
CHUNK_BYTES = 1 << 19
UNKNOWN = "und"

Weights = dict[str, np.ndarray]


def initial(languages: int, seed: int = 7) -> Weights:
    """Per direction: ``e`` maps a byte to the three gates' inputs, ``u`` the state, ``o`` the state to labels."""
    rng = np.random.default_rng(seed)
    out: Weights = {"c": np.zeros(languages, np.float32)}
    for d in "fb":
        out["e" + d] = rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(np.float32)
        out["u" + d] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
        out["o" + d] = rng.normal(0, 0.3, (HIDDEN, languages)).astype(np.float32)
    return out


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(0.2 * x + 0.5, 0, 1)


def _states(bytes_: np.ndarray, e: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each of the steps (rows of ``bytes_``); ``keep`` collects what backpropagation needs."""
    steps, batch = bytes_.shape
    out = np.zeros((steps + 1, batch, HIDDEN), np.float32)
    for t in range(steps):
        x, s = e[bytes_[t]], out[t] @ u
        gates = _gate(x[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN:] + r * s[:, 2 * HIDDEN:])
        out[t + 1] = n + z * (out[t] - n)
        if keep is not None:
            keep.append((z, r, n, s[:, 2 * HIDDEN:]))
    return out


def _backwards(bytes_, e, u, states, kept, grad) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of ``e`` and ``u`` from the gradient at every state."""
    d_e, d_u = np.zeros_like(e), np.zeros_like(u)
    carry = np.zeros_like(states[0])
    gate = lambda g: 0.2 * ((g > 0) & (g < 1))
    for t in range(len(kept) - 1, -1, -1):
        z, r, n, s = kept[t]
        before = states[t]
        d = grad[t] + carry
        d_n = d * (1 - z) * (1 - n * n)
        d_z = d * (before - n) * gate(z)
        d_r = d_n * s * gate(r)
        d_x = np.concatenate([d_z, d_r, d_n], 1).astype(np.float32)
        d_s = np.concatenate([d_z, d_r, d_n * r], 1).astype(np.float32)
        np.add.at(d_e, bytes_[t], d_x)
        d_u += before.T @ d_s
        carry = d * z + d_s @ u.T
    return d_e, d_u


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def loss_and_gradients(w: Weights, windows: np.ndarray, label: np.ndarray) -> tuple[float, Weights]:
    """Mean cross-entropy over all positions, and its gradients."""
    forward, grads = np.ascontiguousarray(windows.T), {}
    backward = np.ascontiguousarray(forward[::-1])
    kept_f: list = []
    kept_b: list = []
    f, b = _states(forward, w["ef"], w["uf"], kept_f), _states(backward, w["eb"], w["ub"], kept_b)
    at_f, at_b = f[1:], b[1:][::-1]
    p = _softmax(at_f @ w["of"] + at_b @ w["ob"] + w["c"])
    rows = np.arange(len(label))
    loss = -float(np.log(p[:, rows, label] + 1e-9).mean())
    p[:, rows, label] -= 1
    p /= p.shape[0] * p.shape[1]
    grads["c"] = p.sum((0, 1))
    grads["of"], grads["ob"] = np.einsum("tbh,tbk->hk", at_f, p), np.einsum("tbh,tbk->hk", at_b, p)
    grads["ef"], grads["uf"] = _backwards(forward, w["ef"], w["uf"], f, kept_f, p @ w["of"].T)
    grads["eb"], grads["ub"] = _backwards(backward, w["eb"], w["ub"], b, kept_b, (p @ w["ob"].T)[::-1])
    return loss, grads


def train(windows: np.ndarray, label: np.ndarray, languages: int, steps: int = STEPS, seed: int = 7) -> Weights:
    """Adam on batches that draw every language equally often."""
    w, rng = initial(languages, seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(x) for k, x in w.items()}
    by_label = [np.flatnonzero(label == k) for k in range(languages)]
    for step in range(1, steps + 1):
        kind = rng.integers(0, languages, BATCH)
        pick = np.array([by_label[k][rng.integers(len(by_label[k]))] for k in kind])
        _, grads = loss_and_gradients(w, windows[pick], label[pick])
        rate = RATE * (1 - step / (steps + 1))
        for k, g in grads.items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of each text (padded with byte 0), their true lengths, and the number per text."""
    sizes = np.diff(offsets)
    counts = -(-sizes // LENGTH)
    row = np.repeat(np.arange(len(sizes)), counts)
    start = offsets[:-1][row] + (np.arange(len(row)) - (np.cumsum(counts) - counts)[row]) * LENGTH
    lengths = np.minimum(offsets[1:][row] - start, LENGTH)
    place = start[:, None] + np.arange(LENGTH)
    inside = np.arange(LENGTH) < lengths[:, None]
    windows = np.where(inside, np.concatenate([data, np.zeros(LENGTH, np.uint8)])[np.minimum(place, len(data))], 0)
    return windows.astype(np.uint8), lengths, counts


def _read(bytes_: np.ndarray, e: np.ndarray, u: np.ndarray, order, seen) -> None:
    """Run one direction without keeping states; features lie in rows, so each operation is contiguous."""
    h, batch = HIDDEN, bytes_.shape[1]
    e, u = e.T.copy(), u.T.copy()
    e[: 2 * h] = 0.2 * e[: 2 * h] + 0.5  # the gates' line, worked into the weights
    u[: 2 * h] *= 0.2
    state, x, s = np.zeros((h, batch), np.float32), np.empty((3 * h, batch), np.float32), np.empty((3 * h, batch), np.float32)
    n = np.empty((h, batch), np.float32)
    for t in order:
        np.take(e, bytes_[t], axis=1, out=x, mode="clip")
        np.matmul(u, state, out=s)
        gates = x[: 2 * h]
        gates += s[: 2 * h]
        np.clip(gates, 0, 1, out=gates)
        np.multiply(gates[h:], s[2 * h:], out=n)
        n += x[2 * h:]
        np.tanh(n, out=n)
        state -= n
        state *= gates[:h]
        state += n
        seen(t, state)


def _sums(w: Weights, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per window, the sum over its bytes of the probability of each language."""
    bytes_ = np.ascontiguousarray(windows.T).astype(np.intp)
    languages, batch = len(w["c"]), len(windows)
    score = np.empty((LENGTH, languages, batch), np.float32)
    out = np.zeros((languages, batch), np.float32)
    of, ob, c = np.ascontiguousarray(w["of"].T), np.ascontiguousarray(w["ob"].T), w["c"][:, None]

    def forwards(t, state):
        np.matmul(of, state, out=score[t])

    def backwards(t, state):
        p = score[t]
        p += ob @ state
        p += c
        np.exp(p, out=p)
        scale = 1 / p.sum(0)
        scale[lengths <= t] = 0
        p *= scale
        np.add(out, p, out=out)

    _read(bytes_, w["ef"], w["uf"], range(LENGTH), forwards)
    _read(bytes_, w["eb"], w["ub"], range(LENGTH - 1, -1, -1), backwards)
    return out.T


def probabilities(w: Weights, column: pa.Array) -> np.ndarray:
    """Mean probabilities over all bytes of each text; zeros for an empty text."""
    out = np.zeros((len(column), len(w["c"])))
    step = CHUNK_BYTES // LENGTH
    for first, last, data, offsets in slices(column, CHUNK_BYTES):
        windows, lengths, counts = _cut(data, offsets)
        if not len(windows):
            continue
        sums = np.concatenate([_sums(w, windows[i: i + step], lengths[i: i + step]) for i in range(0, len(windows), step)])
        some = np.flatnonzero(counts)
        total = np.add.reduceat(sums.astype(np.float64), (np.cumsum(counts) - counts)[some], axis=0)
        out[first + some] = total / np.diff(offsets)[some, None]
    return out


def training_windows(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang"):
    """Windows and languages of at most ``SAMPLE_TEXTS`` texts of each language, those with the least hash of their key.

    So a language is learned however small its share; of a key with several languages the first counts,
    of its rows the one with the least hash of its text.
    ``learn`` is a condition on ``__id``. ``WINDOWS_PER_TEXT`` windows are drawn from each text.
    """
    known = docs.select(F.col(key).alias("__id"), F.col(lang).alias("__lang")).where(learn).where("__id is not null and __lang is not null")
    known = known.groupBy("__id").agg(F.min("__lang").alias("__lang")).withColumn("__h", F.xxhash64("__id"))
    sizes = F.broadcast(known.groupBy("__lang").agg(F.count(F.lit(1)).alias("__n")))
    # the least hashes of each language, about twice as many as are taken: bounded by SAMPLE_TEXTS and the languages
    place = (F.col("__h") / 2.0**64 + 0.5) * F.col("__n")
    least = known.join(sizes, "__lang").where(place < 2 * SAMPLE_TEXTS + 200).select("__lang", "__h", "__id").toArrow()
    least = least.sort_by([(name, "ascending") for name in least.column_names])
    names = least["__lang"].to_pylist()
    first = {name: i for i, name in reversed(list(enumerate(names)))}
    least = least.filter(pa.array([i - first[name] < SAMPLE_TEXTS for i, name in enumerate(names)], pa.bool_()))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(least.select(["__id", "__lang"])))
    texts = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(chosen, F.col("__key") == F.col("__id"))

    @F.arrow_udf("binary")
    def drawn(ids: pa.Array, column: pa.Array) -> pa.Array:
        out = []
        for i, value in zip(ids.to_pylist(), column.to_pylist()):
            data = (value or "").encode()
            rng = np.random.default_rng(abs(i))
            count = -(-len(data) // LENGTH)
            pick = rng.permutation(count)[:WINDOWS_PER_TEXT]
            out.append(b"".join(data[p * LENGTH: (p + 1) * LENGTH].ljust(LENGTH, b"\0") for p in pick.tolist()))
        return pa.array(out, pa.binary())

    single = texts.groupBy("__id", "__lang").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))
    rows = single.select("__id", "__lang", drawn("__id", "__text").alias("w")).toArrow()
    rows = sorted(zip(rows["__id"].to_pylist(), rows["__lang"].to_pylist(), rows["w"].to_pylist()))
    rows = [r for r in rows if r[2]]
    names = sorted({r[1] for r in rows})
    windows = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, LENGTH)
    label = np.repeat([names.index(r[1]) for r in rows], [len(r[2]) // LENGTH for r in rows]).astype(np.int64)
    return windows, label, names


def identified(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` with a struct ``__lang``: ``pred`` and ``score``, the mean probability of ``pred``.

    Ties go to the language that sorts first.
    """
    windows, label, names = training_windows(docs, learn, key, text, lang)
    weights = train(windows, label, len(names)) if len(names) > 1 else initial(max(len(names), 1))
    model = docs.sparkSession.sparkContext.broadcast((weights, names))

    @F.arrow_udf("struct<pred: string, score: double>")
    def run(column: pa.Array, readable: pa.Array) -> pa.Array:
        w, known = model.value
        pred = [UNKNOWN] * len(column)
        score = np.zeros(len(column))
        if known:
            p = probabilities(w, column)
            best = p.argmax(1)
            for i in np.flatnonzero(readable.to_numpy(zero_copy_only=False).astype(bool)).tolist():
                pred[i], score[i] = known[best[i]], min(float(p[i, best[i]]), 1.0)
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["pred", "score"])

    return docs.withColumn("__lang", run(F.col(text), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))))
