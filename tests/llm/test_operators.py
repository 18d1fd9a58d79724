"""The training-text operators against brute force on small tables, and their defined edge cases."""

import base64
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from registra.llm import bitsets, chat, components, decontam, language, mixing, quality, simhash, substrings, tokens, toxicity, urls, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "doc_id bigint, text string, source string, id string, tk string, score string, fp string, component_id string"
VOCABULARY = tokens.VOCABULARY


def frame(spark, rows):
    """Documents with extra columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, "s", "x", "x", "x", "x", "x") for i, t in rows], EXTRA)


def text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# -- shared helpers -----------------------------------------------------------------------------


def test_spans_and_windows():
    column = pa.array(["a bb  ccc", " x", "", None, "bb ccc a bb", "end\n", "é\x0bü"])
    data, offsets = words.utf8(column)
    starts, ends, before = words.spans(data, offsets)
    got = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert got == ["a", "bb", "ccc", "x", "bb", "ccc", "a", "bb", "end", "é", "ü"]
    assert before.tolist() == [0, 3, 4, 4, 4, 8, 9, 11]
    hashes = words.word_hashes(data, starts, ends)
    at = words.windows(before, 2)
    assert at.tolist() == [0, 1, 4, 5, 6, 9]
    pairs = words.window_hashes(hashes, at, 2)
    assert (pairs[:, None] == pairs[None, :]).sum() == len(at) + 4  # "a bb" and "bb ccc" occur twice


def test_slices_cover_all_rows():
    column = pa.array(["x" * n for n in (5, 0, 900, 3, 3, 0, 7)]).slice(1)
    got = [(a, b, len(d)) for a, b, d, _ in words.slices(column, 10)]
    assert [g[0] for g in got] == [0] + [g[1] for g in got][:-1] and got[-1][1] == 6
    assert sum(g[2] for g in got) == 913


def test_bitset_loses_no_member(spark):
    values = [random.Random(1).getrandbits(64) - (1 << 63) for _ in range(3000)]
    flags = bitsets.build(spark.createDataFrame([(v,) for v in values], "h bigint"), "h", len(values))
    assert bitsets.hit(flags, np.array(values, np.int64).view(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 1 << 63, 20000, dtype=np.uint64)
    assert bitsets.hit(flags, others).mean() < 0.05
    assert not bitsets.hit(bitsets.build(spark.createDataFrame([], "h bigint"), "h", 0), others).any()


def _union(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    pairs = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(0, i) for i in range(1, 200)] + [(500, 501), (501, 501)],
        "random": [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)],
        "none": [],
    }[shape]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in _union(p for p in pairs if p[0] != p[1]).items()}


# -- quality ------------------------------------------------------------------------------------


def _counts(t):
    w = WORD.findall(t or "")
    grams = [tuple(w[i: i + 5]) for i in range(len(w) - 4)]
    marked = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(marked)


def test_quality_counts(spark):
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c d e a b c d e"), (5, "a b c d"), (6, "one\none\n\none\ntwo # 5%"), (None, "x"), (6, "again")]
    rows += [(10 + i, "\n".join(text(rng, rng.randrange(1, 30), 4) for _ in range(4))) for i in range(20)]
    got = quality.measures(frame(spark, rows)).withColumn("v", quality.verdict())
    for r in got.collect():
        m = r["__m"]
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == _counts(r["text"])
        assert r["v"] is not None
    assert quality.measures(frame(spark, [])).count() == 0


def test_quality_rules_are_bounds(spark):
    df = spark.createDataFrame([(5.0,), (0.5,), (9.0,)], "x double").select(F.struct("x").alias("__m"))
    rule = quality.verdict([quality.Rule("x", 1, 8)])
    assert [r[0] for r in df.select(rule).collect()] == [True, False, False]


# -- toxicity -----------------------------------------------------------------------------------


def _toxic_table(n=400):
    rng = random.Random(5)
    bad = ["blighter", "nincompoop", "scum", "rotter", "oaf"]
    rows, labels = [], []
    for i in range(n):
        w = text(rng, rng.randrange(20, 60), 3000).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = _toxic_table()
    odd = [(9001, None), (9002, ""), (9003, "...!"), (None, rows[0][1]), (0, rows[0][1]), (9004, "scum " * 40000)]
    got = toxicity.scored(
        frame(spark, rows + odd), spark.createDataFrame(labels, "doc_id bigint, toxic int"), F.col("__id") % 2 == 0
    ).select("doc_id", "text", "__score").collect()
    assert len(got) == len(rows) + len(odd)
    truth = dict(labels)
    held = [(truth[r.doc_id], r["__score"] >= 0.3) for r in got if r.doc_id is not None and r.doc_id < 9000 and r.doc_id % 2]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    by_text = {}
    for r in got:
        assert 0 <= r["__score"] <= 1
        assert by_text.setdefault(r.text, r["__score"]) == r["__score"]
    assert by_text[None] == by_text[""] == by_text["...!"]


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)], [(1, None), (None, 1)]])
def test_toxicity_without_both_kinds(spark, labels):
    got = toxicity.scored(
        frame(spark, [(1, "a b"), (2, "c")]), spark.createDataFrame(labels, "doc_id bigint, toxic int"), F.lit(True)
    ).collect()
    assert len(got) == 2 and all(0 <= r["__score"] <= 1 for r in got)


# -- mixing -------------------------------------------------------------------------------------


def _fill(sizes, weights=(3, 1, 2)):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in above}
        open_ -= above
    return target


@pytest.mark.parametrize("leaf", [4, 256])
def test_mix_meets_targets(spark, leaf):
    rng = random.Random(6)
    rows = [(i, rng.randrange(0, 60), rng.choice(["a", "b", "c", "d", "é", None])) for i in range(700)]
    rows += [(10_000 + i, 900, "tiny") for i in range(2)] + [(5, 7, "a")] * 90 + [(None, 11, None)] * 5 + [(20_000, 0, "void")]
    df = spark.createDataFrame(rows, "id bigint, size bigint, source string")
    got = mixing.mix(df, leaf=leaf).collect()
    again = mixing.mix(df.repartition(7), leaf=leaf).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)
    assert sorted(((r.id, r.size, r.source) for r in got), key=key) == sorted(rows, key=key)
    sizes = {}
    for _, n, s in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = _fill(sizes)
    for s, target in want.items():
        mine = [r for r in got if r.source == s]
        assert all(math.isclose(r.target, target, rel_tol=1e-9) and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= max(r.size for r in mine) / 2 + 1e-6
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)


def test_mix_keeps_expectations(spark):
    """Over many seeds each document is taken as often as its expectation says."""
    df = spark.createDataFrame([(i, 10 + i % 3, "a" if i < 30 else "b") for i in range(60)], "id bigint, size bigint, source string")
    runs = [mixing.mix(df, seed=s, leaf=8).collect() for s in range(12)]
    copies = np.mean([[r.taken / r.size for r in sorted(run)] for run in runs], axis=0)
    expected = np.array([r.target / r.source_size for r in sorted(runs[0])])
    assert abs(copies - expected).max() < 0.55 and abs((copies - expected).mean()) < 0.05


@pytest.mark.parametrize("rows", [[], [(1, 0, "a")], [(1, 5, "a")], [(1, 5, None), (1, 5, None)]])
def test_mix_small(spark, rows):
    got = mixing.mix(spark.createDataFrame(rows, "id bigint, size bigint, source string")).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)


# -- substrings ---------------------------------------------------------------------------------


def _removed(rows, window):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - window + 1) if i is not None else ():
            k = tuple(w[p: p + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[p: p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


@pytest.mark.parametrize("window", [6, 10, 50])
def test_substrings_equal_brute_force(spark, window):
    rng = random.Random(window)
    shared = [text(rng, n) for n in (window - 1, window, window + 1, 2 * window + 3, 130)]
    rows = [(None, shared[-1]), (900, None), (901, ""), (902, " \n"), (903, "ber " * 300), (904, "ber " * 200), (1, shared[-1]), (1, shared[-1])]
    for i in range(60):
        parts = [text(rng, rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 4)):
            parts += [rng.choice(shared), text(rng, rng.randrange(0, 15))]
        rows.append((rng.randrange(0, 50), rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(300 + i, rows[20][1]) for i in range(30)]
    got = substrings.remove_repeats(frame(spark, rows), window=window).select("doc_id", "__cut.*").collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(_removed(rows, window), key=key)


def test_substrings_long_text_and_empty(spark):
    rng = random.Random(8)
    long = text(rng, 60_000, 10**9)
    rows = [(1, long), (2, "start " + long[1000:200_000] + " end"), (3, "short text")]
    got = substrings.remove_repeats(frame(spark, rows)).select("doc_id", "__cut.*").collect()
    assert sorted(map(tuple, got)) == _removed(rows, 50)
    assert substrings.remove_repeats(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substrings.repeats(frame(spark, []), window=7)


def test_windows_settled_in_small_steps(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HELD_WINDOWS", 5)
    rng = random.Random(9)
    same = text(rng, 80)
    rows = [(i, same + " " + text(rng, 10)) for i in range(20)]
    got = substrings.remove_repeats(frame(spark, rows), window=10).select("doc_id", "__cut.*").collect()
    assert sorted(map(tuple, got)) == _removed(rows, 10)


# -- language -----------------------------------------------------------------------------------


def test_language_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in language.initial(3).items()}
    windows, label = rng.integers(97, 105, (4, 6)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, grads = language.loss_and_gradients(w, windows, label)
    for name in w:
        flat = w[name].reshape(-1)
        for at in rng.choice(len(flat), 6) if name not in ("ef", "eb") else [97 * 24 + 3, 98 * 24 + 12, 99 * 24 + 20]:
            keep, h = flat[at], 1e-3
            flat[at] = keep + h
            up = language.loss_and_gradients(w, windows, label)[0]
            flat[at] = keep - h
            down = language.loss_and_gradients(w, windows, label)[0]
            flat[at] = keep
            assert abs((up - down) / (2 * h) - grads[name].reshape(-1)[at]) < 2e-3


def test_language_reading_agrees_with_training():
    w = language.initial(4)
    column = pa.array(["some text of a few bytes " * 7, None, "", "x"])
    got = language.probabilities(w, column)
    for value, p in zip(column.to_pylist(), got):
        data = np.frombuffer((value or "").encode(), np.uint8)
        total = np.zeros(4)
        for at in range(0, len(data), language.LENGTH):
            window = np.zeros((1, language.LENGTH), np.uint8)
            part = data[at: at + language.LENGTH]
            window[0, : len(part)] = part
            f = language._states(window.T, w["ef"], w["uf"])[1:]
            b = language._states(window.T[::-1], w["eb"], w["ub"])[1:][::-1]
            total += language._softmax(f @ w["of"] + b @ w["ob"] + w["c"])[: len(part), 0].sum(0)
        assert np.allclose(p, total / max(len(data), 1), atol=1e-4)


def test_language_held_out(spark):
    rng = random.Random(10)
    parts = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["sch", "ein", "ung", "ber"], "zz": ["éa", "oux", "çi", "ent"]}
    rows = []
    for i in range(240):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(rng.randrange(5, 60))), lang))
    rows += [(1000, None, "xx"), (1001, "", None), (1002, "12 34 !", "yy"), (None, rows[0][1], None), (1, rows[1][1], rows[1][2]), (1003, rows[2][1] * 500, None)]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id bigint, text string, lang string, score string, pred string")
    got = {(r.doc_id, r.text): r["__lang"] for r in language.identified(df, F.col("__id") % 3 != 0).collect()}
    held = [(lang, got[i, t]["pred"]) for i, t, lang in rows[:240] if i % 3 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(got[k]["pred"] == "und" and got[k]["score"] == 0 for k in [(1000, None), (1001, ""), (1002, "12 34 !")])
    assert got[1003, rows[-1][1]]["pred"] == rows[2][2]


def test_small_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_TEXTS", 20)
    rows = [(i, "abc", "xx") for i in range(2000)] + [(i, "éçü", "rr") for i in range(5000, 5010)] + [(7, "abc", "xx")] * 30
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    _, label, names = language.training_windows(df.where("doc_id <> 7"), F.lit(True))
    assert names == ["rr", "xx"] and np.bincount(label).tolist() == [10, 20]
    assert language.training_windows(df, F.lit(True))[2] == ["rr", "xx"]


@pytest.mark.parametrize("rows", [[], [(1, "abc", None)], [(1, "abc", "xx"), (2, None, "xx")]])
def test_language_little_to_learn(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language.identified(df, F.lit(True)).collect()
    assert len(got) == len(rows) and all(r["__lang"]["pred"] in ("xx", "und") for r in got)


# -- tokens -------------------------------------------------------------------------------------


def test_scan_block_boundaries():
    assert tokens.scan_block(np.array([1, 2, 9, 9, 3]), 9).tolist() == [2, 0, 1]
    assert tokens.scan_block(np.array([], np.uint16), 9).tolist() == [0]


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_flat_files(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(tokens, "GROUP_BLOCKS", 3)
    rng = random.Random(11)
    want = {}
    for name, closed in (("a", True), ("b", False), ("c", True), ("empty", True)):
        ids, lengths = [], []
        for _ in range(0 if name == "empty" else 40):
            n = rng.choice([0, 1, 2, 3, 50])
            lengths.append(n)
            ids += [rng.randrange(9) for _ in range(n)] + [9]
        if not closed:
            ids += [1, 2]
            lengths.append(2)
        (tmp_path / name).write_bytes(np.array(ids, np.uint16).tobytes())
        want |= {(str(tmp_path / name), i): n for i, n in enumerate(lengths)}
    files = spark.createDataFrame([(str(tmp_path / n),) for n in ("a", "b", "c", "empty")], "file string")
    got = {(r.file, r.ordinal): r.n_tokens for r in tokens.count_tokens(files, 9, block_bytes=block).collect()}
    assert got == want


def test_token_counts_equal_encoding(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    encoding = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "some text"), (2, None), (3, ""), (None, "no key"), (1, "some text"), (4, "<|endoftext|> é ü" * 3000), (5, "x")]
    got = sorted(((r.doc_id or -1, r.n_tokens) for r in tokens.token_counts(frame(spark, rows)).collect()))
    assert got == sorted((i or -1, len(encoding.encode_ordinary(t or ""))) for i, t in rows)
    assert tokens.token_counts(frame(spark, [])).count() == 0


# -- simhash ------------------------------------------------------------------------------------


def _print(t, k=4):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    parts = [" ".join(w[i: i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _near_table():
    rng = random.Random(12)
    rows = [(7, None), (3, ""), (None, " \n"), (40, "Ä ö B"), (41, "Ä ö b"), (None, "only here"), (42, "one two three four")]
    base = text(rng, 300).split()
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w)))
    rows += [(rng.randrange(500), text(rng, rng.randrange(1, 50))) for _ in range(60)] + [rows[10]] * 3
    return rows


@pytest.mark.parametrize("most_hot", [1, 40, 10_000])
def test_fingerprints_and_classes_equal_brute_force(spark, most_hot, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_HOT", most_hot)
    rows = _near_table()
    prints = [_print(t) for _, t in rows]
    linked = _union((a, b) for a, b in itertools.combinations_with_replacement(set(prints), 2) if (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _), f in zip(rows, prints):
        if i is not None:
            least[linked[f]] = min(least.get(linked[f], i), i)
    want = [(i, f, least.get(linked[f])) for (i, _), f in zip(rows, prints)]
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)

    kept = simhash.one_of_each(frame(spark, rows)).collect()
    classes = {linked[f] for f in prints}
    named = [r for r in kept if least.get(linked[_print(r.text)]) is not None]
    assert len(named) == len({linked[_print(r.text)] for r in named}) == sum(c in least for c in classes)
    assert all(r.doc_id == least[linked[_print(r.text)]] for r in named)
    assert sum(r.doc_id is None for r in kept) == 1  # the class without a key stays
    assert list(kept[0].asDict()) == frame(spark, rows).columns


@pytest.mark.parametrize("block_rows", [3, 4096])
@pytest.mark.parametrize("count", [10, 10**6, 10**9])
def test_links_of_any_plan(spark, block_rows, count, monkeypatch):
    if block_rows == 3:
        monkeypatch.setattr(simhash, "SMALL_GROUP", 2)
    rng = random.Random(13)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(8):
            x = base
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << b
            fps.add(x)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp bigint")
    plan = simhash.segments(count, 4)
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, 4, plan, block_rows).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    want = _union((a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4)
    assert _union(found) == want


def test_one_stays_of_a_class_without_keys(spark):
    rng = random.Random(18)
    base = text(rng, 300).split()
    near = [" ".join(base[:i] + ["changed"] + base[i + 1:]) for i in (3, 150)]
    rows = [(None, t) for t in (" ".join(base), *near, " ".join(base))] + [(None, "only here"), (5, "with a key"), (None, "with a key")]
    prints = [_print(t) for _, t in rows]
    linked = _union((a, b) for a, b in itertools.combinations_with_replacement(set(prints), 2) if (a ^ b).bit_count() <= 4)
    kept = simhash.one_of_each(frame(spark, rows)).collect()
    assert len({linked[f] for f in prints[:4]}) == 1
    assert sorted(linked[_print(r.text)] for r in kept) == sorted({linked[f] for f in prints})
    assert [r.doc_id for r in kept if r.text == "with a key"] == [5]


def test_simhash_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.one_of_each(frame(spark, [])).count() == 0


# -- urls ---------------------------------------------------------------------------------------

RULES = (urls.UrlRule("net", "/", "block"), urls.UrlRule("example.net", "/en/", "allow"), urls.UrlRule("a.example.net", "/", "block"))


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("HTTP://WWW.Example.NET/en/X?q=1", "www.example.net", "/en/X", "example.net/en/", "allow"),
        ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("http://a.example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://a.example.net/e", "a.example.net", "/e", "a.example.net/", "block"),
        ("http://notexample.com#x/y", "notexample.com", "", None, "allow"),
        ("http://x.net?en/", "x.net", "", None, "allow"),
        ("http://a.com/b://c/d", "a.com", "/b://c/d", None, "allow"),
        ("http://casino.com/", "casino.com", "/", None, "block"),
        ("http://casinos.com/essex", "casinos.com", "/essex", None, "allow"),
        ("http://x.com/free/1", "x.com", "/free/1", None, "allow"),
        ("http://x.com/free/free", "x.com", "/free/free", None, "allow"),
        ("http://x.com/FREE_bets", "x.com", "/FREE_bets", None, "block"),
        ("http://x.com/éfree-üads", "x.com", "/éfree-üads", None, "block"),
        ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(url, "x", "x")], "url string, host string, n string")
    row = urls.judge(df, RULES).first()["__url"]
    assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, rule, verdict)


def test_urls_empty(spark):
    assert urls.judge(spark.createDataFrame([], "url string"), RULES).count() == 0


# -- chat ---------------------------------------------------------------------------------------


def _best(seen):
    move, emit = chat.model()
    best = None
    for path in itertools.product(range(chat.N), repeat=len(seen)):
        score, before = 0.0, chat.START
        for s, o in zip(path, seen):
            score, before = score + move[before, s] + emit[s, o], s
        if best is None or score > best + 1e-12:
            best = score
    return best


def _score(path, seen):
    move, emit = chat.model()
    return sum(move[a, b] + emit[b, o] for a, b, o in zip([chat.START, *path[:-1]], path, seen))


def test_path_is_the_best():
    move, emit = chat.model()
    rng = random.Random(14)
    for _ in range(15):
        seen = np.array([rng.randrange(emit.shape[1]) for _ in range(rng.randrange(1, 5))])
        table = chat.table_of(seen, move, emit)
        last = int(table[chat.START].argmax())
        path = chat.decode(seen, chat.START, last, move, emit).tolist()
        assert math.isclose(_score(path, seen), _best(seen.tolist()), rel_tol=1e-9)


def test_blocks_give_the_single_pass(spark, monkeypatch):
    rng = random.Random(15)
    rows = []
    for c in range(4):
        for turn in range(rng.randrange(1, 70)):
            mark = rng.choice(["", "User: ", "Assistant: ", "Q: ", "System: "])
            rows.append((c, turn, mark + "\n".join(text(rng, rng.randrange(0, 40)) + rng.choice(["", "?"]) for _ in range(rng.randrange(1, 4)))))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")
    order = lambda df: sorted(map(tuple, df.collect()))
    whole = order(chat.parse(df))
    monkeypatch.setattr(chat, "BLOCK", 2)
    monkeypatch.setattr(chat, "FAN", 3)
    assert order(chat.parse(df)) == whole
    assert len(whole) == len(rows)


def test_chat_turns(spark):
    rows = [
        (1, 0, "User: What is it?"), (1, 1, "Assistant: An answer.\nMore of it."), (1, 2, "### user: And now?"), (1, 3, "**A:** This."),
        (1, 3, "**A:** This."), (None, 0, "Human: hello?"), (None, None, None), (2, 5, ""), (3, None, "System: be kind"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, text string, role string")
    got = {(r.conv_id, r.turn): r for r in chat.parse(df).collect()}
    assert [got[1, t].role for t in range(4)] == ["user", "assistant", "user", "assistant"]
    assert got[1, 1].rendered == "<|assistant|>\nAn answer.\nMore of it." and got[1, 1].n_turns == 1
    assert got[1, 3].copies == 2 and got[3, None].role == "system" and got[None, 0].role == "user"
    assert chat.parse(df.limit(0)).count() == 0


# -- decontamination ----------------------------------------------------------------------------


def _tiles(item, doc, least):
    """Greedy string tiling by trying all matches."""
    free_i, free_d, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and free_i[i + n] and free_d[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        if best[0] < least:
            return out
        n, i, d = best
        free_i[i: i + n] = [False] * n
        free_d[d: d + n] = [False] * n
        out.append(best)


def test_tiles_equal_brute_force():
    rng = random.Random(16)
    for _ in range(60):
        item = np.array([rng.randrange(4) for _ in range(rng.randrange(0, 40))], np.uint64)
        doc = np.array([rng.randrange(4) for _ in range(rng.randrange(0, 60))], np.uint64)
        got, want = decontam.tile(item, doc, 3), _tiles(item.tolist(), doc.tolist(), 3)
        assert got == want


def test_contaminated_documents(spark):
    rng = random.Random(17)
    items = [(i, text(rng, 24)) for i in range(5)] + [(9, "too short"), (10, None), (None, text(rng, 30)), (3, "") , (0, None)]
    items.append(items[1])
    w = items[2][1].split()
    moved = " ".join(w[12:]) + " " + text(rng, 9, 10**9) + " " + " ".join(w[:12])
    rows = [
        (1, text(rng, 50) + " " + items[0][1].upper().replace(" ", ", ") + "." + text(rng, 50)), (2, moved), (3, " ".join(w[:8]) + text(rng, 80)),
        (4, None), (5, ""), (6, text(rng, 3000, 10**9) + " " + items[3][1]), (None, items[4][1]), (7, items[1][1] + " " + items[7][1]), (7, items[1][1] + " " + items[7][1]),
        (8, text(rng, 200)),
    ]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(frame(spark, rows), bench).collect()}
    assert set(got) == {(1, 0), (2, 2), (6, 3), (None, 4), (7, 1), (7, None)}
    assert got[2, 2].n_tiles == 2 and got[2, 2].coverage == 1.0 and got[2, 2].longest == 12
    assert decontam.contaminated(frame(spark, []), bench).count() == 0
    assert decontam.contaminated(frame(spark, rows), bench.limit(0)).count() == 0


def test_equal_tokens_are_tiled_in_linear_work():
    ones = [np.ones(n, np.uint64) for n in (20_000, 200_000)]
    assert decontam.tile(*ones, 5) == [(20_000, 0, 0)]
    assert decontam._near(ones[1], ones[0], 5).tolist() == ones[1].tolist()


def test_pairs_on_rare_seeds_lose_nothing(spark):
    """Few different words, so that seeds are shared by many; against the tiling of all pairs."""
    rng = random.Random(18)
    stock = [text(rng, 6, 4) for _ in range(6)]

    def made(n):
        return " ".join(rng.choice(stock) if rng.random() < 0.7 else text(rng, 4, 10**6) for _ in range(n))

    items, docs = [(i, made(rng.randrange(1, 6))) for i in range(25)], [(i, made(rng.randrange(1, 9))) for i in range(40)]
    hashed = [[decontam.token_hashes.func(pa.array([t])).to_pylist()[0] for _, t in rows] for rows in (items, docs)]
    want = {}
    for i, one in enumerate(hashed[0]):
        for d, many in enumerate(hashed[1]):
            tiles = decontam.tile(np.array(one, np.int64).view(np.uint64), np.array(many, np.int64).view(np.uint64), 5)
            if 2 * sum(t[0] for t in tiles) >= len(one):
                want[d, i] = (sum(t[0] for t in tiles), len(tiles))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.covered, r.n_tiles) for r in decontam.contaminated(frame(spark, docs), bench).collect()}
    assert got == want and len(want) > 20


def test_a_phrase_common_to_all_pairs_nothing(spark):
    rng = random.Random(19)
    rows = [(i, f"{text(rng, 30, 10**9)} which of the following is {text(rng, 30, 10**9)}") for i in range(300)]
    items = [(i, f"{text(rng, 8, 10**9)} which of the following is {text(rng, 12, 10**9)}") for i in range(60)]
    rows.append((1000, rows[0][1] + " " + items[7][1]))
    got = decontam.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.item_id, r.covered) for r in got] == [(1000, 7, 25)]


def test_ranges_of_repeated_rows_come_once(spark):
    rng = random.Random(19)
    passage = text(rng, 80, 10**9)
    rows = [(1, passage)] + [(2, "before " + passage + " after")] * 200
    found = substrings.repeats(frame(spark, rows).repartition(8)).collect()
    assert [r.id for r in found] == [2]
    pairs = [(p.start, p.stop) for p in found[0].ranges]
    assert len(pairs) == len(set(pairs)) <= 82 * 82
    got = substrings.remove_repeats(frame(spark, rows)).where("doc_id = 2").select("__cut.*").collect()
    assert len(got) == 200 and {(r.n_words, r.n_removed, r.kept) for r in got} == {(82, 80, "before after")}


def test_kept_hash_is_of_the_joined_words(spark):
    row = substrings.remove_repeats(frame(spark, [(1, " a\tb  ")])).select(F.sha2("__cut.kept", 256).alias("h")).first()
    assert row["h"] == hashlib.sha256(b"a b").hexdigest()


def test_long_runs_are_encoded_as_the_pattern_has_them(spark):
    with open(VOCABULARY, "rb") as f:
        encoder = tokens.Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    for t in (" " * 3000, "a" + " " * 3000 + "b", "\n" * 2500 + "x", " \n\t" * 1500 + "y z", ("x" + " " * 1500) * 3, "a b" + "\r\n" * 1000, "　" * 1200 + ".", ""):
        assert encoder.encode(t) == encoder.parts.encode_ordinary(t)
    rows = [(1, " " * 2_000_000), (2, "\n" * 1_500_000 + "x"), (3, "a" * 500_000), (4, "1" * 500_000), (5, " \n word" * 200_000)]
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(frame(spark, rows)).collect()}
    assert got == {i: len(encoder.encode(t)) for i, t in rows}


def test_repeated_keys_give_one_training_row(spark):
    rows, labels = _toxic_table(60)
    rows += [(0, f"copy {i} of a key") for i in range(500)]
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    texts, kinds, _ = toxicity.training_rows(frame(spark, rows), known, F.lit(True))
    assert len(texts) == len(kinds) == 60
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "fr") for i, t in rows], "doc_id bigint, text string, lang string")
    windows, label, names = language.training_windows(docs, F.lit(True))
    assert names == ["en", "fr"] and len(windows) == len(label) <= 60 * language.WINDOWS_PER_TEXT
