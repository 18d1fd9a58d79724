"""Merkle manifest, harmonic packing and collocations against brute force, and their defined edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from registra.llm import collocations, merkle, packing, queries

EXTRA = "doc_id bigint, text string, source string, lang string, n_chars bigint, gid string, idx string, h string, key string, k string"


def documents(spark, rows):
    """Rows of (doc_id, text, source, lang) with extra columns whose names clash with those operators make."""
    return spark.createDataFrame([(i, t, s, g, len(t or ""), "x", "x", "x", "x", "x") for i, t, s, g in rows], EXTRA)


def stored(spark, tmp_path, rows):
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


# -- Merkle manifest ----------------------------------------------------------------------------


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(leaves, arity):
    """Root and, for each leaf, its siblings on the left and on the right of every level."""
    paths, level, owners = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        above, held = [], []
        for start in range(0, len(level), arity):
            run = level[start: start + arity]
            for slot in range(len(run)):
                for leaf in owners[start + slot]:
                    paths[leaf].append((run[:slot], run[slot + 1:]))
            above.append(_h("".join(run)))
            held.append([x for o in owners[start: start + arity] for x in o])
        level, owners = above, held
    return level[0], paths


def _manifest(rows, arity=3):
    """Contract of the query for rows of (doc_id, text, source, lang)."""
    def leaf(i, t, s, g, n):
        return _h("".join(map(_field, (i, s, g, n, t))))

    def seen(i, t):
        return t.replace("\n", "") if i is not None and t is not None and zlib.crc32(str(i).encode()) % 2 == 0 else t

    made = [(s, i, leaf(i, t, s, g, len(t or "")), leaf(i, seen(i, t), s, g, len(t or ""))) for i, t, s, g in rows]
    order = lambda x: (x[0] is not None, (x[0] or "").encode(), x[1] is not None, x[1] or 0, x[2])
    groups = {}
    for r in sorted(made, key=order):
        groups.setdefault(r[0], []).append(r)
    trees = {s: _tree([r[2] for r in rs], arity) for s, rs in groups.items()}
    root, upper = _tree([trees[s][0] for s in groups], arity)
    out = []
    for g, (s, rs) in enumerate(groups.items()):
        for at, r in enumerate(rs):
            path = trees[s][1][at] + upper[g]
            folded = r[3]
            for left, right in path:
                folded = _h("".join(left) + folded + "".join(right))
            proof = _h("".join(x for left, right in path for x in left + right))
            out.append((r[1], r[2], trees[s][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


def _documents(n, seed=1):
    rng = random.Random(seed)
    rows = [(i, "line\nnext é" * rng.randrange(3), rng.choice(["hot", "hot", "b", "ä", None]), "en") for i in range(n)]
    rows += [(3, None, "hot", None), (3, None, "hot", None), (None, "a\nb", "hot", "en"), (None, "a\nb", None, "en"), (-7, "x\n", "single", "en"), (10**12, "", "", "")]
    return rows


@pytest.mark.parametrize("n", [0, 1, 40, 200])
def test_manifest_equals_brute_force(spark, tmp_path, n):
    rows = _documents(n) if n != 1 else [(5, "a\nb", None, None)]
    got = queries.QUERIES["op12_merkle_manifest"](spark, stored(spark, tmp_path, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == _manifest(rows)


def test_manifest_of_empty_table(spark, tmp_path):
    assert queries.QUERIES["op12_merkle_manifest"](spark, stored(spark, tmp_path, [])).count() == 0


@pytest.mark.parametrize("arity", [2, 4])
def test_manifest_of_other_arity(spark, arity):
    rows = _documents(60, 2)
    leaf = merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    got = merkle.manifest(documents(spark, rows), "doc_id", "source", leaf, arity=arity)
    got = got.select("doc_id", F.lower(F.hex("root")), merkle.proof_digest(F.col("path")), (merkle.folded_root(F.col("leaf"), F.col("path")) == F.col("root")))
    want = [(r[0], r[3], r[4], True) for r in _manifest(rows, arity)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_long_text_has_a_leaf(spark, tmp_path):
    rows = [(1, "word \n" * 1_000_000, "a", "en"), (2, "b", "a", "en")]
    got = queries.QUERIES["op12_merkle_manifest"](spark, stored(spark, tmp_path, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == _manifest(rows)


# -- harmonic packing ---------------------------------------------------------------------------


def test_class_ends():
    for capacity in (8, 100, 1024):
        ends = {capacity // k for k in range(1, capacity + 1)}
        for length in range(1, capacity + 1):
            assert packing.class_end(length, capacity) == max(e for e in ends if e <= length)
        assert [sum(c) for c in packing.rest_lengths(capacity)] == list(range(capacity))


def test_first_fit_keeps_the_capacity():
    left = {n: 1024 // n - 1 for n in {1024 // k for k in range(1, 1025)}}
    places, count = packing.first_fit(left, 1024)
    fill = np.zeros(count, int)
    for length, _, s, offset in places:
        assert offset == fill[s]
        fill[s] += length
    assert fill.max() <= 1024 and len(places) == sum(left.values()) and count <= -(-fill.sum() // 1024) + 1


def test_parts_are_encoded_alike(monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.VOCABULARY)
    rng = random.Random(3)
    alphabet = ["word", " ", "  ", "\n", "é", "'s", "!", "12", " ", "<|endoftext|>", "\xa0", "\u3000", "\x1c", "日本", "ß ", "\u2009 ", "🙂", "\x7f", "\x85 "]
    texts = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (3000, 0, 1, 7, 400, 9000)]
    texts += [None, "", " ", "a" * 500, " " * 500 + "b", "tail ", " x", "\n\n  y"]
    with open(packing.VOCABULARY, encoding="utf-8") as f:
        vocabulary = f.read()
    for at_once in (1 << 21, 64):
        monkeypatch.setattr(packing, "READ_AT_ONCE", at_once)
        got = list(packing._Encoder(vocabulary).rows(pa.array(texts)))
        assert [x.tolist() for x in got] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma\n", "δ"]) for _ in range(rng.randrange(0, 900))), "s", "en") for i in range(60)]
    rows += [(100, None, "s", "en"), (101, "", "s", "en"), (102, "long words " * 200_000, "s", "en"), (103, " " * 300_000, "s", "en"), (104, "x" * 20_000, "s", "en"), (None, "no key", "s", "en")]
    docs = documents(spark, rows).repartition(5)
    packed = packing.pack(docs)
    got = packed.collect()
    encoder = Tokenizer.from_file(packing.VOCABULARY)
    whole, fill = {}, {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"]
        whole.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t, _, _ in rows:
        pieces = sorted(whole[i])
        ids = [x for p in pieces for x in p[1]]
        assert ids == encoder.encode(t or "", add_special_tokens=False).ids + [0]
        assert [p[0] for p in pieces] == np.cumsum([0] + [len(p[1]) for p in pieces])[:-1].tolist()
        assert {p[2] for p in pieces} == {len(ids)}
    assert sorted(fill) == list(range(len(fill)))
    padding = 0
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 1024 - at
    assert padding < 0.01 * sum(len(p[1]) for ps in whole.values() for p in ps) + 1024
    first = packing.sequences(packed).where("sequence_id = 0").first()
    assert len(first["ids"]) == 4 * sum(n for _, n in fill[0]) and first["starts"] == sorted(o for o, _ in fill[0])


def test_packing_repeats_and_no_rows(spark):
    docs = documents(spark, [(1, "one two", "s", "en")] * 7)
    got = packing.pack(docs, capacity=4).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got) and sum(r["length"] for r in got) == 21
    assert packing.pack(documents(spark, [])).count() == 0


# -- collocations -------------------------------------------------------------------------------


def _collocations(rows, support, longest, kept):
    counts, totals = {}, {}
    for _, t, _, g in rows:
        g = g or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            totals[g] = totals.get(g, 0) + len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = g, tuple(w[i: i + k])
                    counts[key] = counts.get(key, 0) + 1
    counts = {k: v for k, v in counts.items() if v >= support}
    best = {}
    for (g, w), a in counts.items():
        if len(w) < 2 or any(
            len(o) > len(w) and h == g and any(o[i: i + len(w)] == w for i in range(len(o) - len(w) + 1)) and 100 * b >= 100 * a for (h, o), b in counts.items()
        ):
            continue
        cuts = [(1000 * a * totals[g] // (counts[g, w[:k]] * counts[g, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        best.setdefault(g, []).append((-score, -a, " ".join(w).encode(), counts[g, w[:k]], counts[g, w[k:]]))
    out = []
    for g, found in best.items():
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:kept], 1):
            out.append((g, rank, p.decode(), -a, left, right, totals[g], -score))
    return sorted(out)


@pytest.mark.parametrize("support,kept", [(3, 1000), (12, 5)])
def test_collocations_equal_brute_force(spark, support, kept):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        words = [rng.choice(["The", "cat", "sat", "on", "mat", "é", "New", "York", "x-y"]) + rng.choice(["", "", "", ".", ",", "\n", "  ", "\t"]) for _ in range(rng.randrange(0, 25))]
        rows.append((i, " ".join(words), "s", rng.choice(["en", "en", "en", "fr", None, "und"])))
    rows += [(1, None, "s", "en"), (None, "", None, None), (7, "the cat sat on the mat " * 30, "s", "fr")] + [(9, "same copy of the words", "s", "en")] * 60
    got = collocations.collocations(documents(spark, rows), support=support, kept=kept)
    assert sorted(map(tuple, got.collect())) == _collocations(rows, support, 5, kept)


def test_collocations_of_no_rows(spark):
    assert collocations.collocations(documents(spark, [])).count() == 0
    assert collocations.collocations(documents(spark, [(1, None, "s", None)])).count() == 0


def test_sections_and_blocks_lose_no_word(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["a", "bb", "ccc.", "d,d"]) for _ in range(n)) for n in (0, 3, 4000, 1, 9000)] + ["z" * 5000, None]

    def phrases(slice_bytes, held):
        monkeypatch.setattr(collocations, "SLICE_BYTES", slice_bytes)
        monkeypatch.setattr(collocations, "HELD_WORDS", held)
        column, out = pa.array(texts), []
        if slice_bytes < 1000:
            monkeypatch.setattr(collocations, "slices", lambda c: ((i, i + 1, *collocations_utf8(c.slice(i, 1))) for i in range(len(c))))
        for block in collocations._blocks(column, True):
            for k in (1, 3, 5):
                at = block.starts(k)
                for i in at[at < block.stop]:
                    out.append((int(block.row[i]), tuple(block.texts[int(i + j)].as_py() for j in range(k))))
        return sorted(out)

    from registra.llm.words import utf8 as collocations_utf8

    whole = phrases(1 << 20, 1 << 20)
    assert whole == phrases(1 << 20, 700) == phrases(300, 700)


def test_scores_are_exact(spark):
    a, n, left, right = 123_456_789_012, 98_765_432_109_876, 223_456_789_013, 323_456_789_017
    rows = [("en", "p q", a), ("en", "p", left), ("en", "q", right), ("en", None, n)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, n bigint")).first()
    assert got["score"] == 1000 * a * n // (left * right) and (got["l"], got["r"], got["n"]) == (left, right, n)


def test_collocations_of_a_long_text(spark):
    text = "to be or not to be " * 60_000
    got = collocations.collocations(documents(spark, [(1, text, "s", "en")])).collect()
    assert {(r["phrase"], r["a"], r["n"]) for r in got} >= {("be or not to be", 60_000, 360_000)}
