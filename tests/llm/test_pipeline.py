"""Each stage of the pipeline against brute force on what the stage before kept, and the whole run."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_operators import WORD, _print, _removed, _toxic_table, _union, text

import corpus_pipeline as pipeline
from registra.llm import decontam

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "taken", "id"]


def _write(folder, docs, labels, bench):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()),
        ("taken", pa.string()), ("id", pa.string()),
    ])
    pq.write_table(pa.Table.from_pylist([dict(zip(COLUMNS, d)) for d in docs], schema), folder / "documents.parquet")
    keys = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
    pq.write_table(pa.Table.from_pylist([{"doc_id": i, "toxic": t} for i, t in labels], keys), folder / "labels.parquet")
    items = pa.schema([("item_id", pa.int64()), ("text", pa.string())])
    pq.write_table(pa.Table.from_pylist([{"item_id": i, "text": t} for i, t in bench], items), folder / "benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    rng = random.Random(40)
    rows, labels = _toxic_table(300)
    bench = [(i, text(rng, 24, 10**6)) for i in range(3)] + [(7, None), (None, "too short")]
    whole, passage = text(rng, 200, 10**6), text(rng, 60, 10**6)
    rows += [
        (500, whole), (501, whole), (502, whole), (None, whole),
        (510, f"{text(rng, 40, 10**6)} {passage} {text(rng, 30, 10**6)}"), (511, f"{text(rng, 70, 10**6)}\n{passage}"),
        (520, f"{text(rng, 50, 10**6)} {bench[1][1]}"), (521, " ".join(bench[2][1].split()[:7]) + " " + text(rng, 60, 10**6)),
        (530, None), (531, ""), (None, ""), (None, text(rng, 30, 10**6)), (540, "repeated row of a few words"),
        (540, "repeated row of a few words"), (550, text(rng, 20_000, 10**6)),
    ]
    docs = [(i, t, "en", [None, "b", "a"][n % 3], None if t is None else len(t), "x", "y") for n, (i, t) in enumerate(rows)]
    return _write(tmp_path_factory.mktemp("planted"), docs, labels, bench), dict(labels), bench


def _rows(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


def test_stages_and_run(spark, planted):
    folder, labels, bench = planted
    docs = pipeline.table(spark, folder, "documents")
    results = []
    for name, stage in pipeline.STAGES:
        docs = pipeline.written(stage(spark, docs, folder), name)
        results.append(docs)
    before = _rows(pipeline.table(spark, folder, "documents"))
    kept, single, cut, clean = [_rows(d) for d in results[:4]]
    for d in results[:4]:
        assert d.columns == COLUMNS

    # toxicity: rows go, none changes
    assert not Counter(kept) - Counter(before)
    gone = Counter(before) - Counter(kept)
    toxic = sum(labels.values())
    assert sum(labels.get(r[0], 0) for r in gone.elements()) >= 0.95 * toxic
    assert sum(not labels.get(r[0], 0) for r in gone.elements()) <= 2

    # near duplicates: one row of each class of fingerprints, with the least key
    prints = [_print(r[1]) for r in kept]
    linked = _union((a, b) for a, b in itertools.combinations_with_replacement(set(prints), 2) if (a ^ b).bit_count() <= 4)
    least = {}
    for r, f in zip(kept, prints):
        if r[0] is not None:
            least[linked[f]] = min(least.get(linked[f], r[0]), r[0])
    assert not Counter(single) - Counter(kept)
    classes = [linked[_print(r[1])] for r in single]
    assert sorted(classes) == sorted({linked[f] for f in prints})
    assert all(r[0] == least.get(c) for r, c in zip(single, classes))

    # repeated passages: texts change, no row goes
    want = Counter()
    for r, (_, _, lost, left) in zip(single, _removed([r[:2] for r in single], 50)):
        want[(r[0], left if lost else r[1], *r[2:4], len(left) if lost else r[4], *r[5:])] += 1
    assert Counter(cut) == want
    assert [len(WORD.findall(r[1])) for r in cut if r[0] == 511] == [70]

    # benchmark passages: by tiling all pairs
    def tokens(t):
        return np.array(decontam.token_hashes.func(pa.array([t], pa.string())).to_pylist()[0], np.int64).view(np.uint64)

    items = [i for i in (tokens(t) for _, t in bench) if len(i) >= 5]
    covers = {r: any(2 * sum(t[0] for t in decontam.tile(i, tokens(r[1]), 5)) >= len(i) for i in items) for r in set(cut)}
    assert Counter(clean) == Counter(r for r in cut if not covers[r])
    assert 520 not in {r[0] for r in clean} and 521 in {r[0] for r in clean}

    # mix: every document with its text, whole copies, at most two, near the targets
    mixed = results[4].collect()
    assert results[4].columns == [c for c in COLUMNS if c not in pipeline.MIXED] + list(pipeline.MIXED)
    assert Counter((r.doc_id, r.text, r.source) for r in mixed) == Counter((r[0], r[1], r[3]) for r in clean)
    for source in {r.source for r in mixed}:
        own = [r for r in mixed if r.source == source]
        sizes = [len(WORD.findall(r.text or "")) for r in own]
        assert [r["size"] for r in own] == sizes and {r.source_size for r in own} == {sum(sizes)}
        assert all(r.taken <= 2 * n and (r.taken % n == 0 if n else r.taken == 0) for r, n in zip(own, sizes))
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(sizes) / 2 + 1

    assert Counter(pipeline.run(spark, folder).collect()) == Counter(mixed)


def test_run_on_empty_tables(spark, tmp_path):
    assert pipeline.run(spark, _write(tmp_path, [], [], [])).count() == 0


def test_mix_keeps_repeated_and_null_keys(spark, tmp_path):
    docs = [(None, "a b c", "en", None, 5, "x", "y")] * 3 + [(1, "a b c", "en", None, 5, "x", "y"), (1, "d e f", None, None, 5, "x", "y"), (2, None, None, None, None, None, None)]
    folder = _write(tmp_path, docs, [], [])
    got = pipeline.source_mix(spark, pipeline.table(spark, folder, "documents"), folder).collect()
    assert Counter((r.doc_id, r.text, r.lang) for r in got) == Counter(d[:3] for d in docs)
