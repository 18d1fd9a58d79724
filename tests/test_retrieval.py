"""Vectors, search, context."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from registra.operators import context, retrieval
from registra.sources.tables import KEY
from registra.streaming.incremental import embed_incremental


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(120, 8))
    m[40:80] = m[40]  # a third of the records are copies of one
    m[7] = 0.0
    rows = [(f"k{i:03d}", [float(x) for x in v], f"text {i}") for i, v in enumerate(m)]
    store = spark.createDataFrame(
        rows, "registration_number string, embedding array<double>, source_text string").repartition(5)
    questions = store.select(F.col(KEY).alias("question_id"), "embedding")
    return store, questions, {r[0]: np.array(r[1]) for r in rows}


def _brute(data, k):
    hits = {}
    for q, a in data.items():
        scored = []
        for key, b in data.items():
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            scored.append((-round(float(a @ b) / norm, 9) if norm else np.inf, key))
        hits[q] = [key for _, key in sorted(scored)[:k]]
    return hits


def _hits(df):
    out = {}
    for r in df.orderBy("question_id", "rank").collect():
        out.setdefault(r.question_id, []).append(r[KEY])
    return out


@pytest.mark.parametrize("k", [1, 5, 50])
def test_nearest_against_brute_force(vectors, k):
    store, questions, data = vectors
    assert _hits(retrieval.nearest(store, questions, k)) == _brute(data, k)


def test_question_tables_are_checked(spark, vectors, monkeypatch):
    store, questions, data = vectors
    with pytest.raises(ValueError):
        retrieval.nearest(store, questions.union(questions.limit(1)), 5)
    lost = questions.withColumn("embedding", F.when(F.col("question_id") != "k003", F.col("embedding")))
    hits = retrieval.nearest(store, lost, 5)
    assert [r.question_id for r in retrieval.unanswered(lost, hits).collect()] == ["k003"]
    short = spark.createDataFrame([("x", [1.0])], "question_id string, embedding array<double>")
    with pytest.raises(Exception, match="a question 1"):
        retrieval.nearest(store, short, 5).collect()
    monkeypatch.setattr(retrieval, "MAX_SENT_QUESTIONS", 13)
    with pytest.raises(ValueError):
        retrieval.nearest(store, questions, 5)


def test_any_number_of_questions(spark, vectors, tmp_path, monkeypatch):
    store, questions, data = vectors
    live = store.where(f"{KEY} != 'k007'")
    index = retrieval.build_ivf(live, lists=6).save(str(tmp_path / "ivf"))
    projects = store.select(
        KEY, F.lit("n").alias("name"), F.lit(2020).alias("year"), F.lit("o").alias("executor_name"))
    exact = _hits(retrieval.nearest(live, questions, 5))
    monkeypatch.setattr(retrieval, "MAX_SENT_QUESTIONS", 13)
    assert _hits(retrieval.nearest_to_all(store, questions, 5)) == _brute(data, 5)
    assert _hits(retrieval.retrieve_context(store, projects, questions)) == _brute(data, 5)
    assert _hits(retrieval.ivf_search(index, questions, 5, probes=6)) == exact
    lost = questions.withColumn("embedding", F.when(F.col("question_id") != "k003", F.col("embedding")))
    hits = retrieval.nearest_to_all(store, lost, 5)
    assert [r.question_id for r in retrieval.unanswered(lost, hits).collect()] == ["k003"]
    for odd in (questions.limit(1), questions.limit(1).withColumn("question_id", F.lit(None).cast("string"))):
        with pytest.raises(ValueError, match="id of its own"):
            retrieval.nearest_to_all(store, questions.union(odd), 5)


def test_blocks_of_questions_take_one_scan(spark, vectors, monkeypatch):
    store, questions, data = vectors
    monkeypatch.setattr(retrieval, "HELD_NUMBERS", 100)
    assert _hits(retrieval.nearest_to_all(store, questions, 5)) == _brute(data, 5)
    monkeypatch.setattr(retrieval, "MAX_SENT_QUESTIONS", 13)
    asked, scans = retrieval._Asked.of, []
    scan = retrieval._scan
    monkeypatch.setattr(retrieval, "_scan", lambda *a: scans.append(a) or scan(*a))
    assert _hits(retrieval.nearest_to_all(store, questions, 5)) == _brute(data, 5)
    assert len(scans) == 1 and asked(questions).blocks == 10


@pytest.mark.parametrize("sent", [2_000, 13])
def test_bounded_search_is_exact(spark, vectors, tmp_path, monkeypatch, sent):
    store, questions, data = vectors
    live = store.where(f"{KEY} != 'k007'")
    monkeypatch.setattr(retrieval, "MAX_SENT_QUESTIONS", sent)
    index = retrieval.build_ivf(live, lists=12).save(str(tmp_path / "ivf"))
    for k in (1, 5, 50):
        exact = retrieval.nearest_to_all(live, questions, k)
        assert _hits(retrieval.bounded_search(index, questions, k, probes=1)) == _hits(exact)


def test_radii_bound_every_cell(spark, vectors):
    store, _, data = vectors
    index = retrieval.build_ivf(store.where(f"{KEY} != 'k007'"), lists=12)
    unit = {k: v / np.linalg.norm(v) for k, v in data.items() if np.linalg.norm(v)}
    ids = sorted(unit)
    most = index.most_similar(np.stack([unit[i] for i in ids]))
    for r in index.records.select(KEY, "cell").collect():
        for q, i in enumerate(ids):
            assert unit[i] @ unit[r[KEY]] <= most[q, r["cell"]] + 1e-9


def test_ivf_with_all_probes_is_exact(spark, vectors, tmp_path, capsys):
    store, questions, data = vectors
    live = store.where(f"{KEY} != 'k007'")
    index = retrieval.build_ivf(live, lists=6).save(str(tmp_path / "ivf"))
    exact = retrieval.nearest(live, questions, 5)
    full = retrieval.ivf_search(index, questions, 5, probes=6)
    assert _hits(full) == _hits(exact)
    assert retrieval.recall(full, exact).first()["recall"] == 1.0
    assert 0 < retrieval.recall(retrieval.ivf_search(index, questions, 5, 1), exact).first()["recall"] <= 1
    retrieval.ivf_search(index, questions.limit(1), 5, 1).explain()
    assert "PartitionFilters: [isnotnull(cell" in capsys.readouterr().out


def test_search_skips_vectors_without_project(spark, vectors):
    store, questions, _ = vectors
    projects = store.where(f"{KEY} >= 'k010'").select(
        KEY, F.lit("n").alias("name"), F.lit(2020).alias("year"), F.lit("o").alias("executor_name"))
    one = questions.where("question_id = 'k003'")
    loose = store.union(store.limit(1).withColumn(KEY, F.lit(None).cast("string")))
    assert retrieval.with_records(loose, projects).count() == 110
    best = retrieval.retrieve_context(loose.orderBy(KEY), projects, one, 1)
    assert best.count() == 1  # a vector without a key takes no rank
    hits = retrieval.retrieve_context(store, projects, one)
    assert hits.count() == 5 and hits.where(f"{KEY} < 'k010'").count() == 0
    none = retrieval.retrieve_context(store, projects.limit(0), one)
    assert retrieval.unanswered(one, none).count() == 1


def test_zero_vector_comes_last_without_score(vectors):
    store, questions, _ = vectors
    hits = retrieval.nearest(store, questions.where("question_id = 'k000'"), 50)
    few = retrieval.nearest(store.where(f"{KEY} in ('k007', 'k000')"), questions.where("question_id = 'k000'"), 5)
    assert [(r[KEY], r.score) for r in few.orderBy("rank").collect()] == [("k000", 1.0), ("k007", None)]
    assert hits.count() == 50


def test_source_texts(spark):
    df = spark.createDataFrame(
        [("1", "ground", "ann"), ("2", None, "x" * 3000), (" ", "t", "t"), (None, "t", "t"), ("3", "  ", "ann")],
        "registration_number string, scientific_groundwork string, annotation string")
    got = {r[0]: r[1] for r in retrieval.source_texts(df).collect()}
    assert got == {"1": "ground", "2": "x" * 3000}
    assert {len(r[1]) for r in retrieval.source_texts(df, retrieval.TEXT_CUT).collect()} == {6, 2000}
    assert retrieval.source_texts(df.drop("scientific_groundwork", "annotation")).count() == 0


def test_embedding_resumes(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([(str(i), f"note {i}") for i in range(30)], "registration_number string, annotation string")
    from registra.sources.tables import check_vector_table, empty_vector_table

    empty_vector_table(spark).write.parquet(path)
    assert tuple(embed_incremental(df.limit(10), path, retrieval.hashing_encoder).first()) == (0, 10)
    assert tuple(embed_incremental(df, path, retrieval.hashing_encoder).first()) == (10, 30)
    assert tuple(embed_incremental(df, path, retrieval.hashing_encoder).first()) == (30, 30)
    assert tuple(check_vector_table(spark.read.parquet(path), 384).first()) == (30, 0, 0, 0)
    encoder = retrieval.hashing_encoder()
    question = retrieval.questions_from(spark, {"q": "note 17"}, encoder)
    assert retrieval.nearest(spark.read.parquet(path), question, 1).first()[KEY] == "17"


def test_context_and_prompt(spark):
    hits = spark.createDataFrame(
        [("q", 2, "B", None, "Org", "b" * 700), ("q", 1, "A", 2020, None, None)],
        "question_id string, rank int, name string, year int, institution string, source_text string")
    out = context.build_context(hits)
    text = ("Проект: A\nГод: 2020 | Организация: None\nОписание: \n\n---\n\n"
            "Проект: B\nГод: None | Организация: Org\nОписание: " + "b" * 600)
    assert out.first()["context"] == text
    questions = spark.createDataFrame([("q", "Что нового?")], "question_id string, question string")
    prompt = context.build_prompts(out, questions).first()["prompt"]
    assert prompt.startswith("Ты — опытный") and prompt.endswith("\n\nАнализ:")
    assert f"Запрос: Что нового?\n\nДанные о проектах:\n\n{text}" in prompt


def test_project_brief_defaults(spark):
    df = spark.createDataFrame(
        [("", "k1", None, None, None, None), ("N", "k2", 1250.0, 2021, "Org", "a; b;c;d")],
        "name string, key string, budget double, year int, institution string, keywords string")
    got = [r[0] for r in df.select(context.project_brief(*[F.col(c) for c in df.columns])).collect()]
    assert 'project: "k1". \nBudget: unknown. \nYear: unknown.\nInstitution: unknown.\nFocus: general research.' in got[0]
    assert "Budget: 1.3 million RUB. \nYear: 2021.\nInstitution: Org.\nFocus: a,  b, c." in got[1]


def test_allowed_cells_are_spread_out_part_by_part(monkeypatch):
    """200 questions and 60,000 records would make 12 MB of flags at once."""
    import tracemalloc

    monkeypatch.setattr(retrieval, "MAX_PRODUCTS", 100_000)
    random = np.random.default_rng(3)
    vectors, questions = (retrieval._unit_rows(random.normal(size=(n, 4))) for n in (60_000, 200))
    keys = np.array([f"{i:05d}" for i in range(len(vectors))], dtype=object)
    cells, allowed = random.integers(0, 8, len(vectors)), random.random((200, 8)) < 0.4
    best = retrieval._TopK(questions, 3)
    tracemalloc.start()
    try:
        best.add(keys, vectors, cells, allowed)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 9_000_000
    sims = np.where(allowed[7, cells], np.round(vectors @ questions[7], retrieval.TIE_DIGITS), -2)
    assert sorted(best.keys[best.q == 7]) == sorted(keys[np.lexsort((keys, -sims))[:3]])
