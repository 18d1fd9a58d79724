"""From raw snapshots to search, step by step on one small registry."""

import json

from pyspark.sql import functions as F

from registra.operators import changes, cleaning, context, graph, metrics, retrieval
from registra.operators.filters import FilterSpec
from registra.sources import snapshots, tables
from registra.sources.tables import KEY
from registra.streaming.incremental import embed_incremental

TOPICS = ("лазерная физика", "морская биология", "квантовая химия")


def _card(i, year, note):
    topic = TOPICS[i % 3]
    return {
        "registration_number": f"r{i}", "name": f"Проект {i}: {topic}",
        "annotation": f"{topic}, исследование {note}", "start_date": f"{year}-03-0{i % 9 + 1}",
        "keyword_list": [topic.upper(), "наука", ""], "nioktr_types": ["Прикладное"],
        "budgets": [{"funds": str(1000 * i)}, {"funds": "n/a"}], "stages": [{"n": 1}] * (i % 4),
        "executor": {"name": f"ФГБОУ ВО «Казанский институт {i % 4}»", "ogrn": str(i % 4)},
        "work_supervisor": {"surname": f"Иванов{i % 2}", "name": None, "patronymic": "Петрович"},
        "reports_number": "Нет",
    }


def test_from_snapshots_to_answers(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "2020.json").write_text(json.dumps({"cards": [_card(i, 2020, "раз") for i in range(12)]}))
    (raw / "2021.json").write_text(json.dumps([_card(i, 2021, "два") for i in range(6, 20)]))

    cards = snapshots.read_snapshots(spark, str(raw), partitions=4)
    tables.write_clean(cleaning.clean_records(cards), str(tmp_path / "clean"), ["year"])
    clean = tables.read_clean(spark, str(tmp_path / "clean"))
    assert clean.count() == 20 and clean.groupBy(KEY).count().where("count > 1").count() == 0
    row = clean.where(f"{KEY} = 'r7'").first()
    assert (row.year, row.budget_total_thousands, row.stages_count) == (2021, 7000.0, 3)
    assert row.keyword_list == "МОРСКАЯ БИОЛОГИЯ; наука" and row.supervisor_full_name == "Иванов1  Петрович"
    assert row.reports_number is None

    assert tables.load_table(cleaning.truncate_text(clean), "registra_life", str(tmp_path / "t")) == 20
    projects = spark.table("registra_life")
    found = FilterSpec(year=2021, search="морская, лазерная", institution="казанский").apply(projects)
    assert found.count() == sum(i % 3 != 2 for i in range(6, 20))
    assert metrics.count_by_year(projects).where("year = 2020").first()["count"] == 6

    nodes, edges = graph.institution_graph(projects, at_least=2, limit=10)
    assert nodes.count() == 4 and nodes.first()["label"].startswith("Казанский институт")
    assert edges.count() == 0  # odd and even institutions share one supervisor each, not two
    words, pairs = graph.topic_graph(projects, 10)
    assert words.orderBy(F.desc("count")).first()["id"] == "наука"
    assert pairs.where("source = 'лазерная физика'").first()["weight"] == 7

    store = str(tmp_path / "store")
    tables.empty_vector_table(spark).write.parquet(store)
    assert tuple(embed_incremental(projects, store, retrieval.hashing_encoder).first()) == (0, 20)
    more = projects.limit(1).select(
        F.lit("new").alias(KEY), F.lit("n").alias("name"), F.lit("лазерная физика").alias("annotation"),
        F.lit(1).alias("seq"))
    grown, conflicts = changes.apply_inserts(projects, more, "seq")
    assert conflicts.count() == 0
    assert tuple(embed_incremental(grown, store, retrieval.hashing_encoder).first()) == (20, 21)

    question = retrieval.questions_from(
        spark, {"q": "лазерная физика"}, retrieval.hashing_encoder())
    hits = retrieval.retrieve_context(spark.read.parquet(store), grown, question)
    best = hits.orderBy("rank").first()
    assert best[KEY] == "new" and best["similarity"] == 1.0
    prompt = context.build_prompts(context.build_context(hits), question).first()["prompt"]
    assert prompt.count("Проект: ") == 5 and "Запрос: лазерная физика" in prompt
    left, _ = changes.apply_deletes(grown, more)
    assert retrieval.retrieve_context(spark.read.parquet(store), left, question).where(
        f"{KEY} = 'new'").count() == 0
