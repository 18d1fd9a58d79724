"""Snapshots, cleaning, profiles, filters and changes."""

import datetime
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from registra.operators import changes, cleaning, filters, paging, profile
from registra.operators.filters import FilterSpec
from registra.sources import snapshots, tables
from registra.sources.tables import KEY


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- snapshots ----------------------------------------------------------------------------


@pytest.fixture()
def folder(tmp_path):
    def card(key, name, day, **more):
        return {"registration_number": key, "name": name, "start_date": day, **more}

    first = [card("k1", "old", "2020-05-01"), card("k2", "two", "2020-06-01")]
    second = [card("k1", "new", "2021-01-01", budgets=[{"funds": "10.5"}]),
              card("k1", "newest", "2021-02-01")]
    (tmp_path / "2020.json").write_text(json.dumps({"cards": first}, ensure_ascii=False))
    (tmp_path / "2021.json").write_text(json.dumps(second, ensure_ascii=False, indent=1))
    (tmp_path / "2022.json").write_text(json.dumps({"cards": []}))
    (tmp_path / "2023.json").write_text(json.dumps(card("k3", "alone", "2023-01-01")))
    (tmp_path / "notes.txt").write_text("not a snapshot")
    return str(tmp_path)


@pytest.mark.parametrize("schema", [
    None,
    "registration_number string, name string, start_date string, "
    "budgets array<struct<funds:string>>",
])
def test_read_snapshots(spark, folder, schema):
    from pyspark.sql import types as T

    given = T._parse_datatype_string(schema) if schema else None
    df = snapshots.read_snapshots(spark, folder, given)
    assert _rows(df.select(KEY, "name", "source_file")) == [
        ("k1", "new", "2021.json"), ("k1", "newest", "2021.json"), ("k1", "old", "2020.json"),
        ("k2", "two", "2020.json"), ("k3", "alone", "2023.json")]
    wide = snapshots.read_snapshots(spark, folder, given, partitions=6)
    assert wide.rdd.getNumPartitions() == 6
    last = cleaning.dedup_keep_last(wide).select(KEY, "name")
    assert _rows(last) == [("k1", "newest"), ("k2", "two"), ("k3", "alone")]


def test_read_json_lines_keeps_order(spark, tmp_path):
    lines = [json.dumps({"registration_number": "k", "n": i}) for i in range(50)]
    (tmp_path / "a.json").write_text("\n".join(lines))
    df = snapshots.read_snapshots(spark, str(tmp_path), lines=True)
    assert cleaning.dedup_keep_last(df).first()["n"] == 49


def test_folder_without_snapshots(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("nothing")
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshots(spark, str(tmp_path))


@pytest.mark.parametrize("lines", [False, True])
def test_broken_snapshot_is_an_error(spark, tmp_path, lines):
    (tmp_path / "a.json").write_text('{"registration_number": "1"}')
    (tmp_path / "b.json").write_text('{"registration_number": "2", ')
    from pyspark.sql import types as T

    schema = T._parse_datatype_string("registration_number string")
    with pytest.raises(Exception, match="MALFORMED"):
        snapshots.read_snapshots(spark, str(tmp_path), schema, lines).collect()


def test_flatten_and_union(spark):
    df = spark.sql("SELECT 1 AS a, named_struct('x', 2, 'y', named_struct('z', 3)) AS s")
    flat = snapshots.flatten_structs(df)
    assert flat.columns == ["a", "s_x", "s_y_z"] and tuple(flat.first()) == (1, 2, 3)
    both = snapshots.union_snapshots(flat, spark.sql("SELECT 9 AS a, 'w' AS extra"))
    assert _rows(both) == [(1, 2, 3, None), (9, None, None, "w")]


def test_tables(spark, tmp_path):
    df = spark.range(5).selectExpr("cast(id as string) AS registration_number")
    assert tables.load_table(df, "registra_test", str(tmp_path / "t")) == 5
    assert tables.table_ready(spark, "registra_test")
    assert not tables.table_ready(spark, "registra_none")
    assert tables.load_table(df.limit(0), "registra_test", str(tmp_path / "t")) == 0
    assert not tables.table_ready(spark, "registra_test")
    store = spark.createDataFrame(
        [("a", [1.0, 2.0]), ("a", [1.0]), (None, [1.0, 2.0])],
        "registration_number string, embedding array<float>")
    assert tuple(tables.check_vector_table(store, 2).first()) == (3, 1, 1, 1)
    assert tuple(tables.check_vector_table(tables.empty_vector_table(spark), 2).first()) == (0, 0, 0, 0)


def test_year_partitions_are_pruned(spark, tmp_path, capsys):
    df = spark.range(40).selectExpr("cast(id AS string) AS registration_number",
                                    "cast(2000 + id % 4 AS int) AS year")
    tables.write_clean(df, str(tmp_path), ["year"])
    back = FilterSpec(year=2002).apply(tables.read_clean(spark, str(tmp_path)))
    back.explain()
    assert "PartitionFilters: [isnotnull(year" in capsys.readouterr().out
    assert back.count() == 10


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path, capsys):
    df = spark.range(50).selectExpr("cast(id AS string) AS registration_number", "id AS v")
    for name in ("registra_left", "registra_right"):
        tables.load_table(df, name, str(tmp_path / name), buckets=4)
    joined = spark.table("registra_left").hint("merge").join(
        spark.table("registra_right").select(KEY), KEY)
    joined.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == 50


# ---- cleaning -----------------------------------------------------------------------------


def test_null_junk(spark):
    df = spark.createDataFrame([(" - ",), ("нет",), (" x ",), ("Нет",), ("\xa0null",), (None,)], "c string")
    assert [r.c for r in cleaning.null_junk(df).collect()] == [None, "нет", " x ", None, None, None]


def test_dates_numbers_counts(spark):
    df = spark.createDataFrame(
        [("2020-01-02", "1.5", None), ("03.04.2021", " 12 ", 2.0), ("soon", "1,5", 1.0),
         ("2020-01-02T10:11:12", None, None)],
        "start_date string, reports_number string, stages_count double")
    out = cleaning.fill_int(cleaning.to_numeric(cleaning.with_year(cleaning.parse_dates(df))))
    assert [tuple(r) for r in out.collect()] == [
        (datetime.datetime(2020, 1, 2), 1.5, 0, 2020), (datetime.datetime(2021, 4, 3), 12.0, 2, 2021),
        (None, None, 1, None), (datetime.datetime(2020, 1, 2, 10, 11, 12), None, 0, 2020)]


def test_date_formats(spark):
    df = spark.createDataFrame(
        [("2020-02-30",), ("2020-2-3",), ("3 Mar 2020",), ("2020-03-04 05:06:07",), ("x2020-03-04",),
         ("2020-03-04T05:06:07",)], "d string")
    formats = (*cleaning.DATE_FORMATS, "d MMM yyyy")
    got = [r[0] for r in df.select(cleaning.parse_date(F.col("d"), formats)).collect()]
    day = datetime.datetime(2020, 3, 4, 5, 6, 7)
    assert got == [None, None, datetime.datetime(2020, 3, 3), day, None, day]


def test_dedup_is_idempotent_and_unique(spark):
    random.seed(1)
    rows = [(random.choice(["a", "b", "c", None]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "registration_number string, pos int")
    once = cleaning.dedup_keep_last(df, order=["pos"])
    want = sorted({k: p for k, p in rows}.items(), key=repr)
    assert _rows(once) == want
    assert _rows(cleaning.dedup_keep_last(once, order=["pos"])) == want
    kept = cleaning.dedup_keep_last(df, order=["pos"], keep_null_keys=True)
    assert kept.count() == 3 + sum(k is None for k, _ in rows)


def test_dedup_cuts_groups_before_the_shuffle(spark, capsys):
    df = spark.range(100).selectExpr("cast(id % 2 AS string) AS registration_number", "id AS pos")
    cleaning.dedup_keep_last(df, order=["pos"]).explain()
    plan = capsys.readouterr().out
    assert plan.count("WindowGroupLimit") == 2


def test_sparse_and_empty_columns(spark):
    rows = [(i, "v" if i < 3 else None, "v" if i < 2 else None, None) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, third string, fifth string, never string")
    assert cleaning.drop_sparse(df).columns == ["id", "third"]
    assert cleaning.drop_empty(df).columns == ["id", "third", "fifth"]
    assert cleaning.drop_sparse(df, keep=["never"]).columns == ["id", "third", "never"]


def test_truncate_and_nan(spark):
    df = spark.createDataFrame([("x" * 3000, float("nan"), 1), ("y", 2.0, 2)], "t string, v double, n int")
    out = cleaning.nan_to_null(cleaning.truncate_text(df))
    assert [(len(r.t), r.v) for r in out.collect()] == [(2000, None), (1, 2.0)]


def test_lists_without_the_wanted_field(spark):
    df = spark.sql("""SELECT array('a') AS keyword_list, array(named_struct('code', 1)) AS rubrics,
        array(named_struct('year', 1)) AS budgets, cast(array() AS array<string>) AS stages,
        array(named_struct('short_name', 'S')) AS coexecutors, 'kept' AS oecds""")
    assert cleaning.flatten_lists(df).first().asDict() == {
        "keyword_list": "a", "rubrics": None, "oecds": "kept", "budget_total_thousands": None,
        "stages_count": 0, "coexecutors_names": "S"}
    flat = cleaning.flatten_lists(spark.sql("SELECT 1 AS budgets, 2 AS stages, 3 AS coexecutors"))
    assert tuple(flat.first()) == (None, 0, None)


def test_clean_records_order_of_steps(spark):
    """An empty joined list counts as filled when fill rates are taken, and is null at the end."""
    rows = [
        ("k1", [""], "a.json", 1, ("Иванов", None, "Петрович"), "Нет"),
        ("k1", [""], "b.json", 0, ("Иванов", None, "Петрович"), "ok"),
        (None, [""], "b.json", 1, (None, None, None), None),
    ]
    df = spark.createDataFrame(
        rows, "registration_number string, keyword_list array<string>, source_file string, pos int, "
              "work_supervisor struct<surname:string,name:string,patronymic:string>, note string")
    out = cleaning.clean_records(df)
    assert set(out.columns) == {"registration_number", "keyword_list", "supervisor_full_name", "note", "pos"}
    got = {r.registration_number: (r.keyword_list, r.supervisor_full_name, r.note) for r in out.collect()}
    assert got == {"k1": (None, "Иванов  Петрович", "ok"), None: (None, None, None)}


# ---- profiles -----------------------------------------------------------------------------


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0], [5.0] * 40 + [1.0], [float(i) for i in range(1001)],
    [float(i % 7) for i in range(500)],
])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(4)
    assert profile.exact_median(df, "v") == statistics.median(values)


def test_exact_median_narrows_in_rounds(spark):
    random.seed(3)
    values = [random.random() for _ in range(5001)] + [0.5] * 2000
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert profile.exact_median(df, "v", accuracy=50, finish=100) == statistics.median(values)
    assert profile.exact_median(df.where("v > 5"), "v") is None


def test_fill_rates_and_duplicates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), (None, None)], "k string, v double")
    assert _rows(profile.fill_rates(df)) == [("k", 2, 3, 2 / 3), ("v", 1, 3, 1 / 3)]
    assert tuple(profile.duplicate_report(df, "k").first()) == (3, 1, 33.3, 2)


def test_log_histogram_counts_everything(spark):
    df = spark.createDataFrame([(10.0**i,) for i in range(6)] + [(0.0,), (None,)], "v double")
    rows = profile.log_histogram(df, "v", 5).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [1, 1, 1, 1, 2]
    assert profile.log_histogram(df.where("v < 0"), "v").count() == 0
    assert profile.log_histogram(df.where("v = 1"), "v", 4).agg(F.sum("count")).first()[0] == 1


# ---- filters and pages --------------------------------------------------------------------


@pytest.fixture(scope="module")
def few(spark):
    return spark.createDataFrame(
        [("1", 2020, "Прикладное", "Нейросети", None, "климат; x", "МГУ"),
         ("2", 2021, "поисковое", "50% off", "a_b", None, "ТГУ"),
         ("3", None, None, None, "КЛИМАТ", "y", None),
         ("4", 2021, "Прикладное", "back\\slash", "", "z", "мгу")],
        "registration_number string, year int, nioktr_types string, name string, annotation string, "
        "keyword_list string, executor_name string")


@pytest.mark.parametrize("spec, keys", [
    (FilterSpec(), "1234"), (FilterSpec(year=0), "1234"), (FilterSpec(year=2021), "24"),
    (FilterSpec(nioktr_type="ПРИКЛ"), "14"), (FilterSpec(search="климат, , off"), "123"),
    (FilterSpec(search=" , "), "1234"), (FilterSpec(institution="мгу"), "14"),
    (FilterSpec(search="a%b"), "2"), (FilterSpec(search="a%b", literal=True), ""),
    (FilterSpec(search="0%", literal=True), "2"), (FilterSpec(search="k\\s"), ""),
    (FilterSpec(search="k\\s", literal=True), "4"), (FilterSpec(search="\\_"), "2"),
    (FilterSpec(search="s\\lash"), "4"), (FilterSpec(year=2021, institution="МГУ"), "4"),
])
def test_filter_spec(few, spec, keys):
    assert "".join(sorted(r[KEY] for r in spec.apply(few).collect())) == keys


def test_pages(spark, few):
    assert [r[KEY] for r in paging.page(few, 1, 2).collect()] == ["2", "4"]
    assert [r[KEY] for r in paging.page(few, 2, 2).collect()] == ["1", "3"]
    assert [r[KEY] for r in paging.page_after(few, 2021, "4", 2).collect()] == ["1", "3"]
    assert paging.page_after(few, None, "3").count() == 0
    df = spark.range(41)
    assert tuple(paging.page_info(df, 20).first()) == (41, 3)
    with pytest.raises(ValueError):
        paging.page(few, 0)


def test_page_is_a_top_k(few, capsys):
    paging.page(few, 2, 20).explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out


def test_lookup(spark, few):
    assert filters.lookup(few, ["2"]).first()["name"] == "50% off"
    asked = spark.createDataFrame([("2",), ("9",), ("2",)], "registration_number string")
    assert _rows(filters.lookup_report(few, asked)) == [("2", True), ("9", False)]


# ---- changes ------------------------------------------------------------------------------


def _batch(spark, rows):
    return spark.createDataFrame(rows, "registration_number string, name string, seq int")


def test_a_key_that_fills_the_batch_is_inserted_once(spark, few):
    new = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias(KEY), (30_000 - F.col("id")).alias("seq"),
        F.col("id").cast("string").alias("name"),
    )
    result, conflicts = changes.apply_inserts(few, new, "seq")
    assert [r.name for r in result.where(f"{KEY} = 'hot'").collect()] == ["29999"]
    assert result.count() == few.count() + 10_001 and conflicts.count() == 19_999
    for df in (result, conflicts):  # no task ranks the rows of a key
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_inserts(spark, few):
    new = _batch(spark, [("1", "taken", 1), ("8", "second", 3), ("8", "first", 2), ("9", "nine", 4)])
    result, conflicts = changes.apply_inserts(few, new, "seq")
    assert result.columns == few.columns
    assert _rows(result.where(f"{KEY} > '4'").select(KEY, "name", "year")) == [
        ("8", "first", None), ("9", "nine", None)]
    assert _rows(conflicts.select(KEY, "name")) == [("1", "taken"), ("8", "second")]
    unordered, _ = changes.apply_inserts(few, new)
    assert unordered.groupBy(KEY).count().where("count > 1").count() == 0


@pytest.mark.parametrize("order", ["seq", None])
def test_every_insert_is_added_or_a_conflict(spark, few, order):
    rows = [("8", "a", None), ("8", "b", 2), ("8", "c", 2), (None, "d", 1), (None, "e", None), ("1", "f", None), ("9", "g", None)]
    new = _batch(spark, rows)
    result, conflicts = changes.apply_inserts(few, new, order)
    added = _rows(result.where("name in ('a', 'b', 'c', 'd', 'e', 'f', 'g')").select(KEY, "name"))
    refused = _rows(conflicts.select(KEY, "name"))
    assert sorted(added + refused, key=repr) == sorted(((r[0], r[1]) for r in rows), key=repr)
    assert [k for k, _ in added] == ["8", "9"] and (order is None or dict(added)["8"] in "bc")


def test_upsert_without_order_keeps_keys_unique(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "registration_number string, v int")
    new = spark.createDataFrame([("b", 5), ("b", 6), ("c", 7), ("c", 7), (None, 1)], "registration_number string, v int")
    got = [r[0] for r in changes.upsert(base, new).collect()]
    assert sorted(got, key=repr) == sorted(["a", "b", "c", None], key=repr)


def test_updates(spark, few):
    batch = _batch(spark, [("1", "a", 1), ("1", "b", 2), ("7", "none", 3)])
    result, missing = changes.apply_updates(few, batch, "seq")
    row = result.where(f"{KEY} = '1'").first()
    assert (row.name, row.annotation, row.keyword_list, row.year) == ("b", None, None, None)
    assert result.count() == 4 and _rows(missing.select(KEY)) == [("7",)]
    assert result.where(f"{KEY} = '2'").first()["name"] == "50% off"


def test_delete_undoes_insert(spark, few):
    new = _batch(spark, [("8", "x", 1)])
    grown, _ = changes.apply_inserts(few, new, "seq")
    back, missing = changes.apply_deletes(grown, new.unionByName(_batch(spark, [("0", "y", 1)])))
    assert _rows(back) == _rows(few) and _rows(missing) == [("0",)]


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "registration_number string, v int")
    new = spark.createDataFrame(
        [("b", 5, 1), ("b", 6, 2), ("c", 7, 1)], "registration_number string, v int, seq int")
    once = changes.upsert(base, new, order="seq")
    assert _rows(once) == [("a", 1), ("b", 6), ("c", 7)]
    assert _rows(changes.upsert(once, new, order="seq")) == _rows(once)


# ---- envelopes in byte ranges -------------------------------------------------------------


CARD = "a bigint, s string, n struct<x: string>, l array<struct<y: bigint>>"


def _cards(n):
    texts = ["plain", "}{][", 'quote " and \\ backslash', "}, {", "\\", "é\n", "", None]
    return [{"a": i, "s": texts[i % len(texts)], "n": {"x": "]}" * (i % 3)}, "l": [{"y": j} for j in range(i % 4)]} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("form", ["{cards}", '{{"n": 1, "t": "a \\" b", "cards": {cards}, "rest": {{"m": {{"k": "]"}}, "l": [{{}}]}}}}'])
def test_envelopes_are_read_in_ranges(spark, tmp_path, indent, form):
    import json

    from pyspark.sql import types as T

    schema = T.StructType.fromDDL(CARD)
    for name, n in (("2020.json", 300), ("2021.json", 1), ("2022.json", 0)):
        text = json.dumps(_cards(n), indent=indent, ensure_ascii=False)
        (tmp_path / name).write_text(form.format(cards=text) + "\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits per file
    try:
        got = snapshots.read_envelopes(spark, str(tmp_path), schema).orderBy("source_file", "pos").collect()
        splits = spark.read.option("lineSep", "}").text(str(tmp_path / "2020.json")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert splits > 3
    want = [("2020.json", c) for c in _cards(300)] + [("2021.json", c) for c in _cards(1)]
    assert [(r["source_file"], r.asDict(True)) for r in got] == [
        (f, {**c, "source_file": f, "pos": {"_block": 0, "_row": 0, "_in": c["a"]}}) for f, c in want]


@pytest.mark.parametrize("text", ['{"cards": [{"a": 1}', '[{"a": 1}, {"a": ]', '{"cards": {"a": 1}}', '[{"a": "x}]', '{"x": {"cards": [{"a": 1}]}}'])
def test_broken_envelopes_stop_the_load(spark, tmp_path, text):
    from pyspark.sql import types as T

    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception):
        snapshots.read_envelopes(spark, str(tmp_path), T.StructType.fromDDL(CARD)).collect()


@pytest.mark.parametrize("size", [1, 7, 40])
def test_splits_of_an_envelope_are_cut_without_a_shuffle(size):
    """Starts of splits from their surveys, and cards from segments, against one look at the whole text."""
    import json
    import re

    import pyarrow as pa

    pieces = ('{"cards": ' + json.dumps(_cards(60)) + ', "more": {"a": {"b": "]"}}}').split("}")
    rows = [{"text": p, "file": "f", "source_file": "f", "split": i // 16} for i, p in enumerate(pieces)]

    def batches(**more):
        for i in range(0, len(rows), size):
            yield pa.RecordBatch.from_pylist([{**r, **{k: v[r["split"]] for k, v in more.items()}} for r in rows[i : i + size]])

    told = [r for b in snapshots._survey(batches()) for r in b.to_pylist()]
    starts = {k: [] for k in ("starts_inside", "depth", "base", "over")}
    quotes, depth, low = 0, 0, 9
    for s, r in enumerate(told):
        text = re.sub(r"\\.", "", "}".join(pieces[: s * 16]) + "}" * (s > 0))
        outside = "".join(text.split('"')[::2])
        assert r["split"] == s and quotes == text.count('"')
        assert depth == sum(outside.count(c) for c in "{[") - sum(outside.count(c) for c in "}]")
        for name, value in zip(starts, (quotes % 2 == 1, depth, 2, low < 2)):
            starts[name].append(value)
        start, fell = depth, r["low_inside" if quotes % 2 else "low_outside"]
        low = low if fell is None else min(low, start + fell)
        depth += r["inside" if quotes % 2 else "outside"]
        quotes += r["quotes"]
    segments = [r for b in snapshots._segments(batches(**starts)) for r in b.to_pylist()]
    cards, card = [], ""
    for r in segments:
        card += r["text"]
        if r["done"]:
            cards.append(json.loads(re.sub(r"^[\s,]+", "", card.removeprefix('{"cards": ['))))
            card = ""
    assert cards == _cards(60) and len({r["split"] for r in segments}) > 5


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [-0.0, 0.0, 5.0], [float("inf"), -1e308, 1e308], [7.0] * 5 + [1.0, 9.0], [-3.5, -3.25, 1e-310, 2.0]])
def test_radix_median(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
    assert profile.radix_median(df, "v") == (statistics.median(values) if values else None)


def test_radix_median_of_many_values(spark):
    """A million distinct values with a heavy tie in the middle."""
    df = spark.range(1_000_000).selectExpr("CASE WHEN id % 3 = 0 THEN 0.1 ELSE (id - 500000) * 1.37 END AS v")
    values = [0.1 if i % 3 == 0 else (i - 500000) * 1.37 for i in range(1_000_000)]
    assert profile.radix_median(df, "v") == statistics.median(values)
