"""Figures, keywords, graphs and places."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from registra.operators import geo, graph, keywords, metrics, shared
from registra.operators.cities import CITIES
from registra.operators.filters import FilterSpec
from registra.operators.metrics import BUDGET


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def records(spark):
    random.seed(7)
    rows = []
    for i in range(400):
        words = [random.choice(["Alpha ", "beta", "  gamma", "de", "", "x" * 61, "delta"])
                 for _ in range(random.randint(0, 12))]
        rows.append((
            str(i), random.choice([2019, 2020, 2021, 2025, None]),
            random.choice(["T1", "T2", None]), random.choice([None, 999.0, 10_000.0, 123.45]),
            random.choice(["Org A", "Org B", None]), random.choice(["1", None]),
            random.choice(["S1", "S2", "S3", None]), ";".join(words) if words else None))
    return spark.createDataFrame(
        rows, f"registration_number string, year int, nioktr_types string, {BUDGET} double, "
              "executor_name string, executor_ogrn string, supervisor_full_name string, "
              "keyword_list string").repartition(5)


def test_buckets_count_inner_edges_twice(spark):
    df = spark.createDataFrame([(v,) for v in (999.0, 1000.0, 10_000.0, 100_000.0, 100_001.0)],
                               f"{BUDGET} double")
    assert tuple(metrics.bucket_counts(df).first()) == (1, 2, 2, 1)


def test_empty_input(records):
    none = records.where("year = 1")
    assert metrics.total(none).first()[0] == 0
    assert metrics.total_budget(none).first()[0] == 0.0
    assert metrics.top_groups(none, "executor_name").count() == 0
    assert metrics.dashboard_stats(metrics.dashboard_cube(none))["total"].first()[0] == 0


def test_dashboard_equals_single_figures(records):
    spec = FilterSpec(year=2020, nioktr_type="t1")
    stats = metrics.dashboard_stats(metrics.dashboard_cube(records, spec), 2020)
    kept = spec.apply(records)
    assert _rows(stats["total"]) == _rows(metrics.total(kept))
    assert _rows(stats["total_budget"]) == _rows(metrics.total_budget(kept))
    assert _rows(stats["by_year"]) == _rows(metrics.count_by_year(records, spec))
    assert len(_rows(stats["by_year"])) > 1
    assert _rows(stats["top_institutions"]) == _rows(metrics.top_groups(kept, "executor_name"))
    assert _rows(stats["institutions"]) == _rows(metrics.distinct_count(kept, "executor_name"))


def test_budget_figures_equal_single_figures(records):
    spec = FilterSpec(year=2020, nioktr_type="t1")
    stats = metrics.budget_stats(metrics.budget_cube(records), spec)
    kept = spec.apply(records)
    assert _rows(stats["by_year"]) == _rows(metrics.budget_by_year(records))
    assert _rows(stats["top_orgs_by_budget"]) == _rows(metrics.top_by_sum(kept, "executor_name"))
    assert _rows(stats["by_type"]) == _rows(metrics.budget_by_type(kept))
    assert _rows(stats["distribution"]) == _rows(metrics.bucket_counts(kept))
    empty = metrics.budget_stats(metrics.budget_cube(records), FilterSpec(year=1))
    assert tuple(empty["distribution"].first()) == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        metrics.budget_stats(records, FilterSpec(search="x"))


def _cells(records):
    counts, money = Counter(), Counter()
    for r in records.collect():
        if r.year and 2020 <= r.year <= 2025 and r.keyword_list is not None:
            for w in r.keyword_list.split(";"):
                if 3 <= len(w.strip(" ")) <= 60:
                    key = (r.year, w.strip(" ").lower())
                    counts[key] += 1
                    money[key] += r[BUDGET] or 0
    return {k: (n, money[k] / 1e6) for k, n in counts.items() if n >= 2}


def test_keyword_cells_and_trends(records):
    want = _cells(records)
    got = {(r.year, r.keyword): (r.projects, pytest.approx(r.budget_billions))
           for r in keywords.keyword_cells(records).collect()}
    assert got == want
    grid = keywords.keyword_trends(records, 5)
    cells = keywords.keyword_cells(records)
    dense = keywords.densify(cells, keywords.top_keywords(cells, 5), (2020, 2025))
    assert _rows(grid) == _rows(dense)
    topics = {r.keyword for r in grid.collect()}
    assert grid.count() == len(topics) * 6
    with pytest.raises(ValueError):
        keywords.keyword_trends(records, 4)


def test_rare_cells_are_dropped(spark):
    df = spark.createDataFrame([(2020, 1.0, "abc"), (2021, 1.0, "abc; abc")],
                               f"year int, {BUDGET} double, keyword_list string")
    assert _rows(keywords.keyword_cells(df).select("year", "projects")) == [(2021, 2)]


def _grid(spark, values):
    rows = [(k, sum(v), 2020 + i, n, float(n)) for k, v in values.items() for i, n in enumerate(v)]
    return spark.createDataFrame(
        rows, "keyword string, total bigint, year int, projects bigint, budget double")


def test_ranks_stacks_peaks_shares(spark):
    grid = _grid(spark, {"a": [3, 5, 5], "b": [3, 9, 9], "c": [0, 0, 0]})
    ranks = {(r.keyword, r.year): r.rank for r in keywords.yearly_rank(grid).collect()}
    assert [ranks["b", 2020], ranks["a", 2020], ranks["c", 2020]] == [1, 2, 3]
    last = keywords.rank_in_year(grid).collect()
    assert {r.year for r in last} == {2022}
    bands = keywords.stack_bands(grid)
    totals = {r.year: r.projects for r in keywords.year_totals(grid).collect()}
    tops = {r.year: r.m for r in bands.groupBy("year").agg(F.max("top").alias("m")).collect()}
    assert tops == totals == {2020: 6, 2021: 14, 2022: 14}
    assert keywords.stack_max(bands).first()[0] == 14.0
    peaks = {r.keyword: r.peak_year for r in keywords.peak_year(grid).collect()}
    assert peaks == {"a": 2021, "b": 2021, "c": 2020}
    assert keywords.active_topics(grid).where("keyword = 'c'").count() == 0
    shares = keywords.share_of_max(grid, "projects", ["year"])
    assert shares.agg(F.max("share")).first()[0] == 1.0
    zero = keywords.share_of_max(grid.where("keyword = 'c'"), "projects")
    assert zero.agg(F.max("share")).first()[0] == 0.0


# ---- graphs -------------------------------------------------------------------------------


def _brute(links, at_least=2):
    groups = {}
    for m, g in links:
        groups.setdefault(m, set()).add(g)
    weight = Counter()
    for members in groups.values():
        weight.update(itertools.combinations(sorted(members), 2))
    return {p: w for p, w in weight.items() if w >= at_least}


def _link_sets():
    random.seed(11)
    plain = [(f"m{random.randint(0, 30)}", f"g{random.randint(0, 40)}") for _ in range(400)]
    # two members hold most groups, one of them a third of all rows
    hot = [("hot", f"g{i:03d}") for i in range(120)] + [("warm", f"g{i:03d}") for i in range(0, 120, 2)]
    light = [(f"m{random.randint(0, 60)}", f"g{random.randint(0, 119):03d}") for _ in range(180)]
    copies = [(m, f"c{i:03d}") for i in range(90) for m in ("x", "y", "z")]
    # many classes of heavy members, with and without light members in common
    mixed = [(f"h{m}", f"g{i:03d}") for i in range(100) for m in range(6) if random.random() < 0.6]
    return {"plain": plain, "hot": hot + light, "copies": copies + plain + hot,
            "mixed": mixed + light}


@pytest.mark.parametrize("name", ["plain", "hot", "copies", "mixed"])
@pytest.mark.parametrize("heavy", [3, 20, 2_000])
def test_shared_pairs_against_brute_force(spark, name, heavy):
    rows = _link_sets()[name]
    df = spark.createDataFrame(rows, "m string, g string")
    links = shared.memberships(df, F.col("m"), F.col("g"))
    want = _brute(set(rows))
    got = {(r.source, r.target): r.weight
           for r in shared.shared_member_pairs(links, 2, heavy).collect()}
    assert got == want
    for k in (7, 50, 400):
        top = [(r.source, r.target, r.weight)
               for r in shared.top_shared_pairs(links, k, 2, heavy).collect()]
        best = sorted(((s, t, w) for (s, t), w in want.items()), key=lambda p: (-p[2], p[0], p[1]))
        assert top == best[:k]


@pytest.mark.parametrize("name", ["hot", "copies", "mixed"])
def test_top_pairs_by_classes(spark, monkeypatch, name):
    monkeypatch.setattr(shared, "FEW_PAIRS", 0)
    rows = _link_sets()[name]
    links = shared.memberships(spark.createDataFrame(rows, "m string, g string"), F.col("m"), F.col("g"))
    top = [(r.source, r.target, r.weight) for r in shared.top_shared_pairs(links, 50, 2, 20).collect()]
    best = sorted(((s, t, w) for (s, t), w in _brute(set(rows)).items()), key=lambda p: (-p[2], p[0], p[1]))
    assert top == best[:50]


@pytest.mark.parametrize("few_members", [64, 6])
def test_pairs_that_share_one_member_are_not_spelled_out(spark, monkeypatch, few_members):
    random.seed(41)
    groups = {f"g{i}": set(random.sample(range(100), random.randint(1, 4))) for i in range(600)}
    groups["big"] = set(range(0, 100, 3))
    rows = [(f"m{m}", g) for g, ms in groups.items() for m in ms]
    links = spark.createDataFrame(rows, "member string, grp string").repartition(3)
    want = sorted((-len(groups[a] & groups[b]), a, b) for a, b in itertools.combinations(sorted(groups), 2)
                  if len(groups[a] & groups[b]) > 1)

    def other_way(*args):
        raise AssertionError("pairs met in single members")

    for name, value in (("FEW_PAIRS", 0), ("FEW_MEMBERS", few_members), ("_all_weights", other_way), ("_heavy_pairs", other_way)):
        monkeypatch.setattr(shared, name, value)
    monkeypatch.setattr(shared, "ROWS_PER_LINK", 1000)
    pairs = shared._pairs_by_twos(links, shared._sizes(links), 10**9, 20)
    assert sorted((-r.weight, r.source, r.target) for r in pairs.collect()) == want
    for found in (shared.top_shared_pairs(links, 25), shared.shared_member_pairs(links)):
        got = [(-r.weight, r.source, r.target) for r in found.collect()]
        assert sorted(got) == want[:len(got)] and len(got) in (25, len(want))


def test_pairs_by_twos_leave_large_work_to_the_others(spark):
    links = spark.createDataFrame([(f"m{m}", f"g{g}") for g in range(30) for m in range(4)], "member string, grp string")
    sizes = shared._sizes(links)
    assert shared._pairs_by_twos(links, sizes, 100, 1000) is None  # 180 pairs of members alone
    assert shared._pairs_by_twos(links, sizes, 10**9, 20) is None  # 30 groups hold the same two members


@pytest.mark.parametrize("at_least", [3])
def test_pairs_of_higher_weight(spark, at_least):
    rows = _link_sets()["mixed"] + _link_sets()["plain"]
    links = shared.memberships(spark.createDataFrame(rows, "m string, g string"), F.col("m"), F.col("g"))
    for heavy in (3, 40):
        got = {(r.source, r.target): r.weight for r in shared.shared_member_pairs(links, at_least, heavy).collect()}
        assert got == _brute(set(rows), at_least)


def test_classes_of_heavy_members(spark, monkeypatch):
    """Groups of 12 of 24 members: nearly every two share some, few share enough for the list."""
    random.seed(5)
    rows = [(f"h{m}", f"g{i:04d}") for i in range(400) for m in random.sample(range(24), 12)]
    monkeypatch.setattr(shared, "FEW_PAIRS", 0)
    links = shared.memberships(spark.createDataFrame(rows, "m string, g string"), F.col("m"), F.col("g"))
    assert shared._reached_weight(links, 20, 2, 2_000) >= 9
    got = [(r.source, r.target, r.weight) for r in shared.top_shared_pairs(links, 20).collect()]
    want = sorted(((s, t, w) for (s, t), w in _brute(set(rows)).items()), key=lambda p: (-p[2], p[0], p[1]))
    assert got == want[:20]


def test_one_heavy_member_makes_no_pairs(spark):
    """A member of 3000 groups would give 4.5 million pairs; none of them can be an edge."""
    df = spark.range(3000).selectExpr("'hot' AS m", "cast(id AS string) AS g")
    links = shared.memberships(df, F.col("m"), F.col("g"))
    assert shared.shared_member_pairs(links, 2, 100).count() == 0


def test_heavy_classes_are_spelled_out_as_far_as_needed(spark):
    """3000 groups with the same two heavy members tie in 4.5 million pairs."""
    df = spark.range(3000).selectExpr("explode(array('x', 'y')) AS m", "id AS g")
    links = shared.memberships(df, F.col("m"), F.col("g").cast("string"))
    assert shared._heavy_pairs(links, 10, 2).count() < 60
    ids = sorted(str(i) for i in range(3000))
    want = list(itertools.islice(itertools.combinations(ids, 2), 10))
    got = shared.top_shared_pairs(links, 10, 2, 100).collect()
    assert [(r.source, r.target) for r in got] == want and {r.weight for r in got} == {2}


def test_institution_graph(spark):
    rows = [("1", "ФГБОУ ВО «Институт один»", "S1", 5.0)] * 3 + [("2", "Второй", "S1", None)] * 3 + [
        ("1", "ФГБОУ ВО «Институт один»", "S2", 1.0), ("2", "Второй", "S2", 1.0),
        ("3", "Third", "S1", 1.0), ("3", "Third", "S2", 1.0)]
    df = spark.createDataFrame(
        rows, f"executor_ogrn string, executor_name string, supervisor_full_name string, {BUDGET} double")
    nodes, edges = graph.institution_graph(df, 3, 10)
    assert _rows(nodes.select("id", "label", "projects")) == [("1", "Институт один", 4), ("2", "Второй", 4)]
    assert _rows(edges) == [("1", "2", 2)]
    assert tuple(graph.graph_summary(nodes, edges).first()) == (2, 1)
    few, none = graph.institution_graph(df.where("executor_ogrn = '1'"), 3, 10)
    assert few.count() == 0 and none.count() == 0
    picked = spark.createDataFrame([("2",)], "id string")
    assert _rows(graph.neighbours(edges, picked)) == [("2", "1", 2)]
    star = spark.createDataFrame(
        [("a", f"z{i}", 10 - i % 3) for i in range(9)], "source string, target string, weight int")
    near = graph.strongest_neighbours(star, spark.createDataFrame([("a",), ("z1",)], "id string"))
    assert [r.neighbour for r in near.where("id = 'a'").orderBy("rank").collect()] == [
        "z0", "z3", "z6", "z1", "z4"]
    assert near.where("id = 'z1'").first()["neighbour"] == "a"
    assert [r.target for r in graph.strongest_edges(star, 2).collect()] == ["z0", "z3"]


def _words(text):
    return [w.strip().lower() for w in text.split(";") if w.strip()]


def test_record_words_equal_plain_reading(spark):
    texts = ["a;;b ; C;\xa0;d", ";;", "", " x ", "; \n;y;z ", ";".join(f" W{i}" for i in range(30)), "q;", " ;p"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "keyword_list string")
    got = [r.words for r in graph.record_words(df).collect()]
    assert got == [_words(t) for t in texts]
    got = [r.words for r in graph.record_words(df, n=10).collect()]
    assert got == [_words(t)[:10] for t in texts]


def test_all_words_of_a_record_pair(spark):
    df = spark.createDataFrame([([f"w{i}" for i in range(15)],)], "words array<string>")
    assert graph.cooccurrence_pairs(df).count() == 105


def test_topic_graph_against_brute_force(spark):
    random.seed(5)
    texts = ["; ".join(random.choice("ABCDEFGHIJKLMNOP") for _ in range(random.randint(0, 14)))
             for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "keyword_list string")
    count, pairs = Counter(), Counter()
    for t in texts:
        ws = _words(t)[:10]
        count.update(ws)
        pairs.update(tuple(sorted(p)) for p in itertools.combinations(ws, 2))
    nodes, edges = graph.topic_graph(df, 10)
    top = sorted(count, key=lambda w: (-count[w], w))[:10]
    assert {r.id: r["count"] for r in nodes.collect()} == {w: count[w] for w in top}
    common = sorted(pairs.items(), key=lambda p: (-p[1], p[0]))[:500]
    want = [(a, b, n) for (a, b), n in common if a in top and b in top and n >= 5]
    assert _rows(edges) == sorted(want, key=repr)
    loose = graph.cooccurrence_pairs(graph.record_words(df), drop_self=True)
    assert loose.where("source = target").count() == 0


# ---- places -------------------------------------------------------------------------------


def test_dictionary_order_rule(spark):
    df = spark.createDataFrame(
        [("Томский государственный университет",), ("НИИ, г. Казань",), ("Nowhere",), (None,),
         ("ФГБОУ ТУЛА",), ("сахалинский музей",)], "institution string")
    first = [r.city for r in geo.first_match(df, "institution", CITIES).collect()]
    assert first == ["Омск", "Казань", None, None, None, "Южно-Сахалинск"]
    longest = geo.first_match(df, "institution", CITIES, "longest")
    assert longest.first()["city"] == "Томск"
    assert len(CITIES) == 77


def test_fallback_word_only_without_key(spark):
    cities = (geo.City("Alpha-Beta Town", ("zz",), 1, 2, "A"), geo.City("Gamma", ("alpha",), 3, 4, "B"),
              geo.City("Tiny", ("qq",), 5, 6, "C"))
    df = spark.createDataFrame([("the alphabeta house",), ("alphabet",), ("tiny",)], "institution string")
    assert [r.city for r in geo.first_match(df, "institution", cities).collect()] == ["Gamma", "Gamma", None]
    lone = (cities[0],)
    assert [r.city for r in geo.first_match(df, "institution", lone).collect()] == ["Alpha-Beta Town", None, None]


def test_rollups(spark):
    rows = spark.createDataFrame(
        [("Казань один", "1", "m", 5, 1.5), ("Казань два", "2", "m", 7, 2.5), ("Омск", "3", "m", 1, 0.0),
         ("Elsewhere", "4", "m", 7, 9.0)],
        "institution string, ogrn string, ministry string, projects bigint, total_budget double")
    placed = geo.place_rows(rows, CITIES)
    cities = geo.city_rollup(placed)
    assert _rows(cities.select("city", "projects", "budget")) == [("Казань", 12, 4.0), ("Омск", 1, 0.0)]
    assert _rows(geo.district_rollup(cities)) == [("PFO", 12, 1), ("SFO", 1, 1)]
    assert tuple(geo.geo_coverage(rows, CITIES).first()) == (13, 20, 65)
    assert [r.institution for r in geo.city_organisations(placed, 1).orderBy("city").collect()] == [
        "Казань два", "Омск"]
    assert [r.city for r in geo.top_cities(cities, "budget", 1).collect()] == ["Казань"]


# ---- bounds of top lists ------------------------------------------------------------------


@pytest.mark.parametrize("kept,held", [(3, 16), (40, 64), (4_096, 1 << 19)])
@pytest.mark.parametrize("shape", ["skewed", "flat"])
def test_top_terms_by_bounds(spark, monkeypatch, shape, kept, held):
    """Few terms are sent by a task, so what was not sent decides whether more passes are needed."""
    random.seed(7)
    pick = (lambda: int(random.paretovariate(0.7))) if shape == "skewed" else (lambda: random.randrange(300))
    lists = ["; ".join(f"{random.choice(['', ' '])}{random.choice('Tt')}{pick() % 900}" for _ in range(random.randrange(40))) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in [*lists, None, "", " ;,; "]], "keyword_list string").repartition(6)
    counts = Counter(w for x in lists for w in (p.strip().lower() for p in x.replace(",", ";").split(";")) if w)
    monkeypatch.setattr(keywords, "HELD_TERMS", held)
    got = [(r["term"], r["count"]) for r in keywords.top_terms(df, n=12, kept=kept).collect()]
    assert got == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:12]


def test_rare_words_pair_with_none(spark, monkeypatch):
    random.seed(8)
    lists = [list({f"w{int(random.paretovariate(0.5))}" for _ in range(10)}) for _ in range(400)]
    words = spark.createDataFrame([(x,) for x in lists], "words array<string>")
    monkeypatch.setattr(graph, "FEW_PAIRS", 0)
    kept = graph.frequent_words(words, 20)
    assert graph.cooccurrence_pairs(kept).count() < graph.cooccurrence_pairs(words).count()
    best = [F.desc("weight"), F.asc("source"), F.asc("target")]
    top = [tuple(r) for r in graph.pair_weights(graph.cooccurrence_pairs(kept)).orderBy(*best).limit(20).collect()]
    assert top == [tuple(r) for r in graph.pair_weights(graph.cooccurrence_pairs(words)).orderBy(*best).limit(20).collect()]


def test_tasks_of_exploded_keywords_follow_the_records(spark, tmp_path, monkeypatch):
    import datetime

    from registra.plans import topics

    day = datetime.datetime(1996, 1, 2)
    tables = {
        "orders": ([(i // 2, 1, "F", 1.0, day, "1-URGENT") for i in range(30)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "customer": ([(1, "C", 1, 0.0, "SEG")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "nation": ([(1, "N")], "n_nationkey int, n_name string"),
        "lineitem": ([(i, 1, 1, 1) for i in range(14)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
        "part": ([(1, "a a", "B", "T")], "p_partkey long, p_name string, p_brand string, p_type string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(topics, "RECORDS_PER_TASK", 7)
    found = topics.j02(spark, str(tmp_path))
    plan = found._jdf.queryExecution().toString()
    assert "RoundRobinPartitioning(5)" in plan  # 30 records
    words = {"a": 2, " a": 2, " B": 2, " T": 2, " SEG": 2, " N": 2}
    assert sorted(tuple(r) for r in found.collect()) == sorted((str(i), w, n) for i in range(14) for w, n in words.items())
