"""Expressions on single values."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from registra.functions import nested, numeric, text, vectors


@pytest.mark.parametrize("value, want", [
    ("array('a', '', 'b')", "a; b"),
    ("cast(array() as array<string>)", None),
    ("array('')", ""),
    ("cast(null as array<string>)", None),
    ("array('a', cast(null as string))", "a"),
])
def test_join_strings(one, value, want):
    assert one(nested.join_strings(F.col("c")), c=value) == want


@pytest.mark.parametrize("value, want", [
    ("array(named_struct('name', 'X'), named_struct('name', cast(null as string)))", "X"),
    ("array(named_struct('name', cast(null as string)))", None),
    ("array(named_struct('name', 'X'), named_struct('name', 'Y'))", "X; Y"),
])
def test_join_field(one, value, want):
    assert one(nested.join_field(F.col("c")), c=value) == want


@pytest.mark.parametrize("values, want", [
    (["10.5", None, "abc", "5"], 15.5), (["0"], None), ([], None), (["-3", "1"], None),
    (["inf"], None), ([" 12 "], 12.0),
])
def test_sum_field(spark, values, want):
    rows = [([(v,) for v in values],)]
    df = spark.createDataFrame(rows, "c array<struct<funds:string>>")
    assert df.select(nested.sum_field(F.col("c"))).first()[0] == want


def test_list_count(one):
    assert one(nested.list_count(F.col("c")), c="array(1, 2, 3)") == 3
    assert one(nested.list_count(F.col("c")), c="cast(null as array<int>)") == 0


def test_join_first_of(spark):
    rows = [([("A", None), (None, "B"), ("", None), ("", "C")],)]
    df = spark.createDataFrame(rows, "c array<struct<name:string,short_name:string>>")
    assert df.select(nested.join_first_of(F.col("c"), ["name", "short_name"])).first()[0] == "A; B; C"


@pytest.mark.parametrize("parts, want", [
    (("Иванов", None, "Петрович"), "Иванов  Петрович"),
    ((None, None, None), None),
    (("Иванов", None, None), "Иванов"),
])
def test_full_name(spark, parts, want):
    df = spark.createDataFrame([parts], "a string, b string, c string")
    assert df.select(nested.full_name(F.col("a"), F.col("b"), F.col("c"))).first()[0] == want


def _text(spark, value, fn):
    return spark.createDataFrame([(value,)], "c string").select(fn(F.col("c"))).first()[0]


@pytest.mark.parametrize("value", [
    " a b ", "\xa0 x  \n", "\x1cq\x1f", "  ", "", "　z", "\x85k ",
])
def test_strip_is_python_strip(spark, value):
    assert _text(spark, value, text.strip) == value.strip()


@pytest.mark.parametrize("value, want", [
    ("ФГБОУ ВО «МГУ имени Ломоносова»", "МГУ имени Ломоносова"),
    ("фгаоу\xa0во \"Университет ИТМО\"", "Университет ИТМО"),
    ("Федеральное государственное бюджетное образовательное учреждение высшего образования "
     "«Томский институт»", "Томский институт"),
    ("Государственное бюджетное учреждение «Дом»", "Государственное бюджетное учреждение «Дом»"),
    ("ФГУП «Завод Электрон»", "ФГУП «Завод Электрон"),
    (None, ""),
    ("", ""),
])
def test_clean_org_label(spark, value, want):
    assert _text(spark, value, text.clean_org_label) == want


def test_short_name(spark):
    name = ("Федеральное государственное бюджетное образовательное учреждение высшего "
            "профессионального образования \"Казанский   университет\"")
    assert _text(spark, name, text.short_name) == "Казанский университет"
    assert _text(spark, "ФГБУН ВО Институт", text.short_name) == "Институт"
    assert _text(spark, "x" * 60, text.short_name) == "x" * 52 + "…"
    assert _text(spark, None, text.short_name) == ""


def test_node_label(spark):
    assert _text(spark, "ФГБОУ ВО «Дом»", lambda c: text.node_label(c, "institutions", 2)) == "До"
    assert _text(spark, "«»", lambda c: text.node_label(c, "institutions", 9)) == "«»"
    assert _text(spark, "ФГБОУ ВО", lambda c: text.node_label(c, "topics", 20)) == "ФГБОУ ВО"


def test_registry_link(spark):
    link = _text(spark, "АБ 1+2/(x)!~*'", text.registry_link)
    assert link.endswith("%D0%90%D0%91%201%2B2%2F(x)!~*'")


@pytest.mark.parametrize("value, variant, want", [
    (None, "list", "—"), (0.0, "map", "—"), (1_250_000.0, "list", "1.3 млрд ₽"),
    (2_500.0, "list", "2.5 млн ₽"), (2_500.0, "map", "3 млн ₽"), (999.7, "list", "1\xa0000 тыс ₽"),
    (12.4, "map", "12 тыс ₽"), (1.0, "trend", "1.0 млрд"), (0.25, "trend", "250 млн"),
    (1.005, "trend_full", "1.00 млрд ₽"), (0.0, "trend_full", "—"),
])
def test_format_budget(spark, value, variant, want):
    df = spark.createDataFrame([(value,)], "c double")
    assert df.select(text.format_budget(F.col("c"), variant)).first()[0] == want


@pytest.mark.parametrize("value, digits, want", [
    (32.55, 1, "32.5"), (30.15, 1, "30.1"), (2.25, 1, "2.3"), (2.5, 0, "3"), (0.04, 1, "0.0"),
    (9.96, 1, "10.0"), (1.005, 2, "1.00"), (-1.25, 1, "-1.3"), (0.125, 2, "0.13"), (7.0, 2, "7.00"),
])
def test_fixed(spark, value, digits, want):
    df = spark.createDataFrame([(value,)], "c double")
    assert df.select(text.fixed(F.col("c"), digits)).first()[0] == want


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_fixed_is_exact(spark, digits):
    """Random values, many of them next to a tie, against exact decimal arithmetic."""
    random.seed(digits)
    step = Decimal(1).scaleb(-digits)
    values = [random.uniform(0, 10 ** random.randint(0, 9)) for _ in range(1500)]
    values += [(random.randint(0, 10**6) + 0.5) / 10**digits for _ in range(1500)]
    df = spark.createDataFrame([(v,) for v in values], "c double")
    got = [r[0] for r in df.select(text.fixed(F.col("c"), digits)).collect()]
    assert got == [str(Decimal(v).quantize(step, ROUND_HALF_UP)) for v in values]


def test_format_count(spark):
    df = spark.createDataFrame([(0,), (999,), (1234567,)], "c bigint")
    rows = df.select(text.format_count(F.col("c")), text.format_count(F.col("c"), True)).collect()
    assert [tuple(r) for r in rows] == [
        ("—", "—"), ("999", "999 проектов"), ("1234.6k", "1\xa0234\xa0567 проектов")]


def test_tags(spark):
    assert _text(spark, " a; ,b ,; c", lambda c: text.tags(c, 2)) == ["a", "b"]


def test_rounding_and_scales(one):
    assert one(numeric.round_dec(F.col("c"), 1), c="0.25D") == 0.3
    assert one(numeric.round_dec(F.col("c"), 2), c="-2.675D") == -2.68
    assert one(numeric.sqrt_scale(F.col("c"), F.lit(100.0), 4, 36), c="0D") == 4.0
    assert one(numeric.sqrt_scale(F.col("c"), F.lit(100.0), 9, 22, 9, 30), c="100D") == 30.0


def test_mercator_corners(one):
    assert one(numeric.mercator_x(F.col("c")), c="19.0D") == 0.0
    assert one(numeric.mercator_x(F.col("c")), c="-170.0D") == pytest.approx(171 / 173 * 780)
    assert one(numeric.mercator_y(F.col("c")), c="74.0D") == pytest.approx(0.0)
    assert one(numeric.mercator_y(F.col("c")), c="41.0D") == pytest.approx(430.0)


def test_cosine(one):
    a, b = "array(1.0F, 0.0F)", "array(1.0F, 1.0F)"
    assert one(vectors.cosine(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(0.5**0.5)
    assert one(vectors.cosine(F.col("a"), F.col("b")), a=a, b="array(0.0F, 0.0F)") is None
