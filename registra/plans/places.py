"""Queries: institutions to cities and districts (A17-A20, J7, J8, T7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registra.operators import cities, geo, metrics
from registra.operators.geo import City
from registra.plans.projects import projects, table, with_projects
from registra.plans.registry import money, query, quoted

# A small dictionary over the given nation names. "nation_1" is part of "nation_12", and one city
# is found only by the first word of its name.
CITIES = (
    City("First", ("nation_1",), 55.75, 37.62, "EAST"),
    City("Twelfth", ("nation_12", "nation_3"), 51.67, 39.18, "EAST"),
    City("Second", ("nation_2",), 57.63, 39.87, "WEST"),
    City("Fifth-Seventh", ("nation_5", "nation_7"), 56.86, 35.90, "WEST"),
    City("Nation_8. Port", ("no such key",), 51.73, 36.19, "NORTH"),
)
_COLUMNS = ("executor_name", "executor_ogrn", "executor_okogu", "budget_total_thousands")

ROWS_SQL = f"""map_rows AS (
  SELECT executor_name || ' ' || executor_okogu AS institution, executor_ogrn AS ogrn,
    executor_okogu AS ministry, count(*) AS projects,
    coalesce({money('budget_total_thousands')}, 0) AS total_budget
  FROM projects WHERE executor_name IS NOT NULL
  GROUP BY executor_name, executor_ogrn, executor_okogu
)"""
_KEYS = ", ".join(f"({i}, '{k}')" for i, c in enumerate(CITIES) for k in c.keys)
_CITY_ROWS = ", ".join(
    f"({i}, '{c.city}', {c.lat}::DOUBLE, {c.lon}::DOUBLE, '{c.fo}')" for i, c in enumerate(CITIES))
_WORDS = "(0, 'first'), (1, 'twelfth'), (2, 'second'), (3, 'fifthseventh'), (4, 'nation_8')"


def placed_sql(order: str) -> str:
    best = f"(SELECT i FROM (VALUES {{}}) k(i, key) WHERE contains(lower(institution), key) {{}} LIMIT 1)"
    return f"""{ROWS_SQL}, located AS (
  SELECT *, coalesce({best.format(_KEYS, order)}, {best.format(_WORDS, 'ORDER BY i')}) AS i
  FROM map_rows
), placed AS (
  SELECT institution, ogrn, ministry, projects, total_budget, city, lat, lon, fo
  FROM located JOIN (VALUES {_CITY_ROWS}) c(i, city, lat, lon, fo) USING (i)
)"""


_FIRST = placed_sql("ORDER BY i")
_CITIES_SQL = f"""{_FIRST}, cities AS (
  SELECT city, lat, lon, fo, CAST(sum(projects) AS BIGINT) AS projects,
    {money('total_budget')} AS budget
  FROM placed GROUP BY city, lat, lon, fo HAVING sum(projects) > 0
)"""


def _rows(spark, sf):
    rows = metrics.map_rows(projects(spark, sf, *_COLUMNS))
    return rows.withColumn("institution", F.concat_ws(" ", "institution", "ministry"))


def _cities(spark, sf):
    return geo.city_rollup(geo.place_rows(_rows(spark, sf), CITIES))


@query("a17_map_rows", with_projects(f", {ROWS_SQL} SELECT * FROM map_rows"))
def a17(spark, sf):
    return _rows(spark, sf)


@query("j07_first_match", with_projects(f", {_FIRST} SELECT * FROM placed"))
def j07(spark, sf):
    return geo.place_rows(_rows(spark, sf), CITIES)


@query("j07_longest_match", with_projects(
    f", {placed_sql('ORDER BY length(key) DESC, i')} SELECT * FROM placed"))
def j07_longest(spark, sf):
    return geo.place_rows(_rows(spark, sf), CITIES, "longest")


# Inflected names and the cities they must be placed in; None: in none
_NAMED = (
    ("Институт в Симферополе", "Симферополь"), ("Московский политех", "Москва"), ("Воронежский университет", "Воронеж"),
    ("Южно-Уральский университет", "Екатеринбург"), ("Центр Омской области", "Омск"), ("Костромской музей", "Кострома"),
    ("Сахалинский университет", "Южно-Сахалинск"), ("Камчатский центр", "Петропавловск-К."), ("Академия в Ростове-на-Дону", "Ростов-на-Дону"),
    ("Алтайский край", "Барнаул"), ("Архив Казанского университета", "Казань"), ("Неизвестный институт", None),
)
_NAMES = ", ".join(quoted(n) for n, _ in _NAMED)
_PLACES = ", ".join("NULL" if c is None else quoted(c) for _, c in _NAMED)


@query("j07_city_dictionary", f"""SELECT c_custkey, [{_NAMES}][c_custkey % {len(_NAMED)} + 1] || ' № ' || c_custkey AS institution,
  [{_PLACES}][c_custkey % {len(_NAMED)} + 1] AS city FROM customer""")
def j07_dictionary(spark, sf):
    names = F.array(*[F.lit(n) for n, _ in _NAMED])
    name = F.get(names, (F.col("c_custkey") % len(_NAMED)).cast("int"))
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.concat(name, F.lit(" № "), F.col("c_custkey").cast("string")).alias("institution"))
    placed = geo.first_match(rows, "institution", cities.CITIES, fallback=False)
    return placed.select("c_custkey", "institution", "city")


@query("j08_fallback_match", with_projects(
    f", {_FIRST} SELECT institution, city FROM placed WHERE city = 'Nation_8. Port'"))
def j08(spark, sf):
    rows = _rows(spark, sf).select("institution")
    keyed = geo.first_match(rows, "institution", CITIES, fallback=False).where("city IS NULL")
    found = geo.first_match(keyed.select("institution"), "institution", CITIES)
    return found.where("city IS NOT NULL").select("institution", "city")


@query("a18_city_rollup", with_projects(f", {_CITIES_SQL} SELECT * FROM cities"))
def a18(spark, sf):
    return _cities(spark, sf)


@query("a18_city_organisations", with_projects(
    f", {_FIRST} SELECT city, CAST(row_number() OVER (PARTITION BY city ORDER BY projects DESC, "
    "institution, ogrn, ministry) AS INTEGER) AS rank, institution, projects, total_budget "
    "FROM placed QUALIFY rank <= 5"))
def a18_organisations(spark, sf):
    return geo.city_organisations(geo.place_rows(_rows(spark, sf), CITIES))


@query("a19_district_rollup", with_projects(
    f", {_CITIES_SQL} SELECT fo, CAST(sum(projects) AS BIGINT) AS projects, count(*) AS cities "
    "FROM cities GROUP BY fo"))
def a19(spark, sf):
    return geo.district_rollup(_cities(spark, sf))


@query("a20_geo_coverage", with_projects(
    f", {_FIRST}, t AS (SELECT CAST(sum(projects) AS BIGINT) AS total FROM map_rows) "
    "SELECT CAST(sum(projects) AS BIGINT) AS matched, any_value(total) AS total, "
    "CAST(round(sum(projects) * 100 / any_value(total)) AS INTEGER) AS percent FROM placed, t"))
def a20(spark, sf):
    return geo.geo_coverage(_rows(spark, sf), CITIES)


@query("t07_top_cities", with_projects(
    f", {_CITIES_SQL} SELECT * FROM cities ORDER BY budget DESC, city LIMIT 10"))
def t07(spark, sf):
    return geo.top_cities(_cities(spark, sf), "budget", 10)
