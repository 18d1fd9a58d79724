"""Filters, projections and lookups on project records."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.sources.tables import KEY

SEARCH_COLUMNS = ("name", "annotation", "keyword_list")


def _contains_pattern(text: str, literal: bool) -> str:
    """A LIKE pattern for "contains ``text``".

    ``%`` and ``_`` in the text act as wildcards unless ``literal``. A backslash that escapes
    nothing stands for the next character, so it is left out.
    """
    if literal:
        text = "".join("\\" + ch if ch in "\\%_" else ch for ch in text)
    pattern, out, i = f"%{text}%", [], 0
    while i < len(pattern):
        if pattern[i] == "\\" and i + 1 < len(pattern):
            out.append(pattern[i : i + 2] if pattern[i + 1] in "\\%_" else pattern[i + 1])
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    return "".join(out)


def contains_ci(c: Column, text: str, literal: bool = False) -> Column:
    """Case-insensitive contains."""
    return c.ilike(_contains_pattern(text, literal))


def search_terms(text: str | None) -> list[str]:
    """Comma-separated terms, stripped, empty ones left out."""
    return [t.strip() for t in (text or "").split(",") if t.strip()]


def search_any(columns: Sequence[Column], text: str, literal: bool = False) -> Column | None:
    """True when any term occurs in any column; None when the text holds no term."""
    hits = [contains_ci(c, t, literal) for t in search_terms(text) for c in columns]
    return reduce(or_, hits) if hits else None


def year_between(first: int, last: int, c: str = "year") -> Column:
    return F.col(c).between(first, last)


def by_year(df: DataFrame, year: int | None) -> DataFrame:
    """Records of one year; 0 and None mean all."""
    return df.where(F.col("year") == year) if year else df


@dataclass(frozen=True)
class FilterSpec:
    """Optional conditions, ANDed. An empty spec keeps every record."""

    year: int | None = None
    nioktr_type: str | None = None
    search: str | None = None
    institution: str | None = None
    literal: bool = False

    def without_year(self) -> FilterSpec:
        return replace(self, year=None)

    def apply(self, df: DataFrame) -> DataFrame:
        df = by_year(df, self.year)
        if self.nioktr_type:
            df = df.where(contains_ci(F.col("nioktr_types"), self.nioktr_type, self.literal))
        if self.search:
            found = search_any([F.col(c) for c in SEARCH_COLUMNS], self.search, self.literal)
            if found is not None:
                df = df.where(found)
        if self.institution:
            df = df.where(contains_ci(F.col("executor_name"), self.institution, self.literal))
        return df


def valid_keyword(c: Column, shortest: int = 3, longest: int = 60) -> Column:
    trimmed = F.trim(c)
    return (trimmed != "") & F.length(trimmed).between(shortest, longest)


def lookup(df: DataFrame, keys: Iterable[str] | DataFrame, key: str = KEY) -> DataFrame:
    """All columns of the records with the given key or keys."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(key), key, "left_semi")
    return df.where(F.col(key).isin(list(keys)))


def lookup_report(df: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
    """Each asked key once with ``found``."""
    asked = keys.select(key).distinct()
    known = df.select(key).distinct().withColumn("found", F.lit(True))
    return asked.join(known, key, "left").select(
        key, F.coalesce("found", F.lit(False)).alias("found")
    )


# ---- fixed values: columns of the list view -----------------------------------------------
LIST_VIEW = {
    "registration_number": "registration_number",
    "name": "name",
    "annotation": "annotation",
    "executor_name": "institution",
    "executor_okogu": "ministry",
    "year": "year",
    "start_date": "start_date",
    "end_date": "end_date",
    "nioktr_types": "nioktr_types",
    "budget_total_thousands": "budget_total_thousands",
    "supervisor_full_name": "supervisor_full_name",
    "keyword_list": "keyword_list",
    "rubrics": "rubrics",
    "stages_count": "stages_count",
    "reports_number": "reports_number",
}
# ---- end of fixed values ------------------------------------------------------------------


def project_list_view(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(name) for c, name in LIST_VIEW.items()])
