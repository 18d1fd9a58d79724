"""Cleaning: typing, junk removal, column pruning and keep-last deduplication."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from registra.functions import nested
from registra.functions.text import stripped_equals
from registra.operators.profile import fill_rates_row
from registra.sources.snapshots import flatten_structs
from registra.sources.tables import KEY

# ---- fixed values -------------------------------------------------------------------------
MIN_FILL = 0.30
TEXT_LIMIT = 2_000
JUNK = ("", "Отсутствует", "Нет", "-", "None", "null")
STRING_LISTS = (
    "keyword_list",
    "nioktr_types",
    "priority_directions",
    "critical_technologies",
    "scientific_technology_priorities",
    "scientific_educational_centers",
    "scientific_centers",
    "national_technology_initiatives",
    "nioktr_bases",
)
NAMED_LISTS = ("rubrics", "oecds", "oesrs")
DATES = ("created_date", "start_date", "end_date", "contract_date")
NUMBERS = ("budget_total_thousands", "reports_number")
ALWAYS_DROPPED = (
    "international_scientific_collaboration",
    "scientific_groundwork",
    "scientific_technology_priorities",
    "personal_data_agreement",
    "ptni",
    "identify_executor_method",
    "grnti_oecd_description",
    "interstate_target_program",
    "full_innovation_cycle_scientific_technical_program",
    "federal_scientific_technical_program",
    "customer_supervisor_name",
    "customer_supervisor_surname",
    "customer_supervisor_patronymic",
    "executor_short_name",
    "executor_okopf",
    "executor_original_name",
    "executor_original_short_name",
    "executor_supervisor_name",
    "executor_supervisor_surname",
    "executor_supervisor_patronymic",
    "customer_okopf",
    "customer_original_name",
    "customer_original_short_name",
    "work_supervisor_name",
    "work_supervisor_surname",
    "work_supervisor_patronymic",
    "work_supervisor_territory",
    "work_supervisor_position",
    "work_supervisor_rank",
    "work_supervisor_orcid",
    "organization_supervisor_name",
    "organization_supervisor_surname",
    "organization_supervisor_patronymic",
    "organization_supervisor_territory",
    "organization_supervisor_position",
    "source_file",
    "customer_short_name",
    "udk",
)
# ---- end of fixed values ------------------------------------------------------------------

DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd.MM.yyyy")


def _present(df: DataFrame, names: Iterable[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def _replace(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    return df.withColumns(changed) if changed else df


def _members(df: DataFrame, name: str) -> set[str] | None:
    """Field names of the structs in a list column; None when the column is no list."""
    dtype = df.schema[name].dataType
    if not isinstance(dtype, T.ArrayType):
        return None
    element = dtype.elementType
    return set(element.names) if isinstance(element, T.StructType) else set()


def flatten_lists(df: DataFrame) -> DataFrame:
    """Turn the list columns of a card into scalars.

    A list whose members lack the wanted field, as in a schema inferred from few cards, gives null.
    """
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    lists = {n: m for n in df.columns if (m := _members(df, n)) is not None}
    changed = {n: nested.join_strings(F.col(n)) for n in STRING_LISTS if n in lists}
    for n in NAMED_LISTS:
        if n in lists:
            changed[n] = nested.join_field(F.col(n)) if "name" in lists[n] else text
    if "budgets" in df.columns:
        known = "funds" in lists.get("budgets", ())
        changed["budget_total_thousands"] = nested.sum_field(F.col("budgets")) if known else number
    if "stages" in df.columns:
        changed["stages_count"] = (
            nested.list_count(F.col("stages")) if "stages" in lists else F.lit(0)
        )
    if "coexecutors" in df.columns:
        fields = [f for f in ("name", "short_name") if f in lists.get("coexecutors", ())]
        changed["coexecutors_names"] = (
            nested.join_first_of(F.col("coexecutors"), fields) if fields else text
        )
    return _replace(df, changed).drop("budgets", "stages", "coexecutors")


def with_supervisor(df: DataFrame) -> DataFrame:
    """Add the supervisor's full name when all three parts are present."""
    parts = [f"work_supervisor_{p}" for p in ("surname", "name", "patronymic")]
    if len(_present(df, parts)) < 3:
        return df
    return df.withColumn("supervisor_full_name", nested.full_name(*[F.col(p) for p in parts]))


def drop_columns(df: DataFrame, names: Iterable[str] = ALWAYS_DROPPED) -> DataFrame:
    return df.drop(*names)


def drop_sparse(
    df: DataFrame, threshold: float = MIN_FILL, keep: Iterable[str] = ()
) -> DataFrame:
    """Drop columns filled in less than ``threshold`` of the rows. Counts the frame once."""
    rows, filled = fill_rates_row(df)
    low = [c for c, n in filled.items() if rows and n / rows < threshold and c not in set(keep)]
    return df.drop(*low)


def drop_empty(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Drop columns without any value."""
    rows, filled = fill_rates_row(df)
    return df.drop(*[c for c, n in filled.items() if rows and n == 0 and c not in set(keep)])


def _shape(fmt: str) -> str | None:
    """Regex of the texts a numeric date format can read; None for formats with names or zones."""
    out = ""
    for token in re.finditer(r"'([^']*)'|(([A-Za-z])\3*)|(.)", fmt):
        literal, letters, letter, other = token.groups()
        if letters:
            if letter not in "yMdHms" or letters.startswith("MMM"):
                return None
            out += r"\d{%d}" % len(letters) if len(letters) > 1 else r"\d+"
        else:
            out += re.escape(other if literal is None else literal)
    return f"^{out}$"


def parse_date(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First format that fits; null when none does.

    A format is tried only on texts of its shape: failing to parse is far slower than a match.
    """

    def read(fmt: str) -> Column:
        shape = _shape(fmt)
        return F.try_to_timestamp(F.when(c.rlike(shape), c) if shape else c, F.lit(fmt))

    return F.coalesce(*[read(f) for f in formats]).cast("timestamp_ntz")


def parse_dates(
    df: DataFrame, columns: Iterable[str] = DATES, formats: Sequence[str] = DATE_FORMATS
) -> DataFrame:
    return _replace(df, {n: parse_date(F.col(n), formats) for n in _present(df, columns)})


def with_year(df: DataFrame, source: str = "start_date") -> DataFrame:
    if source not in df.columns:
        return df
    return df.withColumn("year", F.year(source).cast("int"))


def to_numeric(df: DataFrame, columns: Iterable[str] = NUMBERS) -> DataFrame:
    """Cast to double; unreadable text becomes null."""
    return _replace(df, {n: F.col(n).try_cast("double") for n in _present(df, columns)})


def fill_int(df: DataFrame, columns: Iterable[str] = ("stages_count",)) -> DataFrame:
    return _replace(
        df, {n: F.coalesce(F.col(n), F.lit(0)).cast("int") for n in _present(df, columns)}
    )


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def null_junk(df: DataFrame, tokens: Sequence[str] = JUNK) -> DataFrame:
    """Null text whose stripped form is a junk token; other text is left as it is."""
    return _replace(
        df,
        {
            n: F.when(~stripped_equals(F.col(n), tokens), F.col(n))
            for n in _text_columns(df)
        },
    )


def truncate_text(df: DataFrame, limit: int = TEXT_LIMIT) -> DataFrame:
    return _replace(df, {n: F.substring(F.col(n), 1, limit) for n in _text_columns(df)})


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.FractionalType)
              and not isinstance(f.dataType, T.DecimalType)]
    return _replace(df, {n: F.when(~F.isnan(n), F.col(n)) for n in floats})


def dedup_keep_last(
    df: DataFrame, key: str = KEY, order: Sequence[str] = ("source_file", "pos"),
    keep_null_keys: bool = False,
) -> DataFrame:
    """Latest row per key. Rows without a key form one group unless ``keep_null_keys``.

    Each task cuts its rows to one per key before the shuffle, so copies of a hot key are not sent.
    """
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    if keep_null_keys:
        last = dedup_keep_last(df.where(F.col(key).isNotNull()), key, order)
        return last.unionByName(df.where(F.col(key).isNull()))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


@dataclass(frozen=True)
class CleanConfig:
    dropped: tuple[str, ...] = ALWAYS_DROPPED
    min_fill: float = MIN_FILL
    junk: tuple[str, ...] = JUNK
    date_formats: tuple[str, ...] = DATE_FORMATS
    order: tuple[str, ...] = ("source_file", "pos")
    key: str = KEY
    keep: tuple[str, ...] = field(default=())


def clean_records(raw: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Raw cards to clean records, in the fixed order of steps.

    Fill rates are measured after lists are flattened and before junk and duplicates go. That takes
    a pass of its own over ``raw``; give a written table rather than JSON text when it is large.
    """
    packed = raw.withColumn("_order", F.struct(*cfg.order))
    packed = packed.drop(
        *[c for c in cfg.order if isinstance(raw.schema[c].dataType, T.StructType)]
    )
    flat = flatten_lists(flatten_structs(packed, keep=("_order",)))
    pruned = drop_columns(with_supervisor(flat), cfg.dropped)
    rows, filled = fill_rates_row(pruned)  # one pass serves the sparse and the empty columns
    always = {cfg.key, "_order", *cfg.keep}
    pruned = pruned.drop(
        *[c for c, n in filled.items()
          if rows and c not in always and (n == 0 or n / rows < cfg.min_fill)]
    )
    typed = fill_int(to_numeric(with_year(parse_dates(pruned, formats=cfg.date_formats))))
    return dedup_keep_last(null_junk(typed, cfg.junk), cfg.key, ("_order",)).drop("_order")
