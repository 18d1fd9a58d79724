"""Batches of inserts, updates, deletes and upserts on project records.

Each function returns the changed frame and the rows that could not be applied. When a batch names
a key more than once, ``order`` gives the sequence in which the changes were made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registra.sources.tables import KEY, written

# ---- fixed values: attributes a change may set --------------------------------------------
CHANGEABLE = (
    "name", "annotation", "year", "nioktr_types", "budget_total_thousands", "executor_name",
    "supervisor_full_name", "keyword_list",
)
# ---- end of fixed values ------------------------------------------------------------------


def _ranked(df: DataFrame, order: str | None, last: bool, key: str = KEY) -> DataFrame:
    """Number the rows of each key; a row without an order comes after the others."""
    by = F.lit(0) if order is None else (F.desc_nulls_last(order) if last else F.asc_nulls_last(order))
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(by)))


def _aligned(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` with the columns and types of ``like``; attributes it cannot set are null."""
    given = {KEY, *CHANGEABLE} & set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in like.schema.fields
        ]
    )


def apply_inserts(
    base: DataFrame, new: DataFrame, order: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Add records with new keys. Null and known keys, and later repeats of a key, are conflicts.

    Every row of ``new`` is either added or a conflict. Of the rows of a key the first in ``order``
    is added (rows without an order count as last); ties, and all rows without ``order``, are taken
    in no particular order. The rows of a key are never brought together: its first row is an
    aggregate, and rows are told apart by a number given when the batch is written.
    """
    rows = written(new.withColumn("_at", F.monotonically_increasing_id()), "inserts")
    place = [F.col("_at")] if order is None else [F.col(order).isNull(), F.col(order), F.col("_at")]
    first = rows.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.min_by("_at", F.struct(*place)).alias("_at"))
    fresh = first.join(base.select(KEY), KEY, "left_anti").select("_at")
    added = rows.join(fresh, "_at", "left_semi").select(*new.columns)
    conflicts = rows.join(fresh, "_at", "left_anti").select(*new.columns)
    return base.unionByName(_aligned(added, base)), conflicts


def apply_updates(
    base: DataFrame, changes: DataFrame, order: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Overwrite the changeable attributes by key; attributes a change lacks become null.

    The second frame holds the changes whose key is unknown.
    """
    last = _ranked(changes, order, last=True).where("_n = 1")
    values = [
        (F.col(c) if c in changes.columns else F.lit(None)).alias(f"_new_{c}") for c in CHANGEABLE
    ]
    joined = base.join(last.select(KEY, *values, F.lit(True).alias("_hit")), KEY, "left")
    updated = joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{f.name}").cast(f.dataType))
            .otherwise(F.col(f.name))
            .alias(f.name)
            if f.name in CHANGEABLE
            else F.col(f.name)
            for f in base.schema.fields
        ]
    )
    return updated, changes.join(base.select(KEY), KEY, "left_anti").select(*changes.columns)


def apply_deletes(base: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove records by key; the second frame holds the unknown keys."""
    asked = keys.select(KEY).distinct()
    return base.join(asked, KEY, "left_anti"), asked.join(base.select(KEY), KEY, "left_anti")


def upsert(
    base: DataFrame, new: DataFrame, key: str = KEY, order: str | None = None
) -> DataFrame:
    """Replace rows with known keys and add the others; one row per key of ``new`` gets in.

    It is the last in ``order``, or any where there is no order. Rows with a null key replace nothing
    and are all added.
    """
    last = _ranked(new.where(F.col(key).isNotNull()), order, last=True, key=key).where("_n = 1")
    rows = last.select(*base.columns).unionByName(new.where(F.col(key).isNull()).select(*base.columns))
    return base.join(last.select(key), key, "left_anti").unionByName(rows)


def pending(df: DataFrame, done: DataFrame, key: str = KEY) -> DataFrame:
    """Rows whose key is not in ``done``."""
    return df.join(done.select(key), key, "left_anti")
