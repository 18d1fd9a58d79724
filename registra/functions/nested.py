"""Expressions that turn arrays and structs of a raw card into scalar values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from registra.functions.text import strip

SEPARATOR = "; "


def join_strings(c: Column) -> Column:
    """Join a list of strings; empty and null members are left out, an empty list is null."""
    kept = F.filter(c.cast("array<string>"), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(c) > 0, F.array_join(kept, SEPARATOR))


def join_field(c: Column, field: str = "name") -> Column:
    """Join one field of a list of structs; null when nothing is left."""
    names = F.transform(c, lambda x: x.getField(field).cast("string"))
    return F.nullif(F.array_join(F.filter(names, lambda x: x.isNotNull()), SEPARATOR), F.lit(""))


def sum_field(c: Column, field: str = "funds") -> Column:
    """Sum of one text field; unreadable members count as 0, a total of 0 or less is null."""
    amounts = F.transform(
        c, lambda x: F.coalesce(x.getField(field).try_cast("double"), F.lit(0.0))
    )
    total = F.aggregate(amounts, F.lit(0.0), lambda acc, x: acc + x)
    finite = ~F.isnan(total) & (total < float("inf"))
    return F.when((total > 0) & finite, total)


def list_count(c: Column) -> Column:
    """Number of members, 0 for a missing list."""
    return F.when(c.isNull(), 0).otherwise(F.size(c)).cast("int")


def join_first_of(c: Column, fields: Sequence[str]) -> Column:
    """Join the first non-empty field of every member, null when nothing is left."""
    names = F.transform(
        c, lambda x: F.coalesce(*[F.nullif(x.getField(f), F.lit("")) for f in fields])
    )
    return F.nullif(F.array_join(F.filter(names, lambda x: x.isNotNull()), SEPARATOR), F.lit(""))


def full_name(*parts: Column) -> Column:
    """Name parts with one space after each, stripped at the ends; inner gaps stay."""
    joined: list[Column] = []
    for part in parts:
        joined += [F.lit(" "), F.coalesce(part, F.lit(""))]
    return F.nullif(strip(F.concat(*joined[1:])), F.lit(""))
