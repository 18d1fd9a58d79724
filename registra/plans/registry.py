"""Registry of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def quoted(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def dec_round(expr: str, n: int) -> str:
    """SQL for rounding half away from zero on the decimal value."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,15)), {n}) AS DOUBLE)"


def money(expr: str) -> str:
    """SQL for an exact sum of money."""
    return f"CAST(sum(CAST({expr} AS DECIMAL(22,5))) AS DOUBLE)"


# Unicode-aware strip in the dialect of the checking engine
SQL_BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{SQL_BLANK}+|{SQL_BLANK}+$', '', 'g')"


def sql_fixed(expr: str, n: int) -> str:
    """SQL for decimal text rounded from the exact binary value, ties upwards.

    The formatter rounds exact ties to even. They occur only at multiples of a power of two, which
    a small addition lifts above the tie.
    """
    steps = 2 ** (n + 1)
    lift = f"CASE WHEN ({expr}) * {steps} = floor(({expr}) * {steps}) THEN 0.1 / {10**n} ELSE 0 END"
    return f"format('{{:.{n}f}}', CAST(({expr}) + {lift} AS DOUBLE))"
