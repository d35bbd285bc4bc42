"""Query registration and the number rules shared by queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Rounding happens a little off exact halves, where summation order could decide.
OFF_HALF = 3.3e-8


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its SQL when it has one."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def num(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(OFF_HALF), 6)


def num_sql(expr: str) -> str:
    return f"round(({expr}) + 3.3e-8, 6)"


def money(c: Column | str) -> Column:
    return F.round(c, 2)


def money_sql(expr: str) -> str:
    return f"round({expr}, 2)"


def day(c: str = "t_dat") -> Column:
    return F.col(c).cast("string")


def with_nums(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: num(c) for c in cols})
