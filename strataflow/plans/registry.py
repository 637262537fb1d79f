"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapter import Adapter, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: list[str] | None = None, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``sql`` runs over the same views in DuckDB."""

    def keep(fn: Callable[[Adapter], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Adapter(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(views, sql) if views else sql
        return fn

    return keep


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every DOUBLE column, so that summation order does not show."""

    def cut(col: str):
        n = special.get(col, digits)
        return F.round(F.col(col), n).alias(col)

    return df.select(*[cut(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def mean_sql(column: str) -> str:
    """The mean of positive values to six digits in whole numbers: to nine digits, then to six, as Spark has it."""
    ninth = f"(sum(cast(round({column} * 1000000000) as hugeint)) * 2 + count({column})) // (2 * count({column}))"
    return f"cast(({ninth} + 500) // 1000 as double) / 1e6"


def single(df: DataFrame, *columns: str) -> DataFrame:
    """The columns in single precision, for means that lie exactly between two decimal values.

    Seven significant digits stay, and no mean of few decimals lies between two binary fractions.
    """
    return df.withColumns({c: F.col(c).cast("float").cast("double") for c in columns})
