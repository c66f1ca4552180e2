"""Query registry: each entry pairs a Spark query with the SQL a checker can run on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.session import safe_unions

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the Parquet tables of one folder: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with its SQL twin when there is one."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(safe_unions(spark), folder))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rnd(c: Column | str, decimals: int = 6) -> Column:
    """Rounding used on both sides of a comparison."""
    return F.round(F.col(c) if isinstance(c, str) else c, decimals)


NUDGE = 0.0000000123
NUDGE_SQL = "0.0000000123::DOUBLE"


def snap(c: Column | str, decimals: int = 6) -> Column:
    """Rounding of means of short decimals: a nudge moves exact halves off the rounding border, where two
    engines that add in another order would part.  SQL side: ``round(x + NUDGE_SQL, decimals)``."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(NUDGE), decimals)
