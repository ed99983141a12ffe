"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import NS
from .views import WITH

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a query and its SQL; ``{W}`` stands for the graph's views ``n`` and ``e``,
    ``{B}`` for the model's prefix."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.replace("{W}", WITH).replace("{B}", NS)
        return f

    return add


def flat(df: DataFrame, *names: str) -> DataFrame:
    """Lists as one string each, for results that any engine compares alike."""
    for n in names:
        df = df.withColumn(n, F.concat_ws("|", n))
    return df
