"""Where the modules of queries put them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six decimals and integers as long, as the comparison wants them."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, columns: str = "", oracle: str | None = None):
    """Registers a function of (spark, sf_dir). columns: the oracle's, each as name:i (integer), :d (double) or :s."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = lambda spark, d: tidy(f(spark, d))
        if oracle is not None:
            as_ = {"i": "CAST({0} AS BIGINT)", "d": "round(CAST({0} AS DOUBLE), 6) + 0.0", "s": "{0}"}
            ORACLES[name] = f"SELECT {', '.join(as_[k].format(n) + ' AS ' + n for n, k in (c.split(':') for c in columns.split()))} FROM ({oracle})"
        return f

    return put
