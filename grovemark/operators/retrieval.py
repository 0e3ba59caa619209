"""Ranking quality of (query, item, rank, relevant) rows, and cosine retrieval over arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays zero."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))


def mrr_recall(ranked: DataFrame, ks: Sequence[int]) -> DataFrame:
    """One row: mean reciprocal rank of the first relevant item (0 without one) and the share of queries with one by k."""
    first = ranked.groupBy("query").agg(F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("r"))
    return first.agg(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"), *[F.avg(F.coalesce((F.col("r") <= k).cast("double"), F.lit(0.0))).alias(f"recall_at_{k}") for k in ks])


def pr_at_s(ranked: DataFrame, grid: Sequence[int]) -> DataFrame:
    """s, precision (by s itself, however short the list), recall (null where nothing is relevant): means over queries."""
    per = ranked.withColumn("s", F.explode(F.array(*map(F.lit, grid)))).groupBy("s", "query").agg(F.sum(F.when(F.col("rank") <= F.col("s"), F.col("relevant")).otherwise(0)).alias("hits"), F.sum("relevant").alias("all"))
    return per.groupBy("s").agg(F.avg(F.col("hits") / F.col("s")).alias("precision"), F.avg(F.try_divide(F.col("hits"), F.col("all"))).alias("recall"))


def random_hit(n: Column, relevant: Column, k: int) -> Column:
    """Chance that k of n drawn without replacement hold a relevant one."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda m, t: m * F.greatest(n - relevant - t, F.lit(0)) / F.greatest(n - t, F.lit(1)))
    return 1 - miss
