"""Pooling of a (report, term)'s call margins into one score. Scores are sigmoids of margins; fewer than two calls have no
second largest (0). calls(report, term, rank, margin); only the first s ranks count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def pooled(calls: DataFrame, s: int, kappa: float = 2.0, beta: float = 1.0) -> DataFrame:
    """report, term, n and each pooling: p0 (indicator of p1 > 0.5), p1 (max), p2 (second largest), p3 (noisy-or tempered by
    kappa, at least 1), p4 (mean), lse (sigmoid of the log-sum-exp, shifted by the largest). The margins of a group are
    gathered as one array of at most s values."""
    g = calls.where(F.col("rank") <= s).groupBy("report", "term").agg(F.sort_array(F.collect_list("margin"), asc=False).alias("m"))
    p = F.transform("m", sigmoid)
    at = lambda c, i: F.coalesce(F.try_element_at(c, F.lit(i)), F.lit(0.0))
    none = F.aggregate("p", F.lit(1.0), lambda acc, x: acc * (1 - x))
    top = F.element_at("m", 1)
    lse = top + F.log(F.aggregate("m", F.lit(0.0), lambda acc, x: acc + F.exp(beta * (x - top)))) / beta
    return g.withColumn("p", p).select(
        "report", "term", F.size("m").alias("n"), (at(F.col("p"), 1) > 0.5).cast("int").alias("p0"), at(F.col("p"), 1).alias("p1"), at(F.col("p"), 2).alias("p2"),
        (1 - F.pow(none, 1 / max(kappa, 1.0))).alias("p3"), (F.aggregate("p", F.lit(0.0), lambda a, x: a + x) / F.size("p")).alias("p4"), sigmoid(lse).alias("lse"),
    )
