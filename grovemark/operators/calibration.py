"""Calibration and selective risk of (conf, label) samples, label 0 or 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovemark.operators.quality import ratio

Z95 = 1.959963984540054


def width_bin(conf: Column, bins: int) -> Column:
    """Number of the equal-width bin of [0, 1]; half-open, the last closed."""
    return F.least(F.floor(conf * bins), F.lit(bins - 1)).cast("int")


def width_bins(sample: DataFrame, bins: int, *by: str) -> DataFrame:
    """by, bin, n, mean_conf, accuracy; empty bins do not appear."""
    return sample.withColumn("bin", width_bin(F.col("conf"), bins)).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean_conf"), F.avg("label").alias("accuracy"))


def mass_bins(sample: DataFrame, bins: int) -> DataFrame:
    """Bins between exact quantiles, whose ends are stretched to 0 and 1. The bounds are one small array."""
    inner = F.percentile("conf", F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("edges")
    met = sample.crossJoin(F.broadcast(sample.agg(inner)))
    place = F.size(F.filter("edges", lambda e: e <= F.col("conf")))
    return met.withColumn("bin", place).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean_conf"), F.avg("label").alias("accuracy"))


def ece(bins: DataFrame, *by: str) -> DataFrame:
    gap = F.abs(F.col("accuracy") - F.col("mean_conf")) * F.col("n")
    return bins.groupBy(*by).agg(ratio(F.sum(gap), F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def brier(sample: DataFrame, *by: str) -> DataFrame:
    return sample.groupBy(*by).agg(F.avg(F.pow(F.col("conf") - F.col("label"), 2)).alias("brier"), F.count(F.lit(1)).alias("n"))


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    p, n = successes / n, n.cast("double")
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def discrete_scores(sample: DataFrame) -> DataFrame:
    """Each distinct score with its frequency and its interval."""
    g = sample.groupBy(F.round("conf", 6).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))
    low, high = wilson(F.col("positives"), F.col("n"))
    return g.select("score", "n", "positives", (F.col("positives") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def monotone_bins(sample: DataFrame, most: int) -> DataFrame:
    """The largest number of equal-mass bins, from 2 up, before the accuracies first fail to rise. Scores are counted first,
    so a candidate works on distinct scores; a score's bin follows from how many values lie below it."""
    order = Window.orderBy("conf")
    atoms = sample.groupBy("conf").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y"))
    atoms = atoms.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    tried = atoms.withColumn("m", F.explode(F.sequence(F.lit(2), F.lit(most)))).withColumn("bin", F.floor(F.col("before") * F.col("m") / F.col("total")))
    acc = tried.groupBy("m", "bin").agg((F.sum("y") / F.sum("n")).alias("a"))
    falls = acc.withColumn("was", F.lag("a").over(Window.partitionBy("m").orderBy("bin"))).where("a < was").agg(F.min("m").alias("bad"))
    return falls.select((F.coalesce("bad", F.lit(most + 1)) - 1).alias("bins"))


def risk_coverage(sample: DataFrame) -> DataFrame:
    """One row per distinct threshold: the share covered, the risk among the covered, and that over all. Losses are summed
    per score before the running sum, so the window sees distinct scores only."""
    atoms = sample.groupBy("conf").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("label")).alias("loss"))
    down = Window.orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, 0)
    run = atoms.select("conf", F.sum("n").over(down).alias("covered"), F.sum("loss").over(down).alias("lost"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return run.select(F.col("conf").alias("threshold"), (F.col("covered") / F.col("total")).alias("coverage"), (F.col("lost") / F.col("covered")).alias("risk"), (F.col("lost") / F.col("total")).alias("generalized_risk"))


def aurc(sample: DataFrame) -> DataFrame:
    """Areas under risk and generalised risk over coverage. Within a tie each loss is the tie's mean, so a tie of n scores
    after c others with l losses adds the sums of (l + j m) / (c + j) and l + j m for j = 1 to n."""
    atoms = sample.groupBy("conf").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("label")).cast("double").alias("loss"))
    before = Window.orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, -1)
    run = atoms.select("n", (F.col("loss") / F.col("n")).alias("m"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("c"), F.coalesce(F.sum("loss").over(before), F.lit(0.0)).alias("l"))
    steps = run.withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    at = F.col("l") + F.col("j") * F.col("m")
    return steps.agg(F.avg(at / (F.col("c") + F.col("j"))).alias("aurc"), (F.sum(at) / (F.count(F.lit(1)) * F.count(F.lit(1)).cast("double"))).alias("augrc"))


def auc(scored: DataFrame) -> DataFrame:
    """Mann-Whitney AUC of (score, label) with mid-ranks for ties, over counts of distinct scores."""
    atoms = scored.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = atoms.select("p", "q", (F.col("p") * (below + F.col("q") / 2.0)).alias("w"))
    return won.agg(F.try_divide(F.sum("w"), F.sum("p") * F.sum("q").cast("double")).alias("auc"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
