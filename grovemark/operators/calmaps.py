"""Maps from scores to probabilities, fitted on (conf, label) samples, and what they change.

Samples are first counted by distinct score; fits then read those counts only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovemark.functions.codes import logit, sigmoid
from grovemark.operators.quality import ratio

#: Of the grid on which a threshold is sought in the raw score; Newton steps; strength of the penalty on the slope.
GRID, STEPS, PENALTY = 20_001, 25, 1.0


def atoms(sample: DataFrame, *by: str) -> DataFrame:
    """by, conf, n, y: rows and positives of each distinct score."""
    return sample.groupBy(*by, F.col("conf").cast("double").alias("conf")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y"))


def platt(counted: DataFrame, *by: str, steps: int = STEPS) -> DataFrame:
    """by, slope, intercept of the logistic fit with half a squared slope as penalty, by Newton's method. Each step is one
    aggregation over the distinct scores, of all groups together; what comes back is two numbers a group."""
    keys = list(by) or ["__one"]
    rows = counted if by else counted.withColumn("__one", F.lit(0))
    spark = counted.sparkSession
    now = rows.select(*keys).distinct().withColumns({"slope": F.lit(0.0), "intercept": F.lit(0.0)}).toPandas()
    kind = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", slope double, intercept double"
    p = sigmoid(F.col("slope") * F.col("conf") + F.col("intercept"))
    w, r = F.col("n") * p * (1 - p), F.col("y") - F.col("n") * p
    for _ in range(steps):
        met = rows.join(F.broadcast(spark.createDataFrame(now, kind)), keys)
        s = met.groupBy(*keys, "slope", "intercept").agg(F.sum(r * F.col("conf")).alias("g1"), F.sum(r).alias("g0"), F.sum(w * F.col("conf") * F.col("conf")).alias("h11"), F.sum(w * F.col("conf")).alias("h10"), F.sum(w).alias("h00")).toPandas()
        g1, h11 = s["g1"] - PENALTY * s["slope"], s["h11"] + PENALTY
        det = h11 * s["h00"] - s["h10"] ** 2
        d1, d0 = (s["h00"] * g1 - s["h10"] * s["g0"]) / det, (h11 * s["g0"] - s["h10"] * g1) / det
        now = s[keys].assign(slope=s["slope"] + d1, intercept=s["intercept"] + d0)
        if float(np.abs(np.concatenate([d1, d0])).max(initial=0)) < 1e-12:
            break
    return spark.createDataFrame(now[[*keys, "slope", "intercept"]], kind).drop("__one")


def apply_platt(rows: DataFrame, fit: DataFrame, *by: str, conf: str = "conf", name: str = "mapped") -> DataFrame:
    """rows with the mapped score; fit has one row per group."""
    met = rows.join(F.broadcast(fit), list(by)) if by else rows.crossJoin(F.broadcast(fit))
    return met.withColumn(name, sigmoid(F.col("slope") * F.col(conf) + F.col("intercept"))).drop("slope", "intercept")


def isotonic(counted: DataFrame) -> DataFrame:
    """conf, h: the rising fit at each distinct score, by Spark's own pooling of violators."""
    from pyspark.ml.regression import IsotonicRegression

    rows = counted.select(F.col("conf").alias("features"), (F.col("y") / F.col("n")).alias("label"), F.col("n").cast("double").alias("weight"))
    model = IsotonicRegression(weightCol="weight").fit(rows)
    knots = counted.sparkSession.createDataFrame(pd.DataFrame({"conf": model.boundaries.toArray(), "h": model.predictions.toArray()}))
    return at_knots(counted.select("conf"), knots)


def at_knots(rows: DataFrame, knots: DataFrame) -> DataFrame:
    """rows(conf) with h: linear between the knots(conf, h), constant beyond the first and last; the knots, one or two for
    each step of the fit, are sent to the tasks as one array."""
    all_ = knots.agg(F.array_sort(F.collect_list(F.struct(F.col("conf").alias("x"), F.col("h").alias("y")))).alias("knots"))
    met = rows.crossJoin(F.broadcast(all_))
    k = F.size(F.filter("knots", lambda p: p.x <= F.col("conf")))
    lo, hi = F.try_element_at("knots", F.greatest(k, F.lit(1))), F.try_element_at("knots", F.least(k + 1, F.size("knots")))
    slope = F.coalesce(F.try_divide(hi.y - lo.y, hi.x - lo.x), F.lit(0.0))
    return met.withColumn("h", F.when(k == 0, F.element_at("knots", 1).y).otherwise(lo.y + slope * F.greatest(F.col("conf") - lo.x, F.lit(0.0)))).drop("knots")


def usable(counted: DataFrame, *by: str, least: int = 5) -> DataFrame:
    """by, fits: whether a group has enough positives, and some negatives, for any fit; else the identity stands in."""
    g = counted.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    return g.select(*by, "n", "y", ((F.col("y") >= least) & (F.col("y") < F.col("n"))).alias("fits"))


def grid(spark, points: int = GRID) -> DataFrame:
    return spark.range(points).select((F.col("id") / (points - 1)).alias("conf"))


def inverse_threshold(mapped: DataFrame, taus: list[float]) -> DataFrame:
    """tau, raw: the first raw score of mapped(conf, h) at which h reaches tau; infinite where it never does."""
    met = mapped.withColumn("tau", F.explode(F.array(*map(F.lit, taus))))
    return met.groupBy("tau").agg(F.coalesce(F.min(F.when(F.col("h") >= F.col("tau"), F.col("conf"))), F.lit(float("inf"))).alias("raw"))


def f1_diagnostic(sample: DataFrame) -> DataFrame:
    """One row: the score that is the best threshold for pairwise F1, that F1, half of it, and the gap between threshold and
    half. Of equal ones the highest score; a threshold never parts equal scores."""
    down = Window.orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, 0)
    a = atoms(sample).select("conf", F.sum("n").over(down).alias("k"), F.sum("y").over(down).alias("tp"), F.sum("y").over(Window.partitionBy()).alias("all"))
    best = a.select("conf", ratio(2 * F.col("tp"), F.col("k") + F.col("all")).alias("f1")).agg(F.min(F.struct((-F.round("f1", 12)).alias("o"), (-F.col("conf")).alias("c"), "f1")).alias("b"))
    return best.select((-F.col("b.c")).alias("best_threshold"), F.col("b.f1").alias("best_f1"), (F.col("b.f1") / 2).alias("half_optimal_f1"), (-F.col("b.c") - F.col("b.f1") / 2).alias("gap"))


def smooth_ece(sample: DataFrame, *by: str, cells: int = 1000, eps: float = 1e-3) -> DataFrame:
    """by, smooth_ece: the kernel-smoothed calibration error at the width that equals it.

    Residuals are spread to the two nearest points of a grid of [0, 1] by partial aggregation; each group then has at most
    cells + 1 numbers. They are smoothed by a Gaussian that is reflected at both ends; the width is found by halving."""
    at = F.least(F.floor(F.col("conf") * cells), F.lit(cells - 1))
    part = F.col("conf") * cells - at
    r = F.col("label") - F.col("conf")
    spread = sample.select(*by, F.explode(F.array(F.struct(at.alias("i"), (r * (1 - part)).alias("m"), F.lit(1).alias("n")), F.struct((at + 1).alias("i"), (r * part).alias("m"), F.lit(0).alias("n")))).alias("e"))
    mass = spread.groupBy(*by, F.col("e.i").cast("int").alias("i")).agg(F.sum("e.m").alias("m"), F.sum("e.n").alias("n"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(cells + 1)
        x[part["i"].to_numpy()] = part["m"].to_numpy() / part["n"].sum()
        return pd.DataFrame({**{c: [part[c].iloc[0]] for c in keys}, "smooth_ece": [at_own_width(x, eps)]})

    keys = list(by) or ["one"]
    rows = mass if by else mass.withColumn("one", F.lit(0))
    kind = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", smooth_ece double"
    return rows.groupBy(*keys).applyInPandas(one, kind).drop("one")


def smoothed(x: np.ndarray, width: float) -> float:
    """The summed absolute value of residuals on an even grid of [0, 1] after smoothing."""
    n = len(x) - 1
    points = np.arange(n + 1) / n
    total = np.zeros(n + 1)
    held = np.nonzero(x)[0]
    reach = int(np.ceil(4 * width))
    for k in range(-reach, reach + 1):
        for mirror in (points[held] + 2 * k, -points[held] + 2 * k):
            total += np.exp(-0.5 * ((points[:, None] - mirror[None, :]) / width) ** 2) @ x[held]
    return float(np.abs(total).sum() / (n * width * np.sqrt(2 * np.pi)))


def at_own_width(x: np.ndarray, eps: float) -> float:
    low, high = eps, 1.0
    while high - low > eps:
        mid = (low + high) / 2
        if smoothed(x, mid) < mid:
            high = mid
        else:
            low = mid
    return smoothed(x, high)


def histogram(rows: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """bin, label, n: equal-width bins between low and high, shared by both classes; what lies beyond joins the end bins."""
    at = F.greatest(F.lit(0), F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1)))
    return rows.groupBy(at.cast("int").alias("bin"), "label").agg(F.count(F.lit(1)).alias("n"))


def survival(rows: DataFrame, value: Column, cuts: list[float]) -> DataFrame:
    """cut, label, share: the share of each class at or above each cut."""
    met = rows.select("label", value.alias("v")).withColumn("cut", F.explode(F.array(*map(F.lit, cuts))))
    return met.groupBy("cut", "label").agg(F.avg((F.col("v") >= F.col("cut")).cast("double")).alias("share"))


def average_precision(scored: DataFrame, *by: str) -> DataFrame:
    """by, auc, average_precision of scored(by, conf, label); both over distinct scores, so ties share."""
    a = atoms(scored, *by)
    up = Window.partitionBy(*by).orderBy("conf").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*by).orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.col("n") - F.col("y")
    run = a.select(*by, "y", q.alias("q"), F.coalesce(F.sum(q).over(up), F.lit(0)).alias("below"), F.sum("n").over(down).alias("k"), F.sum("y").over(down).alias("tp"))
    return run.groupBy(*by).agg(F.try_divide(F.sum(F.col("y") * (F.col("below") + F.col("q") / 2.0)), F.sum("y") * F.sum("q").cast("double")).alias("auc"), F.try_divide(F.sum(F.col("y") * F.col("tp") / F.col("k")), F.sum("y")).alias("average_precision"))


def on_logits(sample: DataFrame) -> DataFrame:
    return sample.withColumn("conf", logit(F.col("conf")))
