"""Folds, paired randomisation and threshold selection over per-report counts.

Draws are arithmetic on integer ids, so every engine and every rerun draws the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovemark.operators.quality import ratio

# Fixed values of the draw: an odd multiplier, a prime modulus below 2^31.
STEP, PRIME = 48271, 2147483647


def draw(key: Column, seed: Column) -> Column:
    """A pseudo-random number below PRIME for a key and a seed."""
    return ((key % 1000003 + seed * 7919 + 11) * STEP % PRIME) * STEP % PRIME


#: Multipliers of the mixed hash, below 2^31 so that no product passes 2^63, and the step between draws.
MIX, SPREAD, LOW = (0x7FEB352D, 0x2C1B3C6D), 0x9E3779B1, 0xFFFFFFFF
#: Of 2^32 hash values those below POISSON[k] weigh at most k: the cumulative Poisson(1) law.
POISSON = [t for k in range(20) if (t := round(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)))) < 2**32]


def mixed(rows: DataFrame, c: str) -> DataFrame:
    """rows with the integer column c hashed to 32 bits. Unlike draw(), which is linear in key and seed, no draw is a shifted
    copy of another. A column a step, so that none is computed twice."""
    for shift, by in ((16, MIX[0]), (15, MIX[1])):
        rows = rows.withColumn(c, F.col(c).bitwiseXOR(F.shiftright(c, shift))).withColumn(c, (F.col(c) * by).bitwiseAND(F.lit(LOW)))
    return rows.withColumn(c, F.col(c).bitwiseXOR(F.shiftright(c, 16)))


def poisson_draws(units: DataFrame, n: int = 10_000) -> DataFrame:
    """draw, f1: micro-F1 of n resamples of per-report counts, each report weighed by a Poisson(1) number of the hash of
    (report, draw), the resampling with replacement of a cohort whose size varies too. Every engine draws the same."""
    own = mixed(units.select(F.col("report").cast("long").bitwiseAND(F.lit(LOW)).alias("h"), "tp", (2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("den")), "h")
    drawn = own.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    h = mixed(drawn.withColumn("h", (F.col("h") + F.col("draw") * F.lit(SPREAD)).bitwiseAND(F.lit(LOW))), "h")
    w = F.when(F.col("h") < POISSON[0], 0)
    for k, t in enumerate(POISSON[1:], 1):
        w = w.when(F.col("h") < t, k)
    weighed = h.withColumn("w", w.otherwise(len(POISSON)))
    return weighed.groupBy("draw").agg(ratio(2 * F.sum(F.col("tp") * F.col("w")), F.sum(F.col("den") * F.col("w"))).alias("f1"))


def stratified_folds(reports: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """report, stratum, fold: within a stratum in shuffled order dealt round, each stratum starting where the last ended."""
    order = Window.partitionBy("stratum").orderBy("h", "report")
    dealt = reports.withColumn("h", draw(F.col("report"), F.lit(seed))).withColumn("place", F.row_number().over(order) - 1)
    sizes = reports.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return dealt.join(F.broadcast(starts), "stratum").select("report", "stratum", ((F.col("place") + F.col("start")) % k).alias("fold"))


def paired_randomisation(a: DataFrame, b: DataFrame, n: int = 200) -> DataFrame:
    """Two systems' per-report counts tp, fp, fn: observed micro-F1 difference and its two-sided p-value, (1 + hits) /
    (1 + n), over n draws that swap the systems of a report with probability one half. Only counts are permuted."""
    side = lambda d, s: d.select("report", *[F.col(c).alias(f"{c}_{s}") for c in ("tp", "fp", "fn")])
    both = side(a, "a").join(side(b, "b"), "report", "full").na.fill(0)
    drawn = both.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n))))
    swap = (F.col("draw") > 0) & (draw(F.col("report"), F.col("draw")) % 2 == 1)
    pick = lambda c, x, y: F.sum(F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")))
    f1 = lambda x, y: ratio(2 * pick("tp", x, y), 2 * pick("tp", x, y) + pick("fp", x, y) + pick("fn", x, y))
    per = drawn.groupBy("draw").agg((f1("a", "b") - f1("b", "a")).alias("d"))
    seen = per.crossJoin(F.broadcast(per.where("draw = 0").select(F.col("d").alias("observed"))))
    hit = (F.col("draw") > 0) & (F.abs("d") >= F.abs("observed") - 1e-12)
    return seen.agg(F.max("observed").alias("observed"), ((1 + F.count_if(hit)) / F.lit(1.0 + n)).alias("p"))


def threshold_counts(scored: DataFrame, grid: list[float], *by: str) -> DataFrame:
    """tau, by, tp, fp, fn of scored(score null where not predicted, y: is it gold) at each threshold, inclusive."""
    t = scored.withColumn("tau", F.explode(F.array(*map(F.lit, grid))))
    yes = F.coalesce(F.col("score") >= F.col("tau"), F.lit(False))
    return t.groupBy("tau", *by).agg(F.count_if(yes & F.col("y")).alias("tp"), F.count_if(yes & ~F.col("y")).alias("fp"), F.count_if(~yes & F.col("y")).alias("fn"))


def f1_of(counts: DataFrame, *by: str) -> DataFrame:
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    return counts.groupBy("tau", *by).agg(ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def best_threshold(curve: DataFrame, *by: str) -> DataFrame:
    """by, tau, f1 with the greatest f1 to nine digits; ties to the smallest tau."""
    top = F.min(F.struct((-F.round("f1", 9)).alias("o"), "tau", "f1")).alias("t")
    return curve.groupBy(*by).agg(top).select(*by, "t.tau", "t.f1")


def transfer_gap(scored: DataFrame, grid: list[float], cohort: str) -> DataFrame:
    """Threshold fitted on cohort 0 and applied to cohort 1, against the best that cohort 1 allows: one row."""
    curve = f1_of(threshold_counts(scored, grid, cohort), cohort)
    best = best_threshold(curve, cohort)
    fit = best.where(f"{cohort} = 0").select(F.col("tau").alias("tau_fit"), F.col("f1").alias("f1_fit"))
    own = best.where(f"{cohort} = 1").select(F.col("tau").alias("tau_oracle"), F.col("f1").alias("f1_oracle"))
    moved = curve.where(f"{cohort} = 1").select(F.col("tau").alias("tau_fit"), F.col("f1").alias("f1_transfer"))
    return fit.join(moved, "tau_fit").crossJoin(own).withColumn("gap", F.col("f1_oracle") - F.col("f1_transfer"))


def crossval_select(scored: DataFrame, folds: DataFrame, grid: list[float]) -> DataFrame:
    """fold, tau, f1_train, f1_held: per fold the threshold that is best on the other folds, and its quality here. Counts are
    taken once per fold; a training curve is the total less the fold's own."""
    per = threshold_counts(scored.join(folds.select("report", "fold"), "report"), grid, "fold")
    total = per.groupBy("tau").agg(*[F.sum(c).alias(f"all_{c}") for c in ("tp", "fp", "fn")])
    rest = per.join(total, "tau").select("tau", "fold", *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in ("tp", "fp", "fn")])
    best = best_threshold(f1_of(rest, "fold"), "fold").withColumnRenamed("f1", "f1_train")
    return best.join(f1_of(per, "fold").withColumnRenamed("f1", "f1_held"), ["fold", "tau"]).select("fold", "tau", "f1_train", "f1_held")
