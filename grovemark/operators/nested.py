"""The nested protocol on a replayed walk: an expansion threshold by risk control, then acceptance by inner folds, judged on
reports that took no part in either.

space(*by, pooling, report, term, r, score, n_calls): every term of every report with its widest path r and score under one
way of pooling; by tells variants apart (an index, a number of segments). folds(report, fold, inner): fold holds a report
out; inner parts the training reports. All choices are rows of one plan, for all folds and variants together.

Terms that agree in everything the protocol looks at may be one row: n, where space and gold have it, is how many terms stand
behind a row, and term then names the kind. Each count here is a sum of n.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemark.operators.quality import ratio


def grid_column(values: Sequence[float]) -> Column:
    """One row per value; integers stay integers."""
    return F.explode(F.array(*map(F.lit, values)))


def weight(rows: DataFrame) -> Column:
    return F.col("n") if "n" in rows.columns else F.lit(1)


def distinct_gold(gold: DataFrame) -> DataFrame:
    return gold.select("report", "term", weight(gold).alias("n")).distinct()


def count_where(on: Column, n: Column) -> Column:
    return F.sum(F.when(on, n).otherwise(0))


def miss_rates(space: DataFrame, gold: DataFrame, reports: DataFrame, taus: Sequence[float], *by: str) -> DataFrame:
    """by, pooling, report, tau, n_gold, miss: the share of a report's gold that a threshold leaves unvisited; terms outside
    the graph are always missed, a report without gold misses nothing."""
    axes = space.select(*by, "pooling").distinct()
    r = space.select(*by, "pooling", "report", "term", "r")
    asked = F.broadcast(axes).crossJoin(distinct_gold(gold)).join(r, [*by, "pooling", "report", "term"], "left")
    low = asked.withColumn("tau", grid_column(taus)).groupBy(*by, "pooling", "report", "tau").agg(F.sum("n").alias("n_gold"), (count_where(F.coalesce("r", F.lit(-1.0)) < F.col("tau"), F.col("n")) / F.sum("n")).alias("miss"))
    every = F.broadcast(axes).crossJoin(reports.select("report").distinct()).withColumn("tau", grid_column(taus))
    return every.join(low, [*by, "pooling", "report", "tau"], "left").na.fill(0, ["n_gold"]).na.fill(0.0, ["miss"])


def calls_at(space: DataFrame, taus: Sequence[float], *by: str) -> DataFrame:
    """by, pooling, report, tau, calls, visited: what a walk at each threshold costs."""
    seen = space.withColumn("tau", grid_column(taus)).where("r >= tau")
    return seen.groupBy(*by, "pooling", "report", "tau").agg(F.sum(F.col("n_calls") * weight(space)).alias("calls"), F.sum(weight(space)).alias("visited"))


def breakpoints(space: DataFrame, gold: DataFrame, floor: float, *by: str) -> DataFrame:
    """by, pooling, tau: every finite width at which some gold term is lost, not below the floor, and the floor itself."""
    at = space.join(gold.select("report", "term").distinct(), ["report", "term"], "left_semi").where(F.col("r") < float("inf"))
    own = at.where(F.col("r") >= floor).select(*by, "pooling", F.col("r").alias("tau"))
    return own.unionByName(space.select(*by, "pooling").distinct().withColumn("tau", F.lit(floor))).distinct()


def training(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """rows(report, ...) once for each fold that trains on the report, with its inner fold."""
    held = folds.select("report", F.col("fold").alias("own"), "inner")
    outer = folds.select("fold").distinct()
    return rows.join(held, "report").crossJoin(F.broadcast(outer)).where("fold <> own").drop("own")


def tau_prune(misses: DataFrame, calls: DataFrame, folds: DataFrame, alpha: float | Column, *by: str) -> DataFrame:
    """by, fold, pooling, tau, risk, bound, feasible, calls: the largest threshold whose corrected risk on the training
    reports is within alpha, else the one of least risk (ties to the larger); calls a report at it."""
    own = [*by, "pooling", "report", "tau"]
    rows = misses.join(calls, own, "left").na.fill(0, ["calls"])
    alpha = F.lit(alpha) if isinstance(alpha, float) else alpha
    at = training(rows, folds).groupBy(*by, "fold", "pooling", "tau").agg(F.avg("miss").alias("risk"), F.count(F.lit(1)).alias("n"), F.avg("calls").alias("calls"))
    at = at.withColumn("bound", F.col("n") / (F.col("n") + 1) * F.col("risk") + 1 / (F.col("n") + 1)).withColumn("feasible", F.round("bound", 9) <= alpha)
    order = F.struct((~F.col("feasible")).alias("a"), F.when(F.col("feasible"), -F.col("tau")).otherwise(F.round("risk", 9)).alias("b"), (-F.col("tau")).alias("c"), "tau", "risk", "bound", "feasible", "calls")
    best = at.groupBy(*by, "fold", "pooling").agg(F.min(order).alias("x"))
    return best.select(*by, "fold", "pooling", *[F.col(f"x.{c}").alias(c) for c in ("tau", "risk", "bound", "feasible", "calls")])


def prune_pooling(choices: DataFrame, *by: str) -> DataFrame:
    """by, fold and the pooling chosen: the cheapest of the feasible; without any the one of least risk, then cost."""
    order = F.struct((~F.col("feasible")).alias("a"), F.when(F.col("feasible"), F.round("calls", 9)).otherwise(F.round("risk", 9)).alias("b"), F.round("calls", 9).alias("c"), "pooling", "tau", "risk", "bound", "feasible", "calls")
    best = choices.groupBy(*by, "fold").agg(F.min(order).alias("x"))
    return best.select(*by, "fold", F.col("x.pooling").alias("pool_pr"), F.col("x.tau").alias("tau_prune"), *[F.col(f"x.{c}").alias(c) for c in ("risk", "bound", "feasible", "calls")])


def candidates(space: DataFrame, chosen: DataFrame, gold: DataFrame, folds: DataFrame, leaf: Column, *by: str) -> DataFrame:
    """by, fold, report, inner, own, pool_acc, score, y: what each fold's walk visits among terms that may be predicted,
    under every acceptance pooling, and gold that it does not visit (score null). own: is the report held out there."""
    y = distinct_gold(gold).withColumnRenamed("n", "n_gold").withColumn("y", F.lit(1))
    visited = space.where(leaf).join(F.broadcast(chosen.select(*by, "fold", F.col("pool_pr").alias("pooling"), "tau_prune")), [*by, "pooling"]).where("r >= tau_prune").select(*by, "fold", "report", "term")
    scored = visited.join(space.select(*by, F.col("pooling").alias("pool_acc"), "report", "term", "score", weight(space).alias("n")), [*by, "report", "term"])
    axes = space.select(*by, F.col("pooling").alias("pool_acc")).distinct().crossJoin(F.broadcast(chosen.select("fold").distinct()))
    every = F.broadcast(axes).crossJoin(y)
    met = scored.join(every, [*by, "fold", "pool_acc", "report", "term"], "full").na.fill(0, ["y"]).withColumn("n", F.coalesce("n", "n_gold")).drop("n_gold")
    held = folds.select("report", F.col("fold").alias("home"), "inner")
    return met.join(held, "report").withColumn("own", F.col("home") == F.col("fold")).drop("home")


def outcomes(yes: Column, y: Column, n: Column) -> list[Column]:
    """tp, fp, fn as sums of n."""
    return [count_where(on, n).alias(c) for c, on in (("tp", yes & y), ("fp", yes & ~y), ("fn", ~yes & y))]


def accept_counts(rows: DataFrame, taus: Sequence[float], *by: str) -> DataFrame:
    yes = F.coalesce(F.col("score") >= F.col("tau_accept"), F.lit(False))
    y = F.col("y") == 1
    return rows.withColumn("tau_accept", grid_column(taus)).groupBy(*by, "tau_accept").agg(*outcomes(yes, y, weight(rows)))


def f1() -> Column:
    return ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def acceptance(rows: DataFrame, taus: Sequence[float], *by: str) -> DataFrame:
    """by, fold, pool_acc, tau_accept, inner_f1: the best mean of the inner folds' micro F1; ties to the earlier pooling, then
    the higher threshold."""
    per = accept_counts(rows.where("not own"), taus, *by, "fold", "pool_acc", "inner").withColumn("f1", f1())
    mean = per.groupBy(*by, "fold", "pool_acc", "tau_accept").agg(F.avg("f1").alias("inner_f1"))
    order = F.struct((-F.round("inner_f1", 9)).alias("a"), "pool_acc", (-F.col("tau_accept")).alias("b"), "inner_f1")
    best = mean.groupBy(*by, "fold").agg(F.min(order).alias("x"))
    return best.select(*by, "fold", "x.pool_acc", (-F.col("x.b")).alias("tau_accept"), "x.inner_f1")


def pooled(rows: DataFrame, accepted: DataFrame, *by: str) -> DataFrame:
    """by, report, tp, fp, fn: every report under the choices of the fold that held it out."""
    met = rows.where("own").join(F.broadcast(accepted.select(*by, "fold", "pool_acc", "tau_accept")), [*by, "fold", "pool_acc"])
    yes, y = F.coalesce(F.col("score") >= F.col("tau_accept"), F.lit(False)), F.col("y") == 1
    return met.groupBy(*by, "report").agg(*outcomes(yes, y, weight(met)))


def quality(units: DataFrame, *by: str) -> DataFrame:
    c = units.groupBy(*by).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(*by, "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1().alias("f1"))


def operating_point(space: DataFrame, chosen: DataFrame, gold: DataFrame, folds: DataFrame, *by: str) -> DataFrame:
    """by, calls a report, and the gold visited, over all gold (micro) and on the mean of reports (macro), each report under
    its own fold's threshold."""
    at = chosen.select(*by, "fold", F.col("pool_pr").alias("pooling"), "tau_prune")
    seen = space.join(folds.select("report", "fold"), "report").join(F.broadcast(at), [*by, "fold", "pooling"]).where("r >= tau_prune")
    calls = seen.groupBy(*by, "report").agg(F.sum(F.col("n_calls") * weight(seen)).alias("calls"))
    hit = seen.select(*by, "report", "term").withColumn("hit", F.lit(1))
    variants = chosen.select(*by).distinct() if by else None
    g = distinct_gold(gold)
    g = g.crossJoin(F.broadcast(variants)) if by else g
    cover = g.join(hit, [*by, "report", "term"], "left").groupBy(*by, "report").agg(count_where(F.col("hit") == 1, F.col("n")).alias("k"), F.sum("n").alias("n"))
    every = folds.select("report").crossJoin(F.broadcast(variants)) if by else folds.select("report")
    met = every.join(calls, [*by, "report"], "left").join(cover, [*by, "report"], "left").na.fill(0, ["calls", "n", "k"])
    miss = ratio(F.col("n") - F.col("k"), F.col("n"))
    return met.groupBy(*by).agg(F.avg("calls").alias("calls_per_report"), ratio(F.sum("k"), F.sum("n")).alias("coverage_micro"), (1 - F.avg(miss)).alias("coverage_macro"), F.count(F.lit(1)).alias("n_reports"))


def stability(choices: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, mode, modal_share, n_distinct of the folds' choices; of equally common values the smallest."""
    long = choices.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("x.field", "x.value")
    n = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("field").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("x"), F.sum("n").alias("t"), F.count(F.lit(1)).alias("n_distinct")).select("field", F.col("x.value").alias("mode"), (-F.col("x.m") / F.col("t")).alias("modal_share"), "n_distinct")


def paired_interval(a: DataFrame, b: DataFrame, n: int = 10_000) -> DataFrame:
    """One row: the difference of two systems' micro F1, its 95 % interval over n resamples of the same reports for both, and
    twice the share of resamples on the far side of 0."""
    from grovemark.operators.resampling import poisson_draws

    named = lambda rows, s: poisson_draws(rows, n).withColumnRenamed("f1", s)
    both = named(a, "a").join(named(b, "b"), "draw").select((F.col("a") - F.col("b")).alias("d"))
    whole = quality(a).select(F.col("f1").alias("x")).crossJoin(quality(b).select(F.col("f1").alias("y")))
    spread = both.agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"), F.avg((F.col("d") <= 0).cast("double")).alias("down"), F.avg((F.col("d") >= 0).cast("double")).alias("up"))
    return whole.crossJoin(spread).select((F.col("x") - F.col("y")).alias("delta"), "low", "high", F.least(F.lit(1.0), 2 * F.least("down", "up")).alias("p"))
