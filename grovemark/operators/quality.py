"""Set-overlap quality of predicted against gold (report, term) pairs.

Pairs are distinct long rows. A zero denominator gives 0; a report without gold and prediction counts as perfect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def aligned(gold: DataFrame, pred: DataFrame, keys: tuple[str, ...] = ("report", "term")) -> DataFrame:
    """Full outer join of the distinct pairs: keys, g and p (is it gold, is it predicted). One shuffle by the pair, which
    later groupings by report reuse only after another; pairs are narrow."""
    g = gold.select(*keys).distinct().withColumn("g", F.lit(1))
    p = pred.select(*keys).distinct().withColumn("p", F.lit(1))
    return g.join(p, list(keys), "full").select(*keys, F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))


def counted(pairs: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn over the groups of `by`."""
    return pairs.groupBy(*by).agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum((1 - F.col("g")) * F.col("p")).alias("fp"), F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"))


def flat_units(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return counted(aligned(gold, pred), "report")


def micro(gold: DataFrame, pred: DataFrame) -> DataFrame:
    c = counted(aligned(gold, pred))
    return c.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def with_reports(units: DataFrame, reports: DataFrame) -> DataFrame:
    """Units of all reports; those without any pair have zero counts."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return reports.join(units, "report", "left").select("report", zero("tp"), zero("fp"), zero("fn"))


def report_prf(units: DataFrame) -> DataFrame:
    """Per report; both sides empty is 1, 1, 1."""
    empty = (F.col("tp") + F.col("fp") + F.col("fn")) == 0
    return units.select("report", *[F.when(empty, 1.0).otherwise(c).alias(n) for c, n in zip(prf(F.col("tp"), F.col("fp"), F.col("fn")), ("precision", "recall", "f1"), strict=True)])


def macro(per_unit: DataFrame) -> DataFrame:
    m = per_unit.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], F.count(F.lit(1)).alias("n_units"))
    p, r = F.col("macro_precision"), F.col("macro_recall")
    return m.select("*", ratio(2 * p * r, p + r).alias("macro_f1_of_means"))


def term_domains(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Each average over the terms for which it is defined: predicted ones, gold ones, and either."""
    t = counted(aligned(gold, pred), "term")
    t = t.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))
    on_p, on_g = F.col("tp") + F.col("fp") > 0, F.col("tp") + F.col("fn") > 0
    return t.agg(
        F.avg(F.when(on_p, F.col("precision"))).alias("macro_precision"), F.count_if(on_p).alias("n_predicted"),
        F.avg(F.when(on_g, F.col("recall"))).alias("macro_recall"), F.count_if(on_g).alias("n_gold"),
        F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_terms"),
    )


def empty_cases(units: DataFrame) -> DataFrame:
    g, p = F.col("tp") + F.col("fn") > 0, F.col("tp") + F.col("fp") > 0
    return units.agg(F.count_if(g & p).alias("both_sides"), F.count_if(g & ~p).alias("gold_only"), F.count_if(~g & p).alias("pred_only"), F.count_if(~g & ~p).alias("neither"))


def normalised(pairs: DataFrame, scorable: DataFrame, known: DataFrame, side: str) -> DataFrame:
    """Canonical pairs: gold keeps scorable terms; predictions keep scorable ones and those that do not exist, which stay
    false positives; known but unscorable terms go on both sides. Adds `class`; drop counts come from it."""
    s = scorable.select("term").distinct().withColumn("s", F.lit(True))
    k = known.select("term").distinct().withColumn("k", F.lit(True))
    kind = F.when(F.col("s"), "scorable").when(F.col("k"), "out_of_subtree").otherwise("nonexistent")
    out = pairs.join(s, "term", "left").join(k, "term", "left").withColumn("class", kind).drop("s", "k")
    keep = ["scorable"] if side == "gold" else ["scorable", "nonexistent"]
    return out.withColumn("kept", F.col("class").isin(keep))


def diversity(a: DataFrame, b: DataFrame, gold: DataFrame) -> DataFrame:
    """Two systems: Jaccard of their false positives and of their predictions, and who has what alone."""
    both = aligned(a, b).withColumnsRenamed({"g": "a", "p": "b"}).join(gold.select("report", "term").distinct().withColumn("y", F.lit(1)), ["report", "term"], "left")
    wrong = F.col("y").isNull()
    both_, any_ = (F.col("a") * F.col("b")), F.greatest("a", "b")
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(
        ratio(s(F.when(wrong, both_)), s(F.when(wrong, any_))).alias("fp_jaccard"), ratio(s(both_), s(any_)).alias("pred_jaccard"),
        s((F.col("a") - both_)).alias("only_a"), s((F.col("b") - both_)).alias("only_b"), s(both_).alias("shared"),
    )


def marginal_yield(pred: DataFrame, gold: DataFrame, baseline: DataFrame) -> DataFrame:
    g = gold.select("report", "term").distinct()
    has = lambda d, n: d.select("report", "term").distinct().withColumn(n, F.lit(1))
    m = g.join(has(pred, "a"), ["report", "term"], "left").join(has(baseline, "b"), ["report", "term"], "left")
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return m.agg(F.count(F.lit(1)).alias("n_gold"), F.count_if(a).alias("by_method"), F.count_if(b).alias("by_baseline"), F.count_if(a & ~b).alias("gained"), F.count_if(b & ~a).alias("lost"), F.count_if(~a & ~b).alias("missed_by_both"))
