"""Retrieval measured over ranked candidates: by cut-off, by distance in the ontology, by term and by threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovemark.operators.quality import ratio


def ranked(scores: DataFrame) -> DataFrame:
    """scores(report, term, idx, score) with rank: 1 for the highest, ties to the smaller idx."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("report", "term").orderBy(F.desc("score"), "idx")))


def term_pr_at(candidates: DataFrame, gold: DataFrame, reports: DataFrame, cuts: Sequence[int]) -> DataFrame:
    """report, m, hits, n_gold, precision (over m), recall (null without gold), from candidates(report, term, rank)."""
    hit = candidates.where(F.col("rank") <= max(cuts)).join(gold.select("report", "term").distinct(), ["report", "term"], "left_semi")
    n = gold.select("report", "term").distinct().groupBy("report").agg(F.count(F.lit(1)).alias("n_gold"))
    grid = reports.select("report").distinct().join(n, "report", "left").withColumn("m", F.explode(F.array(*map(F.lit, cuts))))
    found = hit.withColumn("m", F.explode(F.array(*map(F.lit, cuts)))).where("rank <= m").groupBy("report", "m").agg(F.count_distinct("term").alias("hits"))
    met = grid.join(found, ["report", "m"], "left").select("report", "m", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("n_gold", F.lit(0)).alias("n_gold"))
    return met.select("*", (F.col("hits") / F.col("m")).alias("precision"), F.try_divide("hits", "n_gold").alias("recall"))


def term_pr_curve(at: DataFrame) -> DataFrame:
    """One row per cut-off: micro and macro precision and recall; recall over the reports with gold."""
    n = F.count(F.lit(1))
    return at.groupBy("m").agg(
        ratio(F.sum("hits"), n * F.first("m")).alias("micro_precision"), F.try_divide(F.sum(F.when(F.col("n_gold") > 0, F.col("hits"))), F.sum("n_gold")).alias("micro_recall"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), n.alias("n_reports"), F.count("recall").alias("n_with_gold"),
    )


def candidate_set_recall(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """report, recall of an unranked set of candidates; reports without gold do not appear."""
    c = candidates.select("report", "term").distinct().withColumn("c", F.lit(1))
    return gold.select("report", "term").distinct().join(c, ["report", "term"], "left").groupBy("report").agg((F.count("c") / F.count(F.lit(1))).alias("recall"))


def combined_bound(retrieval: DataFrame, reach: DataFrame) -> DataFrame:
    """The product of two one-row rates, an upper bound of the recall of both stages; a rate outside [0, 1] is an error."""
    both = retrieval.select(F.col("recall").alias("retrieval")).crossJoin(reach.select(F.col("recall").alias("reach")))
    ok = F.col("retrieval").between(0, 1) & F.col("reach").between(0, 1)
    return both.select("retrieval", "reach", F.when(ok, F.col("retrieval") * F.col("reach")).otherwise(F.raise_error(F.lit("a rate lies outside [0, 1]")).cast("double")).alias("bound"))


def _auc(scores: DataFrame, by: str) -> DataFrame:
    """by, auc: chance that a relevant row scores above another one, ties one half; over counts of distinct scores."""
    y = F.col("relevant").cast("int")
    atoms = scores.groupBy(by, "score").agg(F.sum(y).alias("p"), F.sum(1 - y).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return atoms.withColumn("w", F.col("p") * (below + F.col("q") / 2.0)).groupBy(by).agg(F.try_divide(F.sum("w"), F.sum("p") * F.sum("q").cast("double")).alias("auc"))


def _best(scores: DataFrame, by: str) -> DataFrame:
    """by, report, term, best: the rank of the first relevant row of each query, null without one."""
    return scores.groupBy(by, "report", "term").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("best"))


def by_group(scores: DataFrame, by: str, ks: Sequence[int]) -> DataFrame:
    """by, pairs, relevant rows, mean reciprocal rank, mean and median best rank, AUC, recall at each k: of
    scores(by, report, term, rank, score, relevant)."""
    rows = scores.groupBy(by).agg(F.count_if("relevant").alias("n_relevant"))
    per = _best(scores, by).groupBy(by).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))).alias("mrr"), F.percentile("best", F.lit(0.5)).alias("median_rank"), F.avg("best").alias("mean_rank"),
        *[F.avg(F.coalesce((F.col("best") <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in ks],
    )
    return rows.join(per, by).join(_auc(scores, by), by)


def score_means(scores: DataFrame, by: str) -> DataFrame:
    """by, the mean of each query's highest score, the mean score of relevant rows."""
    top = scores.groupBy(by, "report", "term").agg(F.max("score").alias("top")).groupBy(by).agg(F.avg("top").alias("mean_top1"))
    return top.join(scores.groupBy(by).agg(F.avg(F.when(F.col("relevant"), F.col("score"))).alias("mean_relevant")), by)


def hop_bucket(hops: str, most: int) -> F.Column:
    h = F.col(hops)
    return F.when(h == 0, "0 (annotated)").when(h >= most, f"{most}+").otherwise(h.cast("string"))


def outcomes(calls: DataFrame, predictions: DataFrame) -> DataFrame:
    """outcome, n: of predictions(report, term, gold, pred) with calls(report, term, relevant, yes), by the stage that
    decided: gold pairs whose relevant segments were not retrieved, or all answered no; pairs whose relevance is unknown
    are left out."""
    r = F.col("relevant")
    per = calls.groupBy("report", "term").agg(F.count(r).alias("known"), F.coalesce(F.max(r), F.lit(False)).alias("hit"), F.coalesce(F.max(r & F.col("yes")), F.lit(False)).alias("yes"))
    met = per.join(predictions.where("gold is not null"), ["report", "term"])
    pos = F.when(F.col("known") == 0, None).when(~F.col("hit"), "retrieval_failure").when(~F.col("yes"), "classification_failure").when(F.col("pred") == 1, "true_positive").otherwise("false_negative_other")
    kind = F.when(F.col("gold") == 1, pos).when(F.col("pred") == 1, "false_positive").otherwise("true_negative")
    return met.select(kind.alias("outcome")).where("outcome is not null").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def threshold_grid(scores: DataFrame, pairs: float, points: int) -> DataFrame:
    """k, tau: the score that leaves k rows a pair on the mean, for an even grid of points from 1 to all; counted over
    distinct scores."""
    atoms = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    run = atoms.select("score", F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    grid = scores.sparkSession.range(1, points + 1).select(F.col("id").alias("k"), (F.col("id") * F.lit(float(pairs))).alias("need"))
    return run.join(F.broadcast(grid), run.upto >= grid.need).groupBy("k").agg(F.max("score").alias("tau"))


def survivors(scores: DataFrame, taus: Sequence[float], *by: str) -> DataFrame:
    """tau, by, n: rows at or above each threshold. A row falls into one bucket; the counts are summed from the top."""
    cuts = sorted(taus)
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: t <= F.col("score")))
    n = scores.groupBy(*by, place.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    out = n.withColumn("i", F.explode(F.when(F.col("bucket") > 0, F.sequence(F.lit(1), "bucket")))).groupBy(*by, "i").agg(F.sum("n").alias("n"))
    return out.withColumn("tau", F.element_at(F.array(*map(F.lit, cuts)), F.col("i"))).select("tau", *by, "n")
