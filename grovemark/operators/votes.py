"""Votes of several jurors: detections(juror, report, segment, term)."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovemark.operators.quality import ratio


def packed(detections: DataFrame, unit: str) -> DataFrame:
    """juror, report, unit, term, distinct. unit: report, segment, or window (a segment and its two neighbours, around the
    segments in which anything was detected; the centres are shared by all jurors)."""
    d = detections.select("juror", "report", "segment", "term").distinct()
    if unit == "report":
        return d.select("juror", "report", F.lit(0).alias("unit"), "term").distinct()
    if unit == "segment":
        return d.withColumnRenamed("segment", "unit")
    centres = d.select("report", F.col("segment").alias("unit")).distinct()
    near = d.select("juror", "report", F.explode(F.sequence(F.col("segment") - 1, F.col("segment") + 1)).alias("unit"), "term").distinct()
    return near.join(centres, ["report", "unit"], "left_semi")


def max_counts(units: DataFrame) -> DataFrame:
    """report, term, votes: the most jurors that name the term in one unit."""
    return units.groupBy("report", "unit", "term").agg(F.count_distinct("juror").alias("n")).groupBy("report", "term").agg(F.max("n").alias("votes"))


def at_each_k(counts: DataFrame, jurors: int) -> DataFrame:
    """k, report, term: the pairs with at least k votes, for all k from one count."""
    return counts.select(F.explode(F.sequence(F.lit(1), F.least(F.col("votes"), F.lit(jurors)).cast("int"))).alias("k"), "report", "term")


def closure_counts(detections: DataFrame, closed: DataFrame) -> DataFrame:
    """report, term, votes: jurors that name the term or a descendant; one vote each."""
    up = detections.select("juror", "report", "term").distinct().join(closed, F.col("term") == F.col("descendant"))
    return up.groupBy("report", F.col("ancestor").alias("term")).agg(F.count_distinct("juror").alias("votes"))


def plurality(detections: DataFrame) -> DataFrame:
    """report, term: terms with the most votes in some segment, ties kept."""
    votes = detections.groupBy("report", "segment", "term").agg(F.count_distinct("juror").alias("n"))
    best = votes.withColumn("r", F.rank().over(Window.partitionBy("report", "segment").orderBy(F.desc("n"))))
    return best.where("r = 1").select("report", "term").distinct()


def masks(detections: DataFrame) -> DataFrame:
    """report, term, mask: bit i stands for juror i."""
    return detections.groupBy("report", "term").agg(F.bit_or(F.expr("shiftleft(1L, cast(juror as int))")).alias("mask"))


def mask_histogram(detections: DataFrame, gold: DataFrame) -> DataFrame:
    """mask, n_terms, n_gold: at most 2^J rows whatever the size of the cohort."""
    m = masks(detections).join(gold.select("report", "term").distinct().withColumn("y", F.lit(1)), ["report", "term"], "left")
    return m.groupBy("mask").agg(F.count(F.lit(1)).alias("n_terms"), F.count("y").alias("n_gold"))


def subset_f1(histogram: DataFrame, total_gold: int, jurors: int, k: int) -> DataFrame:
    """subset, f1: micro-F1 of every coalition of jurors at k votes (clamped to its size), from the histogram."""
    if jurors > 12:
        raise ValueError("exact coalitions are for 12 jurors at most")
    subsets = histogram.sparkSession.range(1 << jurors).withColumnRenamed("id", "subset")
    # 2^J masks meet 2^J coalitions: a size fixed by the number of jurors.
    met = subsets.join(F.broadcast(histogram), F.bit_count(F.col("mask").bitwiseAND(F.col("subset"))) >= F.greatest(F.lit(1), F.least(F.lit(k), F.bit_count("subset"))), "left")
    s = met.groupBy("subset").agg(F.coalesce(F.sum("n_terms"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_gold"), F.lit(0)).alias("tp"))
    return s.select("subset", F.when(F.col("subset") == 0, 0.0).otherwise(ratio(2 * F.col("tp"), F.col("n") + F.lit(total_gold))).alias("f1"))


def shapley(values: DataFrame, jurors: int) -> DataFrame:
    """juror, value: the exact Shapley value of each juror."""
    weight = F.array(*[F.lit(1.0 / (jurors * comb(jurors - 1, s))) for s in range(jurors)])
    ids = values.sparkSession.range(jurors).withColumnRenamed("id", "juror")
    bit = F.expr("shiftleft(1L, cast(juror as int))")
    with_ = values.select(F.col("subset").alias("big"), F.col("f1").alias("f_with"))
    out = values.crossJoin(F.broadcast(ids)).where(F.col("subset").bitwiseAND(bit) == 0).withColumn("big", F.col("subset").bitwiseOR(bit)).join(with_, "big")
    return out.groupBy("juror").agg(F.sum(F.element_at(weight, F.bit_count("subset") + 1) * (F.col("f_with") - F.col("f1"))).alias("value"))


def two_way(cells: DataFrame) -> DataFrame:
    """Sums of squares of rows, columns and interaction of a complete table cells(row, col, value)."""
    over = lambda *c: F.avg("value").over(Window.partitionBy(*c))
    m = cells.select("value", over("row").alias("r"), over("col").alias("c"), F.avg("value").over(Window.partitionBy()).alias("m"))
    sq = lambda x: F.sum(x * x)
    return m.agg(sq(F.col("r") - F.col("m")).alias("ss_row"), sq(F.col("c") - F.col("m")).alias("ss_col"), sq(F.col("value") - F.col("r") - F.col("c") + F.col("m")).alias("ss_interaction"), sq(F.col("value") - F.col("m")).alias("ss_total"))
