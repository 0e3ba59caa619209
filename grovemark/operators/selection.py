"""Choosing how a panel votes: rule, unit and votes needed, by inner folds, and which jurors to keep.

scores(rule, unit, subset, k, fold, tp, fp, fn): counts of every configuration on every inner fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemark.operators import votes
from grovemark.operators.quality import ratio


def fold_counts(detections: DataFrame, gold: DataFrame, folds: DataFrame, units: Sequence[str], jurors: int) -> DataFrame:
    """unit, subset, k, fold, tp, fp, fn for every set of jurors (a bit each) and every number of votes up to its size.

    A term's votes in a unit are a mask; per report and term the few distinct masks of its units are kept, so that every set
    of jurors is counted from one table."""
    if jurors > 10:
        raise ValueError("every set of jurors is tried; that is for ten at most")
    y = gold.select("report", "term").distinct().withColumn("y", F.lit(1))
    subsets = F.broadcast(detections.sparkSession.range(1, 1 << jurors).select(F.col("id").alias("subset")))
    size = folds.join(y, "report").groupBy("fold").agg(F.count(F.lit(1)).alias("n_gold"))
    out = None
    for unit in units:
        packed = votes.packed(detections, unit)
        masks = packed.groupBy("report", "unit", "term").agg(F.bit_or(F.expr("shiftleft(1L, cast(juror as int))")).alias("mask"))
        held = masks.select("report", "term", "mask").distinct().join(y, ["report", "term"], "left").join(folds.select("report", "fold"), "report")
        # What matters of a pair is its set of masks, its fold and whether it is gold: few kinds, counted once.
        kinds = held.groupBy("report", "term", "fold", "y").agg(F.array_sort(F.collect_set("mask")).alias("masks")).groupBy("masks", "fold", "y").agg(F.count(F.lit(1)).alias("n"))
        top = F.array_max(F.transform("masks", lambda m: F.bit_count(m.bitwiseAND(F.col("subset")))))
        met = kinds.crossJoin(subsets).withColumn("top", top).where("top > 0").withColumn("k", F.explode(F.sequence(F.lit(1), "top")))
        per = met.groupBy("subset", "k", "fold").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("y").isNull(), F.col("n")).otherwise(0)).alias("fp"))
        grid = subsets.withColumn("k", F.explode(F.sequence(F.lit(1), F.bit_count("subset")))).crossJoin(F.broadcast(size))
        full = grid.join(per, ["subset", "k", "fold"], "left").na.fill(0, ["tp", "fp"])
        part = full.select(F.lit(unit).alias("unit"), "subset", "k", "fold", "tp", "fp", (F.col("n_gold") - F.col("tp")).alias("fn"))
        out = part if out is None else out.unionByName(part)
    return out


def means(counts: DataFrame, *by: str) -> DataFrame:
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counts.groupBy(*by).agg(F.avg(f1).alias("inner_f1"))


def select_config(counts: DataFrame, units: Sequence[str]) -> DataFrame:
    """subset, unit, k, inner_f1: each set of jurors' best configuration; ties to the earlier unit, then fewer votes."""
    m = means(counts, "subset", "unit", "k")
    place = F.array_position(F.array(*map(F.lit, units)), F.col("unit"))
    best = m.groupBy("subset").agg(F.min(F.struct((-F.round("inner_f1", 12)).alias("o"), place.alias("p"), "k", "unit", "inner_f1")).alias("x"))
    return best.select("subset", "x.unit", "x.k", "x.inner_f1")


def backward_elimination(best: DataFrame, jurors: int, epsilon: float) -> tuple[DataFrame, DataFrame]:
    """The path of juries, each the last one without the juror whose loss hurts least (of equal ones the first), and the
    smallest jury on it within epsilon of the best. best has one row per set of jurors: 2^jurors at most."""
    score = {r["subset"]: r for r in best.collect()}
    now, path = (1 << jurors) - 1, []
    while now:
        path.append(now)
        smaller = [now & ~(1 << j) for j in range(jurors) if now >> j & 1 and now & ~(1 << j)]
        if not smaller:
            break
        now = max(smaller, key=lambda s: (round(score[s]["inner_f1"], 12), -(now ^ s)))
    spark = best.sparkSession
    steps = spark.createDataFrame([(i, s) for i, s in enumerate(path)], "step int, subset long").join(F.broadcast(best), "subset")
    least = max(score[s]["inner_f1"] for s in path) - epsilon
    chosen = min((s for s in path if score[s]["inner_f1"] >= least), key=lambda s: s.bit_count())
    return steps, steps.where(F.col("subset") == chosen)


def choose_pair(scores: DataFrame, order: Sequence[str]) -> DataFrame:
    """fold, pair, score: the best pair of each fold; ties to the one that order lists first."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("pair"))
    best = scores.groupBy("fold").agg(F.min(F.struct((-F.round("score", 12)).alias("o"), place.alias("p"), "pair", "score")).alias("x"))
    return best.select("fold", "x.pair", "x.score")


def pair_frequency(choices: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, value, share of choices."""
    long = choices.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("x.field", "x.value")
    n = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return n.join(n.groupBy("field").agg(F.sum("n").alias("t")), "field").select("field", "value", (F.col("n") / F.col("t")).alias("share"))


def modal(choices: DataFrame, field: str) -> DataFrame:
    """The most common value, n; of equal ones the one that the earliest fold chose."""
    n = choices.groupBy(field).agg(F.count(F.lit(1)).alias("n"), F.min("fold").alias("first"))
    return n.agg(F.min(F.struct((-F.col("n")).alias("m"), "first", field, "n")).alias("x")).select(f"x.{field}", "x.n")


def rank_prompts(rows: DataFrame, baseline: str, margin: float, n: int) -> DataFrame:
    """place, prompt, f1, promoted of rows(prompt, f1): the best score of each prompt, in order; the first n are promoted if
    they beat the baseline by the margin; without the baseline none is."""
    from pyspark.sql.window import Window

    best = rows.groupBy("prompt").agg(F.max("f1").alias("f1"))
    base = best.where(F.col("prompt") == baseline).agg(F.max("f1").alias("base"))
    # One row a prompt.
    placed = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("f1", 12)), "prompt"))).crossJoin(F.broadcast(base))
    ok = (F.col("place") <= n) & (F.col("prompt") != baseline) & (F.col("f1") - F.col("base") >= margin)
    return placed.select("place", "prompt", "f1", F.coalesce(ok, F.lit(False)).alias("promoted"))


def missed_votes(detections: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """report, term, votes, fate of every gold pair: accepted, outvoted (some jurors named it) or unnamed; and whose names."""
    v = detections.groupBy("report", "term").agg(F.count_distinct("juror").alias("votes"), F.bit_or(F.expr("shiftleft(1L, cast(juror as int))")).alias("mask"))
    met = gold.select("report", "term").distinct().join(v, ["report", "term"], "left").na.fill(0, ["votes", "mask"])
    return met.withColumn("fate", F.when(F.col("votes") >= k, "accepted").when(F.col("votes") > 0, "outvoted").otherwise("unnamed"))


def blame(fates: DataFrame, jurors: int) -> DataFrame:
    """juror, found_but_outvoted: gold that a juror named and the panel lost."""
    ids = F.array(*[F.lit(j) for j in range(jurors)])
    lost = fates.where("fate = 'outvoted'").select(F.explode(F.filter(ids, lambda j: F.getbit("mask", j) == 1)).alias("juror"))
    return lost.groupBy("juror").agg(F.count(F.lit(1)).alias("found_but_outvoted"))
