"""Matching of character spans, and what matched pairs agree on.

Spans are (report, start, end), half-open. gold and predicted rows carry an id that orders equal spans.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemark.operators.quality import ratio


def overlaps(a: str = "g", b: str = "p") -> Column:
    return (F.col(f"{a}_start") < F.col(f"{b}_end")) & (F.col(f"{b}_start") < F.col(f"{a}_end"))


def exact(a: str = "g", b: str = "p") -> Column:
    return (F.col(f"{a}_start") == F.col(f"{b}_start")) & (F.col(f"{a}_end") == F.col(f"{b}_end"))


def jaccard(a: str = "g", b: str = "p") -> Column:
    """Shared characters over the stretch from the first start to the last end; 0 for two empty spans at one place."""
    low, high = F.greatest(f"{a}_start", f"{b}_start"), F.least(f"{a}_end", f"{b}_end")
    return ratio(F.greatest(F.lit(0), high - low), F.greatest(f"{a}_end", f"{b}_end") - F.least(f"{a}_start", f"{b}_start"))


def candidates(gold: DataFrame, predicted: DataFrame, criterion: str = "overlaps") -> DataFrame:
    """report, g_id, p_id, jaccard of all pairs that the criterion admits; a join within reports."""
    side = lambda d, s: d.select("report", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "start", "end")])
    met = side(gold, "g").join(side(predicted, "p"), "report").where(exact() if criterion == "exact" else overlaps())
    return met.select("report", "g_id", "g_start", "g_end", "p_id", "p_start", "p_end", jaccard().alias("jaccard"))


def match(gold: DataFrame, predicted: DataFrame, criterion: str = "overlaps") -> DataFrame:
    """report, g_id, p_id, jaccard: each gold span, in order of place, takes the free predicted span of greatest overlap, of
    equal ones the first. A choice depends on those before it, so a report's two lists of spans meet in one group; pairs are
    looked at one gold span at a time and never listed."""
    kind = gold.schema["report"].dataType.simpleString()

    def greedy(g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        g, p = g.sort_values(["start", "end", "id"]), p.sort_values(["start", "end", "id"])
        start, end, free, keep = p["start"].to_numpy(), p["end"].to_numpy(), np.ones(len(p), bool), []
        for i, a, b in zip(g["id"], g["start"], g["end"], strict=True):
            fits = free & (((start == a) & (end == b)) if criterion == "exact" else ((start < b) & (a < end)))
            at = np.nonzero(fits)[0]
            if len(at):
                union = np.maximum(end[at], b) - np.minimum(start[at], a)
                shared = np.maximum(0, np.minimum(end[at], b) - np.maximum(start[at], a))
                j = np.divide(shared, union, out=np.zeros(len(at)), where=union > 0)
                best = int(j.argmax())
                free[at[best]] = False
                keep.append((i, p["id"].iloc[at[best]], float(j[best])))
        report = g["report"].iloc[0] if len(g) else None
        return pd.DataFrame({"report": pd.Series([report] * len(keep), dtype=object), "g_id": pd.Series([k[0] for k in keep], dtype="int64"), "p_id": pd.Series([k[1] for k in keep], dtype="int64"), "jaccard": pd.Series([k[2] for k in keep], dtype=float)})

    narrow = lambda d: d.select("report", F.col("id").cast("long").alias("id"), "start", "end").groupBy("report")
    return narrow(gold).cogroup(narrow(predicted)).applyInPandas(greedy, f"report {kind}, g_id long, p_id long, jaccard double")


def span_prf(gold: DataFrame, predicted: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 and the mean overlap of the matched pairs."""
    n = matched.agg(F.count(F.lit(1)).alias("tp"), F.coalesce(F.avg("jaccard"), F.lit(0.0)).alias("mean_jaccard"))
    size = lambda d, c: d.agg(F.count(F.lit(1)).alias(c))
    one = n.crossJoin(size(gold, "n_gold")).crossJoin(size(predicted, "n_pred"))
    tp, fp, fn = F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("n_gold") - F.col("tp")
    return one.select("tp", fp.alias("fp"), fn.alias("fn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), "mean_jaccard")


def type_confusion(pairs: DataFrame) -> DataFrame:
    """gold, pred, n: the counts of pairs(gold, pred)."""
    return pairs.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def type_summary(pairs: DataFrame) -> DataFrame:
    """One row: accuracy and the four confusions that change what a record says."""
    g, p = F.col("gold"), F.col("pred")
    finding, disease = (lambda c: c.endswith("_FINDING")), (lambda c: c.startswith("DISEASE_"))
    n = F.count(F.lit(1))
    return pairs.agg(
        n.alias("n"), ratio(F.count_if(g == p), n).alias("accuracy"),
        F.count_if((g == "NEGATED_FINDING") & (p == "RESOLVED_FINDING")).alias("negated_as_resolved"), F.count_if((g == "RESOLVED_FINDING") & (p == "NEGATED_FINDING")).alias("resolved_as_negated"),
        F.count_if(finding(g) & disease(p)).alias("finding_as_disease"), F.count_if(disease(g) & finding(p)).alias("disease_as_finding"),
    )


def polarity(pairs: DataFrame) -> DataFrame:
    """status, n, correct, accuracy of pairs(term_correct, gold, pred) by gold status, over those with the right term."""
    g = pairs.where("term_correct").groupBy(F.col("gold").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("correct"))
    return g.withColumn("accuracy", F.col("correct") / F.col("n"))


def specificity(pairs: DataFrame, closed: DataFrame, depth: DataFrame) -> DataFrame:
    """pairs(gold, pred) with error: the predicted depth less the gold one where one term lies above the other, 0 for equal
    ones, null where they are not on one path. Looked up once per distinct pair."""
    distinct = pairs.select("gold", "pred").distinct()
    up = closed.select(F.col("descendant").alias("x"), F.col("ancestor").alias("y"))
    down = distinct.join(up.withColumnsRenamed({"x": "pred", "y": "gold"}), ["gold", "pred"], "left_semi")
    over = distinct.join(up.withColumnsRenamed({"x": "gold", "y": "pred"}), ["gold", "pred"], "left_semi")
    path = down.unionByName(over).distinct()
    at = lambda c: depth.select(F.col("term").alias(c), F.col("depth").alias(f"d_{c}"))
    signed = path.join(at("gold"), "gold").join(at("pred"), "pred").select("gold", "pred", (F.col("d_pred") - F.col("d_gold")).alias("error"))
    return pairs.join(signed, ["gold", "pred"], "left").withColumn("error", F.when(F.col("gold") == F.col("pred"), 0).otherwise(F.col("error")))


def specificity_summary(signed: DataFrame) -> DataFrame:
    """One row: how many pairs are on one path, exact, over- and under-specific, and the mean error of the last two."""
    x = F.col("error")
    return signed.agg(
        F.count(F.lit(1)).alias("n"), F.count(x).alias("n_on_path"), F.count_if(x.isNull()).alias("n_off_path"), F.count_if(x == 0).alias("n_exact"), F.count_if(x > 0).alias("n_over"),
        F.count_if(x < 0).alias("n_under"), F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)).alias("mean_over"), F.coalesce(F.avg(F.when(x < 0, x)), F.lit(0.0)).alias("mean_under"),
    )


def escalation(escalated: DataFrame, ambiguous: DataFrame, keys: list[str], precision: float = 0.70, recall: float = 0.90) -> DataFrame:
    """One row: what share of the escalated is ambiguous and the reverse, and whether both are above their targets."""
    a, b = escalated.select(*keys).distinct().withColumn("a", F.lit(1)), ambiguous.select(*keys).distinct().withColumn("b", F.lit(1))
    n = a.join(b, keys, "full").agg(F.count("a").alias("n_escalated"), F.count("b").alias("n_ambiguous"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))
    p, r = ratio(F.col("both"), F.col("n_escalated")), ratio(F.col("both"), F.col("n_ambiguous"))
    return n.select("n_escalated", "n_ambiguous", p.alias("precision"), r.alias("recall"), (p > precision).alias("meets_precision"), (r > recall).alias("meets_recall"))


def fabrication(predicted: DataFrame, known: DataFrame) -> DataFrame:
    """One row: predictions, those whose term does not exist, and their share."""
    met = predicted.join(known.select("term").distinct().withColumn("known", F.lit(1)), "term", "left")
    return met.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("n_fabricated")).withColumn("rate", ratio(F.col("n_fabricated"), F.col("n")))
