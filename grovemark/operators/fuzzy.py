"""Fuzzy linking: trigrams find candidates, opposites are refused, and an edit ratio decides."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from grovemark.operators.text import surface_key

# Word parts that turn a meaning round.
OPPOSITES = (
    ("macro", "micro"), ("hyper", "hypo"), ("increas", "decreas"), ("elevat", "reduc"), ("poly", "oligo"), ("brady", "tachy"),
    ("hyperplas", "hypoplas"), ("over", "under"), ("high", "low"), ("large", "small"), ("long", "short"), ("abov", "below"),
)


def opposed(a: Column, b: Column) -> Column:
    """One text holds only the first part of a pair and the other only the second."""
    only = lambda c, x, y: c.contains(x) & ~c.contains(y)
    out = F.lit(False)
    for x, y in OPPOSITES:
        out |= (only(a, x, y) & only(b, y, x)) | (only(a, y, x) & only(b, x, y))
    return out


def trigrams(c: Column) -> Column:
    """The distinct runs of three characters of a key without its blanks; a shorter key is its own run."""
    packed = F.replace(c, F.lit(" "))
    runs = F.transform(F.sequence(F.lit(1), F.length(packed) - 2), lambda i: F.substring(packed, i, F.lit(3)))
    return F.when(F.length(packed) < 3, F.array(packed)).otherwise(F.array_distinct(runs))


@F.pandas_udf(T.DoubleType())
def edit_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over both lengths."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def fuzzy(mentions: DataFrame, surfaces: DataFrame, threshold: float = 0.82, limit: int = 20) -> DataFrame:
    """id, term, score of the terms whose surface reaches the ratio, the limit best per mention, ties to the smaller term.
    Distinct keys are compared once; a pair whose lengths alone forbid the ratio is never compared."""
    asked = mentions.select("mention", surface_key(F.col("mention")).alias("a")).distinct()
    held = surfaces.select("term", surface_key(F.col("surface")).alias("b")).distinct()
    runs = lambda df, c: df.select(c).distinct().select(c, F.explode(trigrams(F.col(c))).alias("g"))
    la, lb = F.length("a"), F.length("b")
    pairs = runs(asked, "a").join(runs(held, "b"), "g").where(2 * F.least(la, lb) >= threshold * (la + lb)).select("a", "b").distinct()
    near = pairs.where(~opposed(F.col("a"), F.col("b"))).withColumn("score", edit_ratio("a", "b")).where(F.col("score") >= threshold)
    scored = asked.join(near, "a").join(held, "b").groupBy("mention", "term").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("score"), "term"))
    return mentions.join(scored.withColumn("rank", rank).where(F.col("rank") <= limit), "mention").select("id", "term", "score")
