"""The panel pipeline: segments, jurors that name terms in them, and the terms on which enough jurors agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemark.operators.text import tokens

Juror = Callable[[Column, Column, Column], Column]


def stand_in(segment: Column, surface: Column, juror: Column) -> Column:
    """A fixed rule in place of a model: whether the juror names the surface in the segment."""
    return (F.length(segment) + F.length(surface) + juror) % 3 != 0


def extract(reports: DataFrame, key: str, text: str, surfaces: DataFrame, jurors: int, k: int, names: Juror = stand_in) -> DataFrame:
    """key, terms: for every report the sorted terms that at least k jurors name in some segment; empty where none is. A
    segment's distinct words meet the surfaces(surface, term) by an equi-join before any juror is asked, and votes are
    counted as bits of a mask, so no list of votes is gathered."""
    lines = reports.select(key, F.explode(F.split(text, "\n")).alias("segment"))
    found = lines.select(key, "segment", F.explode(F.array_distinct(tokens(F.col("segment")))).alias("surface")).join(surfaces, "surface")
    votes = [F.max(names(F.col("segment"), F.col("surface"), F.lit(j)).cast("int")) for j in range(jurors)]
    total = votes[0]
    for v in votes[1:]:
        total = total + v
    agreed = found.groupBy(key, "term").agg(total.alias("votes")).where(F.col("votes") >= k)
    sets = agreed.groupBy(key).agg(F.array_sort(F.collect_list("term")).alias("terms"))
    return reports.select(key).distinct().join(sets, key, "left").select(key, F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
