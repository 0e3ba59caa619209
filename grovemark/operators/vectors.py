"""Cosine retrieval of segments(segment, v) against an index context(item, term, v), in bounded blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block on either side: what one task multiplies, and so the bound of its memory.
BLOCK = 2048


def _units(vs: pd.Series) -> np.ndarray:
    """Rows at length 1; a zero vector stays zero."""
    m = np.stack([np.asarray(v, np.float64) for v in vs])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def pooled_max(segments: DataFrame, context: DataFrame, block: int = BLOCK) -> DataFrame:
    """segment, term, sim: the highest cosine of each segment with the vectors of each term, an item never with the segment
    of its own id. Both sides are dealt into blocks and each pair of blocks is one matrix product; the maxima of the blocks
    are then aggregated. Null vectors take no part."""
    segments, context = segments.where("v is not null"), context.where("v is not null")
    n_s, n_c = (max(1, math.ceil(x.count() / block)) for x in (segments, context))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = segments.select("segment", "v", F.pmod(F.xxhash64("segment"), F.lit(n_s)).cast("int").alias("p"), every(n_c).alias("q"))
    b = context.select("item", "term", "v", every(n_s).alias("p"), F.pmod(F.xxhash64("item"), F.lit(n_c)).cast("int").alias("q"))
    kind = {f.name: f.dataType.simpleString() for f in [*segments.schema, *context.schema]}

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"segment": left["segment"][:0], "term": right["term"][:0], "sim": np.zeros(0)})
        right = right.sort_values("term", kind="stable")
        terms, starts = np.unique(right["term"].to_numpy(), return_index=True)
        ids, items, m = left["segment"].to_numpy(), right["item"].to_numpy(), _units(right["v"])
        out = []
        for lo in range(0, len(left), 256):
            sims = _units(left["v"].iloc[lo : lo + 256]) @ m.T
            sims[ids[lo : lo + 256, None] == items[None, :]] = -np.inf
            out.append(np.maximum.reduceat(sims, starts, axis=1))
        best = np.concatenate(out)
        i, j = np.nonzero(best > -np.inf)
        return pd.DataFrame({"segment": ids[i], "term": terms[j], "sim": best[i, j]})

    found = a.groupBy("p", "q").cogroup(b.groupBy("p", "q")).applyInPandas(meet, f"segment {kind['segment']}, term {kind['term']}, sim double")
    return found.groupBy("segment", "term").agg(F.max("sim").alias("sim"))


def best(sims: DataFrame, by: str, other: str, k: int, latest: bool = False) -> DataFrame:
    """The k rows of highest sim for each value of by, with their rank; ties (at nine digits) to the smaller value of other,
    or to the larger one."""
    tie = F.desc(other) if latest else F.asc(other)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("sim", 9)), tie))
    return sims.withColumn("rank", rank).where(F.col("rank") <= k)


def union_over(sims: DataFrame, members: DataFrame) -> DataFrame:
    """segment, query, sim: the highest sim over a query's members(query, term); a query without known members is absent."""
    return sims.join(members, "term").groupBy("segment", "query").agg(F.max("sim").alias("sim"))


def centroids(context: DataFrame) -> DataFrame:
    """term, v: the mean of each term's vectors, one aggregation by dimension."""
    cells = context.where("v is not null").select("term", F.posexplode("v").alias("i", "x")).groupBy("term", "i").agg(F.avg("x").alias("x"))
    row = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return cells.groupBy("term").agg(row.alias("v"))
