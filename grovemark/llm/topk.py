"""Exact top-k inner products by a vector-approximation file.

Vectors are integers: floor(64 * x) of each component. The file holds one byte a component, the number of the cell that it
lies in; the cells' edges are quantiles of the components of a sample of SAMPLE to 2 * SAMPLE
rows (any edges give right results; those at the ends are of all rows). Queries are sent to the tasks in portions, one scan of the bytes
each. From the bytes alone a task bounds every candidate's score from above, and the scores of the best k by that bound from
below; what can't reach the k-th of these lower bounds is left out, in the task and then over all tasks. Exact vectors are
then read of the survivors only, in the order of the upper bound: a first stretch, which fixes a k-th exact score, and then
those whose bound still reaches it, after which the k-th is certain. Ties go to the smaller id at every step.

Of equal vectors only the k + 1 rows with the smallest ids can be in a result, so one very common vector costs no more.

Defined cases: vectors that are null or hold a null or non-finite component take no part; only vectors of the query's
length are candidates; rows that share the query's id are the query's own; of repeated query ids the least vector asks;
repeated candidates are ranked each; with fewer than k candidates all are returned; an empty table gives an empty result; a
null id takes no part. An integer or a score beyond 64 bits, which the result can't hold, is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovemark.llm.common import stored, table

K, SCALE = 20, 64
#: Candidates of a block, queries of a block, queries of a portion and their bytes, cells at most.
BLOCK, QUERIES, PORTION, PORTION_BYTES, CELLS = 4096, 256, 32_768, 1 << 25, 256
#: Rows of the sample, at most about twice as many: for the edges and the first scan, which has SAMPLE_TASKS tasks.
SAMPLE, SAMPLE_TASKS = 16_384, 8
PAIRS = "query_id long, row long, vec_id long, upper double, lower double"
SCORES = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: the integer vectors of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    whole = F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.coalesce(whole, F.lit(False)) & F.col("vec_id").isNotNull())
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * SCALE).cast("long")).alias("v"))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(vectors), width)


def cell_edges(vectors: DataFrame, keep: int, cells: int = CELLS) -> np.ndarray:
    """At most cells + 1 ascending integers; cell c holds those from edge c up to but without edge c + 1. The first and last
    are of all vectors(row, vec_id, v); those between are quantiles of the components of one row in keep, and any would do."""
    ends = vectors.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if ends[0] is None:
        return np.array([0, 1], np.int64)
    points = [k / cells for k in range(1, cells)]
    few = vectors.where(F.pmod(F.xxhash64("row"), F.lit(keep)) == 0).select(F.explode("v").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    seen = few.agg(F.percentile("x", F.array(*map(F.lit, points)), F.col("n"))).first()[0] or []
    inner = [x for x in sorted({int(x) for x in seen}) if ends[0] < x <= ends[1]]
    return np.array([ends[0], *inner, min(ends[1] + 1, 2**63 - 1)], np.int64)


def approximation_file(vectors: DataFrame, edges: np.ndarray) -> DataFrame:
    """row, vec_id, cells (a byte a component) of vectors(row, vec_id, v), stored."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2)
            codes = np.searchsorted(edges[1:-1], v.flatten().to_numpy(zero_copy_only=False), "right").astype(np.uint8)
            cuts = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy())]).astype(np.int32)
            cells = pa.BinaryArray.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(cuts), pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cells], names=["row", "vec_id", "cells"])

    return stored(vectors.select("row", "vec_id", "v").mapInArrow(coded, "row long, vec_id long, cells binary"), "cells")


class Bounds:
    """Of the queries of one length: their candidates so far, by bounds from cells."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, edges: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        most = float((np.abs(vectors.astype(np.float64)).sum(axis=1) * max(abs(float(edges[0])), abs(float(edges[-1])))).max(initial=0))
        # Sums of integers are exact below 2^24 in single and 2^53 in double precision; beyond that a margin covers rounding.
        kind = np.float32 if most < 2**24 else np.float64
        self.margin = 0.0 if most < 2**53 else most * (vectors.shape[1] + 4) * 2.0**-50
        self.low, self.high = edges[:-1].astype(kind), (edges[1:] - 1).astype(kind)
        self.above, self.below = np.maximum(vectors, 0).astype(kind), np.minimum(vectors, 0).astype(kind)
        # The k best lower bounds of each query: the bound, id and row.
        self.best = [np.full((len(ids), k), -np.inf), np.full((len(ids), k), 2**63 - 1), np.full((len(ids), k), 2**63 - 1)]
        self.found: list[tuple[np.ndarray, ...]] = []
        self.floor = [np.full((len(ids), 1), -np.inf), np.full((len(ids), 1), 2**63 - 1), np.full((len(ids), 1), 2**63 - 1)]

    def start_from(self, known: dict[str, np.ndarray]) -> None:
        """The k-th of some candidates' lower bounds, by query_id: what can't reach it need not be looked at."""
        at = {int(q): j for j, q in enumerate(known["query_id"])}
        for i, q in enumerate(self.ids):
            if (j := at.get(int(q))) is not None:
                for own, c in zip(self.floor, ("least", "i", "r"), strict=True):
                    own[i] = known[c][j]

    def limit(self) -> list[np.ndarray]:
        """Of each query the better of the two k-th places: its own and the one it started from."""
        own = [b[:, -1:] for b in self.best]
        lower = (self.floor[0] > own[0]) | ((self.floor[0] == own[0]) & ((self.floor[1] < own[1]) | ((self.floor[1] == own[1]) & (self.floor[2] < own[2]))))
        return [np.where(lower, f, o) for f, o in zip(self.floor, own, strict=True)]

    def take(self, rows: np.ndarray, who: np.ndarray, cells: np.ndarray) -> None:
        low, high = self.low[cells], self.high[cells]
        for lo in range(0, len(self.ids), QUERIES):
            at = slice(lo, lo + QUERIES)
            up = (self.above[at] @ high.T + self.below[at] @ low.T).astype(np.float64) + self.margin
            up[self.ids[at][:, None] == who[None, :]] = -np.inf
            # The order among equals matters: a stable one by id, since candidates come sorted by it.
            head = np.argsort(-up, axis=1, kind="stable")[:, : self.k] if up.shape[1] <= 4 * self.k else self.heads(up)
            down = np.einsum("qd,qcd->qc", self.above[at], low[head]) + np.einsum("qd,qcd->qc", self.below[at], high[head])
            down = np.where(np.take_along_axis(up, head, axis=1) > -np.inf, down - self.margin, -np.inf)
            self.merge(at, down, who[head], rows[head])
            q, c = np.nonzero(self.open(up, who[None, :], rows[None, :], [b[at] for b in self.limit()]) & (up > -np.inf))
            self.found.append((q + lo, rows[c], who[c], up[q, c]))
        if sum(len(f[0]) for f in self.found) > 4 * self.k * len(self.ids):
            self.prune()

    def heads(self, up: np.ndarray) -> np.ndarray:
        """The k greatest of each row, of equal ones those that come first."""
        kth = -np.partition(-up, self.k - 1, axis=1)[:, self.k - 1 : self.k]
        rank = np.cumsum(up == kth, axis=1)
        room = self.k - (up > kth).sum(axis=1, keepdims=True)
        return np.nonzero((up > kth) | ((up == kth) & (rank <= room)))[1].reshape(len(up), self.k)

    def merge(self, at: slice, down: np.ndarray, who: np.ndarray, rows: np.ndarray) -> None:
        both = [np.concatenate([b[at], x], axis=1) for b, x in zip(self.best, (down, who, rows), strict=True)]
        order = np.lexsort((both[2], both[1], -both[0]), axis=1)[:, : self.k]
        for b, x in zip(self.best, both, strict=True):
            b[at] = np.take_along_axis(x, order, axis=1)

    @staticmethod
    def open(up: np.ndarray, who: np.ndarray, rows: np.ndarray, kth: list[np.ndarray]) -> np.ndarray:
        """Whether the bound, with its id and row as a tie's order, still reaches the k-th."""
        return (up > kth[0]) | ((up == kth[0]) & ((who < kth[1]) | ((who == kth[1]) & (rows <= kth[2]))))

    def prune(self) -> None:
        q, rows, who, up = (np.concatenate(x) for x in zip(*self.found, strict=True))
        on = self.open(up, who, rows, [b[q, 0] for b in self.limit()])
        self.found = [(q[on], rows[on], who[on], up[on])]

    def pairs(self) -> pa.RecordBatch:
        if not self.found:
            self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.prune()
        q, rows, who, up = self.found[0]
        # The lower bounds travel as rows of their own, but for those that are surely not among the k best.
        n = (self.best[0] > -np.inf) & self.open(*[self.best[j] for j in (0, 1, 2)], self.limit())
        ids = np.concatenate([self.ids[q], np.repeat(self.ids, n.sum(axis=1))])
        none = np.zeros(len(q), bool)
        lower = pa.array(np.concatenate([np.zeros(len(q)), self.best[0][n]]), mask=np.concatenate([~none, np.zeros(n.sum(), bool)]))
        upper = pa.array(np.concatenate([up, np.zeros(n.sum())]), mask=np.concatenate([none, np.ones(n.sum(), bool)]))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([rows, self.best[2][n]])), pa.array(np.concatenate([who, self.best[1][n]])), upper, lower], names=["query_id", "row", "vec_id", "upper", "lower"])


def exact_score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of b with a, as 64-bit integers."""
    if np.abs(a.astype(np.float64)).sum() * np.abs(b.astype(np.float64)).max(initial=0) < 2**62:
        return b @ a
    out = [sum(int(x) * int(y) for x, y in zip(row, a, strict=True)) for row in b]
    if any(not -(2**63) <= s < 2**63 for s in out):
        raise OverflowError("a score has more than 64 bits")
    return np.array(out, np.int64)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, portion: int = PORTION, read: list[int] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs: vec_id and v as from integers(). read, if given, is told how many
    exact vectors were read for each portion of queries."""
    spark = candidates.sparkSession
    # Equal vectors: at most k + 1 rows each; the limit applies before the shuffle, so a hot vector is cut where it is read.
    place = F.row_number().over(Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id"))
    rare = candidates.withColumn("__place", place).where(F.col("__place") <= k + 1).drop("__place")
    exact = stored(rare.withColumn("row", F.monotonically_increasing_id()), "vectors")
    keep = max(1, exact.count() // SAMPLE)
    edges = cell_edges(exact, keep)
    file = approximation_file(exact, edges)
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    width, n = asked.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    portions = max(1, -(-n // max(1, min(portion, PORTION_BYTES // (8 * max(1, width or 0))))))
    asked = stored(asked.withColumn("p", F.pmod(F.xxhash64("vec_id"), F.lit(portions))), "queries")
    out = None
    for p in range(portions):
        part = portion_scores(spark, asked.where(F.col("p") == p).select("vec_id", "v"), exact, file, edges, k, keep, read)
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def portion_scores(spark: SparkSession, asked: DataFrame, exact: DataFrame, file: DataFrame, edges: np.ndarray, k: int, keep: int, read: list[int] | None) -> DataFrame:
    """Exact scores of all that may be among the k best of the queries of one portion (bounded rows and bytes)."""
    got = asked.toArrow().combine_chunks()
    ids, vectors = got.column("vec_id").to_numpy(), got.column("v").combine_chunks()
    lengths = vectors.value_lengths().to_numpy() if len(vectors) else np.zeros(0, np.int64)
    by_length = {int(n): (ids[lengths == n], matrix(vectors.filter(pa.array(lengths == n)), int(n))) for n in np.unique(lengths)}
    sent = spark.sparkContext.broadcast(by_length)

    def bounded(batches: Iterator[pa.RecordBatch], known=None) -> Iterator[pa.RecordBatch]:
        bounds = {n: Bounds(i, v, edges, k) for n, (i, v) in sent.value.items()}
        if known is not None:
            for x in bounds.values():
                x.start_from(known.value)
        for b in batches:
            rows, who, cells = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            sizes = np.diff(np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1])
            for n in np.unique(sizes):
                if int(n) in bounds:
                    at = np.nonzero(sizes == n)[0]
                    at = at[np.lexsort((rows[at], who[at]))]
                    for lo in range(0, len(at), BLOCK):
                        some = at[lo : lo + BLOCK]
                        codes = np.frombuffer(b"".join(cells.take(pa.array(some)).to_pylist()), np.uint8).reshape(len(some), int(n))
                        bounds[int(n)].take(rows[some], who[some], codes)
        for x in bounds.values():
            yield x.pairs()

    def kth_lower(pairs: DataFrame) -> DataFrame:
        """One row per query of the portion: its k-th best lower bound, with id and row."""
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("lower").desc(), "vec_id", "row"))
        kth = pairs.where("lower is not null").withColumn("n", place).where(F.col("n") == k)
        return kth.select("query_id", F.col("lower").alias("least"), F.col("vec_id").alias("i"), F.col("row").alias("r"))

    # A first scan of a sample of bounded size: its k-th bounds let all tasks leave out most candidates from the start.
    few = file.where(F.pmod(F.xxhash64("row"), F.lit(keep)) == 0).repartition(SAMPLE_TASKS)
    start = kth_lower(few.mapInArrow(bounded, PAIRS)).toArrow()
    known = spark.sparkContext.broadcast({c: start.column(c).to_numpy() for c in start.column_names})
    pairs = stored(file.mapInArrow(lambda batches: bounded(batches, known), PAIRS), "bounds")
    kth = F.broadcast(kth_lower(pairs))
    reaches = F.expr("least is null or upper > least or (upper = least and (vec_id < i or (vec_id = i and row <= r)))")
    alive = pairs.where("upper is not null").join(kth, "query_id", "left").where(reaches).select("query_id", "row", "vec_id", "upper")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("upper").desc(), "vec_id", "row"))
    alive = stored(alive.withColumn("place", place), "alive")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {n: {int(x): j for j, x in enumerate(i)} for n, (i, _) in sent.value.items()}
        for b in batches:
            q, who, score = [], [], []
            for vec, v, asks in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.int64)
                mine = sent.value[len(x)][1][[at[len(x)][a] for a in asks]]
                q += asks
                who += [vec] * len(asks)
                score.append(exact_score(x, mine))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(who, pa.int64()), pa.array(np.concatenate(score) if score else [], pa.int64())], names=["query_id", "vec_id", "score"])

    def looked_up(which: DataFrame, tag: str) -> DataFrame:
        # Each exact vector is fetched once, with the (at most a portion of) queries that read it; row is unique.
        readers = stored(which.groupBy("row").agg(F.collect_list("query_id").alias("asks")), tag)
        if read is not None:
            read.append(readers.count())
        return stored(exact.join(readers, "row").select("vec_id", "v", "asks").mapInArrow(scored, SCORES), tag)

    stretch = 2 * k
    first = looked_up(alive.where(F.col("place") <= stretch), "read-first")
    rest = alive.where(F.col("place") > stretch)
    if rest.isEmpty():
        return first
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    sure = F.broadcast(first.withColumn("n", place).where(F.col("n") == k).select("query_id", "score", F.col("vec_id").alias("i")))
    rest = rest.join(sure, "query_id", "left").where(F.expr("score is null or upper > score or (upper = score and vec_id <= i)"))
    return first.unionByName(looked_up(rest.select("query_id", "row"), "read-on"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integers(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), K)


def oracle() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
