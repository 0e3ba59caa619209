"""SimHash near-duplicate groups over a Gray-order hierarchical index.

Fingerprint: over a text's word shingles (A-Z lower-cased, repeats included) a bit is 1 if set in more than half of the
shingles' XXH64 hashes. Two fingerprints link at ``radius`` or fewer differing bits; groups are the connected components.

Search: the distinct fingerprints are dealt into cells so that any two that link share one: of radius + 1 blocks of bits at
least one agrees. A block value with more than HOT fingerprints is dealt again by blocks of its other bits; three such
rounds leave cells of at most a few thousand even where all 2^64 fingerprints exist, so the search is exact without a cap.
Cells are gathered to groups of about GROUP rows. In each group the fingerprints are sorted by Gray rank; runs of eight
become nodes that hold the bits all their members share (a mask and a pattern), up to the root. A query descends with
the differences counted so far and drops a whole node once they exceed the radius. A group emits, for each fingerprint that
has links, one edge to the least of its component there: never all pairs.

The edges of all groups are joined to components by alternating large-star and small-star rounds of joins.

Defined cases: a null or blank text has fingerprint zero, which links like any other; fewer words than a shingle form one
shingle; repeated rows and texts share a fingerprint; a null id is never a component's least id unless all are null; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovemark.llm.common import drop_rows, dropped, small_batches, stored, table, with_groups

SEED, WIDTH, RADIUS = 42, 3, 2
#: Fingerprints of one block value that are searched together; rows of a group of cells; members of an index node.
HOT, GROUP, FAN = 1024, 1024, 8
#: Rows of one fingerprint that a task may take in a join.
HOT_ROWS = 100_000
ALL = (1 << 64) - 1


def fingerprint(text: str, width: int = WIDTH, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one text."""
    from xxhash import xxh64_intdigest as digest

    # On bytes, lower() changes A-Z only and split() cuts at the six ASCII blanks only.
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = [digest(b" ".join(words), seed)]
    else:
        line, at = b" ".join(words), 0
        starts, ends = [], []
        for w in words:
            starts.append(at)
            at += len(w)
            ends.append(at)
            at += 1
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=False)]
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):
        part = np.array(hashes[lo : lo + 65536], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.nonzero(2 * ones > len(hashes))[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, code (the fingerprint as a signed long), t (a hash of the text)."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("bigint")
    def code(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(np.array([fingerprint(t or "", width) for t in s], np.uint64).view(np.int64))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), code(text).alias("code"), F.xxhash64(text).alias("t"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    out = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class GrayIndex:
    """Distinct codes in Gray order under nodes of shared bits."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        levels = [(self.codes, np.full(len(codes), ALL, np.uint64))]
        while len(levels[-1][0]) > 1:
            pattern, mask = levels[-1]
            first = np.arange(0, len(pattern), FAN)
            apart = np.bitwise_or.reduceat(pattern ^ np.repeat(pattern[first], FAN)[: len(pattern)], first)
            shared = np.bitwise_and.reduceat(mask, first) & ~apart
            levels.append((pattern[first] & shared, shared))
        # Bits that a node adds to those its parent has counted.
        self.levels = []
        for k, (pattern, mask) in enumerate(levels):
            above = levels[k + 1][1][np.arange(len(pattern)) // FAN] if k + 1 < len(levels) else np.zeros(len(pattern), np.uint64)
            self.levels.append((pattern, mask & ~above))

    def pairs(self, radius: int, queries: slice) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) of all members before the query, in index order, within the radius."""
        q = np.arange(len(self.codes), dtype=np.int64)[queries]
        node, seen = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        span = FAN ** (len(self.levels) - 1)
        for k in range(len(self.levels) - 1, -1, -1):
            pattern, own = self.levels[k]
            seen = seen + np.bitwise_count((self.codes[q] ^ pattern[node]) & own[node])
            live = (seen <= radius) & (node * span < q)
            q, node, seen = q[live], node[live], seen[live]
            if k:
                q, seen = np.repeat(q, FAN), np.repeat(seen, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                inside = node < len(self.levels[k - 1][0])
                q, node, seen, span = q[inside], node[inside], seen[inside], span // FAN
        return q, node


def roots(codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes in index order and for each the place of its component's root."""
    index = GrayIndex(codes)
    n = len(index.codes)
    label = np.arange(n)
    for lo in range(0, n, 512):
        a, b = index.pairs(radius, slice(lo, lo + 512))
        while len(a):
            x, y = label[a], label[b]
            if not (differ := x != y).any():
                break
            a, b = a[differ], b[differ]
            x, y = x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not (label == (up := label[label])).all():
                label = up
    return index.codes, label


def parts_of(mask: int, parts: int) -> list[int]:
    """Splits the bits that a mask leaves free into blocks."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(codes: DataFrame, radius: int, hot: int = HOT, rounds: int = 3) -> DataFrame:
    """code, mask, value: rows of cells with at least two codes; any two codes that link share a cell."""
    spark, blocks = codes.sparkSession, radius + 1
    masks, out, rest = [0], None, codes.select("code", F.lit(0).cast("long").alias("mask"))
    for k in range(rounds + 1):
        step = [(signed(m), [signed(m | p) for p in parts_of(m, blocks)]) for m in masks]
        # blocks ** k masks: a fixed table.
        finer = F.broadcast(spark.createDataFrame(step, T.StructType([T.StructField("mask", T.LongType()), T.StructField("finer", T.ArrayType(T.LongType()))])))
        if k == 0:
            dealt = rest.select("code", F.explode(F.array(*map(F.lit, step[0][1]))).alias("mask"))
        else:
            dealt = rest.join(finer, "mask").select("code", F.explode("finer").alias("mask"))
        dealt = dealt.withColumn("value", F.col("code").bitwiseAND(F.col("mask")))
        dealt = stored(dealt, "cells")
        counts = dealt.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        met = stored(dealt.join(counts, ["mask", "value"]), "cells")
        last = k == rounds
        small = met if last else met.where(F.col("n") <= hot)
        out = small if out is None else out.unionByName(small)
        if last or met.where(F.col("n") > hot).isEmpty():
            break
        rest = met.where(F.col("n") > hot).select("code", "mask")
        masks = [m | p for m in masks for p in parts_of(m, blocks)]
    return out.select("code", "mask", "value")


def links(codes: DataFrame, radius: int = RADIUS, hot: int = HOT, group: int = GROUP) -> DataFrame:
    """a, b: edges that connect exactly the codes that a chain of links connects."""
    dealt = cells(codes, radius, hot)
    groups = max(1, dealt.count() // group)
    numbered = dealt.select("code", F.pmod(F.xxhash64("mask", "value"), F.lit(groups)).alias("g"))

    def search(part: pd.DataFrame) -> pd.DataFrame:
        found, label = roots(np.unique(part["code"].to_numpy(np.int64)).view(np.uint64), radius)
        on = label != np.arange(len(label))
        return pd.DataFrame({"a": found[on].view(np.int64), "b": found[label[on]].view(np.int64)})

    return numbered.groupBy("g").applyInPandas(search, "a long, b long")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root: the least node of each node's component. Alternates large-star and small-star until nothing changes."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most):
        sides = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        then = stored(small, "edges")
        was, mark = mark, tuple(then.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        dropped(now.sparkSession, now)
        now = then
        if mark == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"the components have not settled after {most} rounds")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS, max_ids: int = 1_000_000) -> DataFrame:
    """doc_id, code, t, component_id, first (of the component by id, then t): one row per document."""
    rows = stored(fingerprints(docs, id_col, text_col, width), "codes")
    me = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    distinct = stored(rows.groupBy("code").agg(F.min(me).alias("least"), F.count(F.lit(1)).alias("rows")), "codes")
    joined = components(links(distinct.select("code"), radius))
    placed = distinct.join(joined, F.col("code") == F.col("node"), "left").select("code", "least", "rows", F.coalesce("root", "code").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("least"))
    of_code = placed.drop("least").join(least, "root").select("code", "least", "rows")
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("t") == F.col("least.t"))
    return with_groups(rows, of_code, "code", "rows", max_ids, HOT_ROWS).select("doc_id", "code", "t", F.col("least.doc_id").alias("component_id"), first.alias("first"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS, max_ids: int = 1_000_000) -> DataFrame:
    """One document of each group, that with the least id, with all its columns; of rows that repeat with the same id and
    text one."""
    rows = near_groups(docs, id_col, text_col, width, radius, max_ids).groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n"), F.max("first").alias("tied"))
    goes = rows.where("not tied or n > 1").select(F.col("doc_id").alias("id"), F.col("t").alias("key"), "tied")
    return drop_rows(docs, goes, id_col, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), max_ids)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
