"""Sharding by sampled splitters, in DataFrame operations only.

A row's key is (hash of its text, hash of its id and place): equal texts stand together, in an order that has nothing to do with size.
A size-weighted sample of keys gives quantile boundaries for many more ranges than shards. The exact bytes of each range are
counted; ranges over the bound are subdivided at boundaries from a second, denser sample of their own, inside a group of
equal texts too where one is that large. Runs of neighbouring ranges become shards of nearly equal bytes.

Law: ``bytes``. Slots number the rows of a shard from 0 by key: counts of the ranges before, then the row's number in its
range, so no shard is ever sorted in one task.

Defined cases: a null text has size 1 and crc32 0, as the empty one; rows that repeat, of one id or of none, get slots of
their own and are split over ranges and shards where they fill more than one; an empty table gives an empty result; with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from grovemark.llm.common import stored, table

#: Ranges: at least this many for each shard, more where a range would exceed ROWS_PER_RANGE; at most MAX_RANGES.
RANGES_PER_SHARD, ROWS_PER_RANGE, MAX_RANGES = 32, 200_000, 65_536
#: Sampled keys for each range.
SAMPLES_PER_RANGE = 24
#: A range is overfull from this multiple of the mean on.
OVERFULL = 1.5
LEAST = -(2**63)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The narrow row of each document: doc_id, size, text_crc32, k1 (hash of text), k2 (hash of id and place in the input, so
    that rows with the same id and text have keys of their own and are drawn and parted like any others)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.monotonically_increasing_id()).alias("k2"),
    )


def sampled_splitters(rows: DataFrame, total: int, pieces: int, per_piece: int, salt: str) -> list[tuple[int, int]]:
    """At most pieces - 1 quantile boundaries of rows by size. A row is drawn with a probability in proportion to its
    size, from a hash of its key; the sample has about pieces * per_piece rows whatever the input."""
    each = max(1.0, total / (pieces * per_piece))  # bytes that one drawn row stands for
    draw = (F.xxhash64("k1", "k2", F.lit(salt)).cast("double") / F.lit(2.0**64)) + 0.5
    taken = rows.where(draw < F.col("size") / F.lit(each)).select("k1", "k2", F.greatest(F.col("size").cast("double"), F.lit(each)).alias("w"))
    sample = sorted((r["k1"], r["k2"], r["w"]) for r in taken.collect())
    weight, step, run, out = sum(w for *_, w in sample), 0, 0.0, []
    for k1, k2, w in sample:
        run += w
        if run * pieces >= (step + 1) * weight and step + 1 < pieces:
            out.append((k1, k2))
            step = int(run * pieces / weight)
    return out


def whole_groups(bounds: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Moves boundaries to the start of a group of equal texts; only where several fall into one group (it fills more than
    a range) the inner ones stay."""
    out: list[tuple[int, int]] = []
    for k, (k1, k2) in enumerate(bounds):
        out.append((k1, LEAST) if k == 0 or bounds[k - 1][0] != k1 else (k1, k2))
    return sorted(set(out))


def in_ranges(rows: DataFrame, bounds: Sequence[tuple[int, int]]) -> DataFrame:
    """rows with their range's number. The boundaries (at most MAX_RANGES pairs) are filed by the key's first 12 bits, so
    a row meets only those of its own drawer."""
    bits = 52
    drawers: list[tuple[int, int, list[int], list[int]]] = []
    firsts = [b[0] for b in bounds]
    for d in range(-(1 << (63 - bits)), 1 << (63 - bits)):
        lo = bisect_right(firsts, (d << bits) - 1)
        hi = bisect_right(firsts, ((d + 1) << bits) - 1)
        drawers.append((d, lo, [b[0] for b in bounds[lo:hi]], [b[1] for b in bounds[lo:hi]]))
    kind = T.StructType([T.StructField("drawer", T.LongType()), T.StructField("base", T.IntegerType()), T.StructField("b1", T.ArrayType(T.LongType())), T.StructField("b2", T.ArrayType(T.LongType()))])
    filed = rows.sparkSession.createDataFrame(drawers, kind)
    # 4096 drawers and MAX_RANGES boundaries: a fixed size.
    met = rows.withColumn("drawer", F.shiftright("k1", bits)).join(F.broadcast(filed), "drawer")
    below = F.expr("size(filter(zip_with(b1, b2, (x, y) -> x < k1 or (x = k1 and y <= k2)), z -> z))")
    return met.withColumn("range", F.when(F.size("b1") == 0, F.col("base")).otherwise(F.col("base") + below)).drop("drawer", "base", "b1", "b2")


def plan_ranges(rows: DataFrame, shards: int) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int]]]:
    """Boundaries, and for each range its shard and its first slot."""
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(1, min(MAX_RANGES, max(shards * RANGES_PER_SHARD, -(-n // ROWS_PER_RANGE))))
    bounds = whole_groups(sampled_splitters(rows, total, ranges, SAMPLES_PER_RANGE, "first"))
    counted = lambda b: {r["range"]: (r["n"], r["size"]) for r in in_ranges(rows, b).groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()}
    found, mean = counted(bounds), total / ranges
    over = {k: size for k, (_, size) in found.items() if size > OVERFULL * mean}
    if over:
        numbered = in_ranges(rows, bounds).where(F.col("range").isin(list(over)))
        whole = sum(over.values())
        pieces = max(2, round(2 * whole / mean))
        bounds = sorted(set(bounds) | set(sampled_splitters(numbered, whole, pieces, SAMPLES_PER_RANGE, "second")))
        found = counted(bounds)
    slots, at, before, done = {}, dict.fromkeys(range(shards), 0), 0, 0
    for k in sorted(found):
        count, size = found[k]
        shard = min(shards - 1, int(shards * (before + size / 2) / total)) if total else 0
        slots[k] = (shard, at[shard])
        at[shard] += count
        before, done = before + size, done + count
    return bounds, slots


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: one row per document."""
    rows = stored(keyed(docs, id_col, text_col), "shard")
    bounds, slots = plan_ranges(rows, shards)
    kind = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("first", T.LongType())])
    placed = docs.sparkSession.createDataFrame([(k, s, f) for k, (s, f) in slots.items()], kind)
    row = F.row_number().over(Window.partitionBy("range").orderBy("k1", "k2", "doc_id", "size", "text_crc32"))
    numbered = in_ranges(rows, bounds).withColumn("row", row)
    return numbered.join(F.broadcast(placed), "range").select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("row") - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the documents to path/shard=N/, each range as one file or more; texts move once, to their range's task."""
    rows = stored(keyed(docs, id_col, text_col), "shard")
    bounds, slots = plan_ranges(rows, shards)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64(text).alias("k1"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.monotonically_increasing_id()).alias("k2"))
    kind = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("shard", T.IntegerType())])
    placed = docs.sparkSession.createDataFrame([(k, s) for k, (s, _) in slots.items()], kind)
    out = in_ranges(named, bounds).join(F.broadcast(placed), "range")
    out.repartition("range").sortWithinPartitions("range", "k1", "k2").select("shard", "doc").write.partitionBy("shard").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
