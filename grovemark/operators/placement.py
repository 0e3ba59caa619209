"""Character ranges of lines and matches, and the line that each match lies in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def line_ranges(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, segment_idx, start, stop (exclusive): the lines of each text, blank ones too. A null text has none."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("segment_idx", "line")).select(key, "segment_idx", F.length("line").alias("n"))
    before = F.sum(F.col("n") + 1).over(Window.partitionBy(key).orderBy("segment_idx").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") - 1
    return lines.select(key, "segment_idx", before.alias("start"), (before + F.col("n")).alias("stop"))


def matches(texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """key, ordinal, start, stop, matched: all non-overlapping matches; a place is the sum of what lies before it."""
    found = texts.select(key, F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("m"), F.split(text, pattern, -1).alias("g"))
    rows = found.select(key, F.posexplode(F.arrays_zip("m", "g")).alias("ordinal", "x")).select(key, "ordinal", F.col("x.m").alias("matched"), F.length("x.g").alias("gap")).where("matched is not null")
    n = F.length("matched")
    end = F.sum(F.col("gap") + n).over(Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(key, "ordinal", (end - n).alias("start"), end.alias("stop"), "matched")


def place(ranges: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """spans with the segment_idx of the range that holds their start, null where none does. Both sides are merged in order
    of position, so a long text costs its length and not the product of ranges and spans."""
    cols = spans.columns
    side = ranges.select(key, F.col("start").alias("__at"), F.struct("segment_idx", F.col("stop").alias("end")).alias("__seg"), F.lit(None).cast(spans.schema).alias("__span"))
    other = spans.select(key, F.col("start").alias("__at"), F.lit(None).cast("struct<segment_idx:int,end:bigint>").alias("__seg"), F.struct(*cols).alias("__span"))
    side = side.withColumn("__seg", F.col("__seg").cast("struct<segment_idx:int,end:bigint>"))
    order = Window.partitionBy(key).orderBy("__at", F.col("__span").isNotNull(), "__seg.segment_idx").rowsBetween(Window.unboundedPreceding, 0)
    met = side.unionByName(other).withColumn("__last", F.last("__seg", ignorenulls=True).over(order)).where("__span is not null")
    return met.select("__span.*", F.when(F.col("__at") < F.col("__last.end"), F.col("__last.segment_idx")).alias("segment_idx"))


def density(placed: DataFrame, key: str) -> DataFrame:
    """key, segment_idx, n: placed spans per line; lines without any have no row."""
    return placed.where("segment_idx is not null").groupBy(key, "segment_idx").agg(F.count(F.lit(1)).alias("n"))
