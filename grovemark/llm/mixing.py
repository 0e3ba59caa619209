"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Targets: the sources in code-point order (null last) weigh 1, 2, 3 and so on, repeating, and share all words. No target
exceeds ``cap`` times its source's size; what is cut off goes to the others by weight until none is above. In order of
cap by weight the cut sources are a prefix, so one running sum finds the level at which the rest shares.

Sampling: each document expects target / size copies of its source. Along the source's documents, ordered by size class
and then pseudo-randomly, the expected copies are summed, one offset of the source is added, and a document is emitted once
for each integer that the sum crosses. Neighbours have similar sizes, so the words taken stay near the target.

The running position is found in three levels (size class, slice of the hash, row), so that no source, however large, is
sorted in one task: windows run over counts of slices, and over the rows of one slice.

Defined cases: a null text has no words; a source without words gets target 0 and no copies; rows that repeat are
documents of their own and may get different counts; an empty table gives an empty result; a null doc_id sorts first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from grovemark.llm.common import stored, table, word_count

SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """From (source, size) rows: source, source_size, target. One row per source; the running sums are over sources only."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("k") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    weighed = ranked.select("source", "k", "source_size", w.alias("w"), (F.lit(float(cap)) * F.col("source_size")).alias("most"))
    order = Window.orderBy(F.col("most") / F.col("w"), "k")
    everything = Window.partitionBy()
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    # The share of one unit of weight if all sources before this one are cut to their caps and this one and the rest are not.
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)
    tried = weighed.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.col("most"))
    # The first that fits sets the level for itself and all after it.
    share = F.min(F.when(F.col("fits"), F.struct((F.col("most") / F.col("w")).alias("r"), "k", "level"))).over(everything)
    settled = tried.withColumn("share", share)
    return settled.select("source", "source_size", F.least("most", F.coalesce(F.col("share.level") * F.col("w"), F.col("most"))).alias("target"))


def allocate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: one row per document."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    # The texts are read once; everything below runs over these narrow rows.
    sizes = stored(narrow.withColumn("h", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)))), "mix")
    placed = sizes.select("*", F.length(F.bin(F.col("size") * F.col("size"))).alias("c"), F.substring("h", 1, 2).alias("b"))
    counts = placed.groupBy("source", "c", "b").agg(F.count(F.lit(1)).alias("n"))
    running = lambda part, by: Window.partitionBy(*part).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    slices = counts.withColumn("in_class", zero(F.sum("n").over(running(["source", "c"], ["b"]))))
    classes = counts.groupBy("source", "c").agg(F.sum("n").alias("n")).withColumn("in_source", zero(F.sum("n").over(running(["source"], ["c"]))))
    classes = classes.join(source_targets(sizes, weights, cap).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "n")
    classes = classes.withColumnsRenamed({"source": "s", "c": "cc"})
    starts = slices.join(classes, F.col("source").eqNullSafe(F.col("s")) & (F.col("c") == F.col("cc"))).select(F.col("source").alias("s"), F.col("c").alias("cc"), F.col("b").alias("bb"), (F.col("in_class") + F.col("in_source")).alias("first"), "source_size", "target")
    row = F.row_number().over(Window.partitionBy("source", "c", "b").orderBy("h", "doc_id", "size"))
    at = placed.withColumn("row", row).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("c") == F.col("cc")) & (F.col("b") == F.col("bb")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # The offset in [0, 1) is drawn from the seed and the source.
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    upto = F.col("first") + F.col("row")
    copies = F.floor(upto * F.col("rate") + F.col("u")) - F.floor((upto - 1) * F.col("rate") + F.col("u"))
    return at.withColumns({"rate": rate, "u": digits}).select("doc_id", "source", "size", "source_size", "target", F.least(copies.cast("long"), F.lit(cap)).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents, each as often as the mix takes it, with all their columns.

    Rows are matched to their counts by (doc_id, source, size) and, where rows agree in these, by their number among them.
    """
    counts = allocate(docs, id_col, text_col, source_col, **how)
    key = ["__id", "__source", "__size"]
    named = dict(zip(key, (F.col(id_col), F.col(source_col), word_count(F.col(text_col))), strict=True))
    # A list of counts per key: rows that agree in id, source and size are handed them out in any order.
    taken = counts.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__n")).where("__copies > 0")
    taken = taken.withColumnsRenamed({"doc_id": "__i", "source": "__s", "size": "__z"})
    same = F.col("__id").eqNullSafe(F.col("__i")) & F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z"))
    joined = docs.withColumns(named).join(taken, same)
    number = F.when(F.col("__n") == 1, F.lit(1)).otherwise(F.row_number().over(Window.partitionBy("__i", "__s", "__z").orderBy(F.col(text_col))))
    # Of n equal keys with c copies in all, row k gets the k-th even share, whole.
    share = F.floor(F.col("__copies") * F.col("__k") / F.col("__n")) - F.floor(F.col("__copies") * (F.col("__k") - 1) / F.col("__n"))
    single = joined.where("__n = 1").withColumn("__share", F.col("__copies"))
    several = joined.where("__n > 1").withColumn("__k", number).withColumn("__share", share).drop("__k")
    return single.unionByName(several).where("__share > 0").withColumn("__copy", F.explode(F.expr("sequence(1L, cast(__share as bigint))"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = allocate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast(T.LongType()).alias("taken"))


def oracle() -> str:
    """DuckDB: one running row number per source; the water level by trying each source as the first that is not cut."""
    return f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM p),
x AS (SELECT *, CAST((k - 1) % 3 + 1 AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS most FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM x) - coalesce(sum(most) OVER (ORDER BY most / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY most / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM x),
v AS (SELECT arg_min(level, (most / w, k)) AS level FROM l WHERE level * w <= most),
t AS (SELECT source, source_size, least(most, coalesce(v.level * w, most)) AS target FROM l, v),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  CAST(('0x' || substr(md5('{SEED}' || coalesce('=' || d.source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u,
  row_number() OVER (PARTITION BY d.source ORDER BY length(bin(size * size)), md5(coalesce(CAST(doc_id AS VARCHAR), '') || '{SEED}'), doc_id NULLS FIRST, size) AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(i * rate + u) - floor((i - 1) * rate + u)) * size AS BIGINT) AS taken FROM r"""
