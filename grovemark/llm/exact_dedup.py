"""Exact duplicate removal by progressive refinement, in DataFrame operations only.

Texts are equal when they agree after lower-casing A-Z. Three levels, each a scan that emits narrow rows: lengths, for
documents of a repeated length a hash of the text's beginning, and for documents that share both a SHA-256 of the whole
text. Only those survivors' texts are hashed in full. Of a group the row with the largest id stays.

The surviving keys go into a Bloom filter of bounded size that the scan probes, so at every size the full hash is computed
for the survivors and a few others only, and no text is shuffled to find the groups. Groups are counted by partial
aggregation and met with their rows again by broadcast while they are few; beyond that only the groups of over HOT rows are
(there can be at most rows / HOT of them) and the rest, of bounded size, by a join. So no group lands in one task whole.

Defined cases: a null text equals an empty one; a null id never wins over another id; of rows that repeat with the same id
and text exactly one counts as kept; an empty table gives an empty result; other columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemark.llm.common import MOST_BITS, Bloom, ascii_lower, drop_rows, stored, table, with_groups

#: Characters of the second level's hash.
PREFIX = 256
#: Keys that may be broadcast: 32 bytes each in memory and under 100 MB in all.
MAX_KEYS = 1_000_000
#: Rows of a group that one task may take in a join.
HOT = 100_000


def normal(text_col: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, max_keys: int = MAX_KEYS, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, hit, hash. hit: the document survives the first two levels, or the filter can't tell; hash: its SHA-256, null for the rest unless
    digest_all asks for it too."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Lower-casing A-Z keeps the length; a level lower-cases only what it hashes.
    long = rows.withColumn("len", F.octet_length("text"))
    # Level 1. There are at most as many lengths as the longest text has bytes; a join by a frequent one would land in a task.
    lengths = stored(long.groupBy("len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("len"), "dedup-lengths")
    if lengths.count() <= max_keys:
        lengths = F.broadcast(lengths)
    begun = long.withColumn("prefix", F.xxhash64(ascii_lower(F.substring("text", 1, PREFIX))))
    # Level 2, over narrow rows.
    keys = begun.select("len", "prefix").join(lengths, "len", "left_semi").groupBy("len", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keys = stored(keys.select("len", "prefix"), "dedup-keys")
    # Level 3: a filter of bounded size lets pass all that share both, and few others, whose hash is then met by no other.
    met = Bloom(keys.select(F.xxhash64("len", "prefix").alias("h")), most_bits).marked(begun, F.xxhash64("len", "prefix"), "hit")
    return met.select("doc_id", "hit", F.when(F.col("hit") | F.lit(digest_all), F.sha2(ascii_lower(F.col("text")), 256)).alias("hash"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, max_keys: int = MAX_KEYS, hot: int = HOT, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, hash (as in signatures())."""
    rows = stored(signatures(docs, id_col, text_col, digest_all, max_keys, most_bits), "dedup-rows")
    hits = rows.where("hit")
    # Repeated (id, hash) rows travel as one with a count.
    held = hits.groupBy("hash", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    groups = hits.groupBy("hash").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = with_groups(held, groups, "hash", "group_size", max_keys, hot).withColumn("i", F.explode(F.expr("sequence(1L, n)")))
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)
    found = found.select("doc_id", "keep_id", "group_size", first.alias("kept"), "hash")
    alone = rows.where("not hit").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "hash")
    return found.unionByName(alone)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_keys: int = MAX_KEYS, hot: int = HOT) -> DataFrame:
    """The documents without the copies, with all their columns."""
    hits = stored(signatures(docs, id_col, text_col, max_keys=max_keys), "dedup-rows").where("hit")
    groups = hits.groupBy("hash").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    held = with_groups(hits.groupBy("hash", "doc_id").agg(F.count(F.lit(1)).alias("n")), groups, "hash", "group_size", max_keys, hot)
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # What goes; tied: rows that repeat with the id that stays, of which one does.
    goes = held.select(F.col("doc_id").alias("id"), F.col("hash").alias("key"), same.alias("tied"), "n").where("not tied or n > 1")
    return drop_rows(docs, goes, id_col, F.sha2(normal(text_col), 256), max_keys)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_groups(table(spark, sf_dir, "documents"), digest_all=True)
    return out.withColumnRenamed("hash", "text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def oracle() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, sha256({low}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)"""
