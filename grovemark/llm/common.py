"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: a run of anything but the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only where that is unset and the master is local (tests, one machine) a
    temporary one is set; on a cluster its absence is an error, since executors don't see each other's folders."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="grovemark-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage, survives a lost executor, and
    keeps a wide scan from running once per use. The folder is removed with the checkpoint folder."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/grovemark-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Removes what stored() wrote, once nothing reads it any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/grovemark-" in f:
            p = spark._jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bounds the rows of an Arrow batch, since a batch of whole texts is held in memory at once; Spark bounds its bytes by
    spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set otherwise."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


#: A Bloom filter's bits: for each key, at least, at most (128 MB); bits of one of its rows.
BITS_PER_KEY, LEAST_BITS, MOST_BITS, ROW_BITS = 16, 1 << 20, 1 << 30, 1 << 15


class Bloom:
    """Which rows may have one of the keys, by a bitmap of bounded size that is built and probed by DataFrame functions.

    keys: a column h of hashes. A row without one of them passes for one that has it with a probability of about 6 %, more
    once there are over MOST_BITS / BITS_PER_KEY keys; a row that has one is never missed. What passes has to be checked.
    """

    def __init__(self, keys: DataFrame, most_bits: int = MOST_BITS) -> None:
        need = BITS_PER_KEY * max(1, keys.count())
        self.rows = max(1, min(most_bits, max(LEAST_BITS, 1 << (need - 1).bit_length())) // ROW_BITS)
        slot = F.pmod("h", F.lit(self.rows * ROW_BITS))
        placed = keys.select(slot.alias("s")).selectExpr(f"s div {ROW_BITS} as __row", f"s % {ROW_BITS} as p")
        self.bits = stored(placed.groupBy("__row").agg(F.bitmap_construct_agg("p").alias("__bits")), "bloom")

    def marked(self, rows: DataFrame, h: Column, name: str) -> DataFrame:
        """rows with one more boolean column: whether the hash h may be among the keys."""
        slot = F.pmod(h, F.lit(self.rows * ROW_BITS))
        # At most 128 MB, whatever the number of keys.
        met = rows.withColumn("__slot", slot).withColumn("__at", F.expr(f"__slot div {ROW_BITS}"))
        met = met.join(F.broadcast(self.bits), F.col("__at") == F.col("__row"), "left")
        byte = f"cast(conv(hex(substring(__bits, cast((__slot % {ROW_BITS}) div 8 as int) + 1, 1)), 16, 10) as int)"
        on = F.expr(f"shiftright({byte}, cast(__slot % 8 as int)) % 2 = 1")
        return met.withColumn(name, F.coalesce(on, F.lit(False))).drop("__slot", "__at", "__row", "__bits")


def with_groups(held: DataFrame, groups: DataFrame, key: str, size: str, max_keys: int, hot: int) -> DataFrame:
    """held joined to groups by key, without gathering a large group in one task. size: the column of groups with the
    number of held rows. Few groups are broadcast; else those of over hot rows are, at most rows / hot at any size."""
    groups = stored(groups, "groups")
    if groups.count() <= max_keys:
        return held.join(F.broadcast(groups), key)
    marked = held.join(F.broadcast(groups.where(F.col(size) > hot)), key, "left")
    rest = marked.where(F.col(size).isNull()).select(*held.columns).join(groups.where(F.col(size) <= hot), key)
    return marked.where(F.col(size).isNotNull()).unionByName(rest)


def drop_rows(docs: DataFrame, goes: DataFrame, id_col: str, key: Column, max_ids: int) -> DataFrame:
    """docs without the rows whose (id, key) is in goes; where its tied is true, one of these rows stays.

    A Bloom filter of the ids lets most rows that stay pass without a shuffle; key is computed and (id, key) joined only for
    the rest. goes has one row per (id, key): no key of the join, a null id among them, gathers more than its own copies.
    """
    fates = stored(goes.groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).agg(F.max("tied").alias("__tied")), "fates")
    hashed = lambda c: F.xxhash64(F.coalesce(c.cast("string"), F.lit("")))
    ids, columns = F.col(f"`{id_col}`"), [F.col(f"`{c}`") for c in docs.columns]
    marked = Bloom(fates.select(hashed(F.col("__id")).alias("h"))).marked(docs, hashed(ids), "__may")
    same = ids.eqNullSafe(F.col("__id")) & (F.col("__mine") == F.col("__key"))
    # Where the rows that go are broadcast the others need not be told apart first, which saves a scan.
    few = fates.count() <= max_ids
    some = marked if few else marked.where("__may")
    judged = some.withColumn("__mine", F.when(F.col("__may"), key)).join(F.broadcast(fates) if few else fates, same, "left")
    stays = judged.where("__key is null").select(*columns)
    tied = judged.where("__tied").dropDuplicates(["__id", "__key"]).select(*columns)
    return (stays if few else stays.unionByName(marked.where("not __may").select(*columns))).unionByName(tied)
