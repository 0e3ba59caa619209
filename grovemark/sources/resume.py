"""Work in units that can be stopped and taken up again: a log of finished units, appended to after each batch's results."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Checkpoint:
    """Which units are finished, as files of a folder that only ever grow; a batch's file appears once its results are whole."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs, self.root = root.getFileSystem(spark._jsc.hadoopConfiguration()), root

    def done(self) -> DataFrame:
        if not self.fs.exists(self.root):
            return self.spark.createDataFrame([], "unit string, ts timestamp")
        return self.spark.read.schema("unit string, ts timestamp").json(self.path)

    def pending(self, units: DataFrame) -> DataFrame:
        return units.join(self.done().select("unit").distinct(), "unit", "left_anti")

    def mark(self, units: DataFrame) -> None:
        units.select("unit").distinct().withColumn("ts", F.current_timestamp()).write.mode("append").json(self.path)


class Stop:
    """Tells a loop to end after the batch at hand: at a time limit, or once a flag file exists."""

    def __init__(self, spark: SparkSession, seconds: float | None = None, flag: str | None = None) -> None:
        self.until = None if seconds is None else time.monotonic() + seconds
        self.flag = None if flag is None else spark._jvm.org.apache.hadoop.fs.Path(flag)
        self.fs = self.flag and self.flag.getFileSystem(spark._jsc.hadoopConfiguration())

    def asked(self) -> bool:
        return (self.until is not None and time.monotonic() >= self.until) or bool(self.flag and self.fs.exists(self.flag))


def run(units: DataFrame, work: Callable[[DataFrame], DataFrame], results: str, log: Checkpoint, batches: int, stop: Stop | None = None, most: int | None = None) -> int:
    """Works on units(unit, ...) in batches dealt by the unit's hash and returns how many batches it did. A batch's results
    are written to a folder of its own, replaced whole if it has to be done again, and only then marked; so a run that was
    cut off repeats a batch and never doubles a row."""
    done = 0
    numbered = units.withColumn("__b", F.pmod(F.xxhash64("unit"), F.lit(batches)))
    for b in range(batches):
        if (stop is not None and stop.asked()) or (most is not None and done >= most):
            return done
        part = numbered.where(F.col("__b") == b).drop("__b")
        if log.pending(part).isEmpty():
            continue
        work(part).write.mode("overwrite").parquet(f"{results}/batch={b}")
        log.mark(part)
        done += 1
    return done


class EventLog:
    """An append-only log of curation events with ids and times of their own, and the tables derived from it."""

    def __init__(self, spark: SparkSession, path: str, author: str) -> None:
        self.spark, self.path, self.author = spark, path, author

    def append(self, events: DataFrame) -> None:
        """events without event_id, ts and author; each append is a set of files, visible when it is whole."""
        stamped = events.withColumns({"event_id": F.concat(F.date_format(F.current_timestamp(), "yyyyMMddHHmmssSSSSSS"), F.lit(f"-{uuid.uuid4().hex[:8]}-"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")), "ts": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "author": F.lit(self.author)})
        stamped.write.mode("append").json(self.path)

    def commit(self, events: DataFrame, derive: Callable[[DataFrame], dict[str, DataFrame]], out: str, schema: str) -> None:
        """Appends, then writes anew the tables that derive makes of the whole log."""
        self.append(events)
        whole = self.spark.read.schema(schema).option("mode", "DROPMALFORMED").json(self.path)
        for name, rows in derive(whole).items():
            rows.write.mode("overwrite").csv(f"{out}/{name}", header=True, quoteAll=True)
