"""Folds over an append-only event log: events(event_id, key, action, payload); a later event_id wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_event(events: DataFrame) -> DataFrame:
    """key, action, event_id, n: each key's last event; a partial aggregation, so a frequent key is not gathered."""
    return events.groupBy("key").agg(F.max_by("action", "event_id").alias("action"), F.max("event_id").alias("event_id"), F.count(F.lit(1)).alias("n"))


def slots(records: DataFrame, by: tuple[str, ...], order: str) -> DataFrame:
    """Null for the first record of a key, then 1, 2 and so on."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    return records.withColumn("slot", F.when(n > 0, n))


def best_source(records: DataFrame, by: tuple[str, ...], precedence: str) -> DataFrame:
    """The records of the best source that a key has; ties all stay."""
    best = records.groupBy(*by).agg(F.min(precedence).alias("__best"))
    return records.join(best, list(by)).where(F.col(precedence) == F.col("__best")).drop("__best")


#: Actions of the log that set a row's status, and the status.
STATUS = {"suggest": "suggested", "approve": "approved", "reject": "rejected"}
FIELDS = ("label", "edit", "anchor", "verdict")


def fold_state(events: DataFrame) -> DataFrame:
    """key, removed, status, one column per field action, n, n_unknown: each row's state after the whole log.

    A withdrawal counts only for a row that a suggestion made before it; it forgets all that came before. After it a field
    holds its last event's payload, null where that clears it. So a state is the last event of each kind, kept if it is later
    than the last withdrawal that counts: one partial aggregation, in which a frequent key costs one row per task."""
    id_, of = F.col("event_id"), lambda *acts: F.col("action").isin(*acts)
    last = lambda what, *acts: F.max(F.when(of(*acts), F.struct(id_.alias("id"), what.alias("x"))))
    known = [*STATUS, *FIELDS, "withdraw"]
    g = events.groupBy("key").agg(
        F.max(F.when(of("withdraw"), id_)).alias("__w"), F.min(F.when(of("suggest"), id_)).alias("__s"), F.max(F.when(of("suggest"), id_)).alias("__t"),
        last(F.col("action"), *STATUS).alias("__status"), *[last(F.col("payload"), f).alias(f"__{f}") for f in FIELDS],
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.coalesce(~of(*known), F.lit(True)), 1)).alias("n_unknown"),
    )
    floor = F.when(F.col("__s") < F.col("__w"), F.col("__w"))
    later = lambda c: floor.isNull() | (F.col(c) > floor)
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col("__status.x")]
    fields = [F.when(later(f"__{f}.id"), F.col(f"__{f}.x")).alias(f) for f in FIELDS]
    return g.select("key", (floor.isNotNull() & ~later("__t")).alias("removed"), F.when(later("__status.id"), status).alias("status"), *fields, "n", "n_unknown")


def decide(records: DataFrame, policies: DataFrame) -> DataFrame:
    """Each record(status, uncertain, anchored) under each policy(policy, undecided, doubtful, loose: what it lets pass), with
    the first reason against it or kept. There are few policies; they are broadcast."""
    reason = (
        F.when(F.col("status") == "rejected", "rejected").when((F.col("status") != "approved") & ~F.col("undecided"), "undecided")
        .when(F.col("uncertain") & ~F.col("doubtful"), "uncertain").when(~F.col("anchored") & ~F.col("loose"), "unanchored").otherwise("kept")
    )
    return records.crossJoin(F.broadcast(policies)).withColumn("reason", reason)
