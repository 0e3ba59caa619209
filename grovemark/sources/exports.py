"""Further sinks: linkage, labels and comments of a curation, results of a rule, a walk's artefacts, merged shards, and a whole
data set with a manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovemark.functions.scalars import captured_mass
from grovemark.sources.writers import write_csv, write_jsonl

LINKAGE = ("report_id", "sentence_number", "line_index", "candidate_string", "normaliser", "hpo_id", "score", "source", "negated")


def write_linkage(rows: DataFrame, path: str) -> None:
    """Linkage rows with their fields in a fixed order."""
    write_jsonl(rows.select(*LINKAGE), path, ("report_id", "sentence_number", "line_index"))


def long_labels(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """report, code, label, group: one row for each label of each annotation that vocabulary(label, group) knows."""
    return rows.select("report", "code", F.explode("labels").alias("label")).join(F.broadcast(vocabulary), "label").select("report", "code", "label", "group")


def flat_comments(rows: DataFrame) -> DataFrame:
    """report, place, ts, comment of rows(report, comments): oldest first."""
    each = rows.select("report", F.explode("comments").alias("c")).select("report", "c.ts", "c.comment")
    return each.withColumn("place", F.row_number().over(Window.partitionBy("report").orderBy("ts", "comment"))).select("report", "place", "ts", "comment")


def wide_labels(rows: DataFrame, reports: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """One row per report and a 0 or 1 for each label; reports without any stay."""
    has = [F.max((F.col("label") == v).cast("int")).alias(v) for v in vocabulary]
    wide = rows.select("report", F.explode("labels").alias("label")).groupBy("report").agg(*has)
    return reports.select("report").distinct().join(wide, "report", "left").na.fill(0, list(vocabulary))


def rule_rows(predicted: DataFrame, gold: DataFrame, reports: DataFrame) -> DataFrame:
    """Rows per term (prediction, ground_truth) and one summary row per report with both sets."""
    both = predicted.select("report", "term").distinct().withColumn("p", F.lit(1)).join(gold.select("report", "term").distinct().withColumn("y", F.lit(1)), ["report", "term"], "full")
    none = F.lit(None).cast("array<string>")
    terms = both.select(F.col("report").alias("report_id"), F.col("term").alias("hpo_id"), F.coalesce("p", F.lit(0)).alias("prediction"), F.coalesce("y", F.lit(0)).alias("ground_truth"), F.lit(False).alias("summary"), none.alias("predicted_set"), none.alias("gold_set"))
    sets = both.groupBy("report").agg(F.array_sort(F.collect_set(F.when(F.col("p") == 1, F.col("term")))).alias("a"), F.array_sort(F.collect_set(F.when(F.col("y") == 1, F.col("term")))).alias("b"))
    empty = F.array().cast("array<string>")
    whole = reports.select("report").distinct().join(sets, "report", "left")
    summary = whole.select(F.col("report").alias("report_id"), F.lit(None).cast("string").alias("hpo_id"), F.lit(None).cast("int").alias("prediction"), F.lit(None).cast("int").alias("ground_truth"), F.lit(True).alias("summary"), F.coalesce("a", empty).alias("predicted_set"), F.coalesce("b", empty).alias("gold_set"))
    return terms.unionByName(summary)


def call_records(calls: DataFrame) -> DataFrame:
    """calls with margin, verdict and captured mass from their logits."""
    margin = F.col("logit_yes") - F.col("logit_no")
    return calls.withColumns({"margin": margin, "verdict": F.when(margin > 0, "Yes").otherwise("No"), "captured_mass": captured_mass(F.col("logit_yes"), F.col("logit_no"), F.col("logsumexp_all"))})


def write_walk(visits: DataFrame, path: str, tau_prune: float, tau_accept: float) -> None:
    """Nodes, predictions and a summary per report of a walk at one pair of thresholds, each in a folder by thresholds."""
    at = f"tau_prune={tau_prune}/tau_accept={tau_accept}"
    nodes = visits.withColumn("accepted", F.col("accept_score") >= tau_accept)
    nodes.write.mode("overwrite").parquet(f"{path}/nodes/{at}")
    nodes.where("accepted").select("report", "term").write.mode("overwrite").parquet(f"{path}/predictions/{at}")
    per = nodes.groupBy("report").agg(F.count(F.lit(1)).alias("n_visited"), F.count_if("accepted").alias("n_accepted"), F.sum("n_calls").alias("n_calls"))
    per.write.mode("overwrite").parquet(f"{path}/traversal/{at}")


def read_walk(spark: SparkSession, path: str, what: str) -> DataFrame:
    """One kind of artefact of all threshold pairs; these are columns by the folders' names."""
    return spark.read.option("basePath", f"{path}/{what}").parquet(f"{path}/{what}/*/*")


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """repetition, outer_fold, eval, train, inner: the reports of each fold as sorted arrays, inner ones by number."""
    rows = spark.read.csv(path, header=True).select(*[F.col(c).cast("int").alias(c) for c in ("repetition", "outer_fold", "inner_fold")], "report", "role")
    ids = lambda on: F.array_sort(F.collect_list(F.when(on, F.col("report"))))
    held = F.col("role") == "eval"
    inner = F.array_sort(F.collect_set(F.when(~held, F.col("inner_fold"))))
    return rows.groupBy("repetition", "outer_fold").agg(ids(held).alias("eval"), ids(~held).alias("train"), inner.alias("inner"))


def merged_shards(lines: DataFrame, key: str) -> DataFrame:
    """base, value of lines(name, value) of shards: by their name without _sKofN_. Where lines state the key, exact repeats
    of a line go and lines without it too; a merged file is left out where shards of its name exist."""
    base = F.regexp_replace("name", r"_s[0-9]+of[0-9]+(?=[_.])", "")
    rows = lines.withColumns({"base": base, "shard": base != F.col("name"), "k": F.get_json_object("value", f"$.{key}")}).where(F.trim("value") != "")
    has = rows.groupBy("base").agg(F.max("shard").alias("sharded"), F.max(F.col("k").isNotNull()).alias("keyed"))
    met = rows.join(F.broadcast(has), "base").where("shard or not sharded")
    keyed = met.where("keyed and k is not null").select("base", "value").distinct()
    return keyed.unionByName(met.where("not keyed").select("base", "value"))


def first_of_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")


def write_dataset(path: str, **parts: DataFrame) -> DataFrame:
    """Writes each part as a quoted table and returns the manifest: part, n_rows and a digest of its rows in any order."""
    out = None
    for name, rows in parts.items():
        write_csv(rows, f"{path}/{name}")
        cells = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in rows.columns])
        # Added up in decimals: no order, no overflow, and repeated rows count.
        m = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.xxhash64(cells).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("d")).select(F.lit(name).alias("part"), "n_rows", F.sha2(F.col("d").cast("string"), 256).alias("digest"))
        out = m if out is None else out.unionByName(m)
    return out
