"""Tables that a study reports: descriptive statistics, rows of results, costs, differences of two golds, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovemark.operators.quality import aligned, counted, prf, ratio


def quartiles(c: str) -> Column:
    return F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))


def cohort_statistics(gold: DataFrame, reports: DataFrame, edges: DataFrame, closed: DataFrame, depth: DataFrame) -> DataFrame:
    """One row on gold(report, term) over reports(report, words): sizes, quartiles of depth and length, and how often a term
    and its parent, or any ancestor, are both gold in one report."""
    pairs = gold.select("report", "term").distinct()
    n = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("term").alias("n_terms"), F.count_distinct("report").alias("n_nonempty"))
    r = reports.agg(F.count(F.lit(1)).alias("n_reports"), quartiles("words").alias("w"), F.avg("words").alias("words_mean"))
    d = pairs.join(depth, "term").agg(quartiles("depth").alias("d"))
    other = pairs.select("report", F.col("term").alias("other"))
    near = pairs.join(edges, pairs.term == edges.child).select("report", F.col("parent").alias("other")).join(other, ["report", "other"], "left_semi").agg(F.count(F.lit(1)).alias("n_parent_child"))
    above = pairs.join(closed.where("hops > 0"), F.col("term") == F.col("descendant")).select("report", F.col("ancestor").alias("other")).join(other, ["report", "other"], "left_semi").agg(F.count(F.lit(1)).alias("n_ancestor_descendant"))
    single = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n")).agg((100 * F.avg((F.col("n") == 1).cast("double"))).alias("singleton_share"))
    one = n
    for part in (r, d, near, above, single):
        one = one.crossJoin(part)
    at = lambda c, k: F.element_at(c, k)
    return one.select(
        "n_reports", (F.col("n_reports") - F.col("n_nonempty")).alias("n_empty"), "n_pairs", "n_terms", ratio(F.col("n_pairs"), F.col("n_reports")).alias("terms_per_report"), ratio(F.col("n_pairs"), F.col("n_nonempty")).alias("terms_per_nonempty"),
        at("d", 1).alias("depth_q1"), at("d", 2).alias("depth_median"), at("d", 3).alias("depth_q3"), "n_parent_child", "n_ancestor_descendant", "singleton_share", at("w", 1).alias("words_q1"), at("w", 2).alias("words_median"), at("w", 3).alias("words_q3"), "words_mean",
    )


def gold_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """report, term, change: kept, added or removed between two golds."""
    both = aligned(old, new)
    return both.select("report", "term", F.when(F.col("g") + F.col("p") == 2, "kept").when(F.col("p") == 1, "added").otherwise("removed").alias("change"))


def reannotation(diff: DataFrame) -> DataFrame:
    """One row: kept, added, removed, union and their overlap."""
    n = diff.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("kept", "added", "removed")], F.count(F.lit(1)).alias("n_union"))
    return n.withColumn("jaccard", ratio(F.col("kept"), F.col("n_union")))


def drop_counts(rows: DataFrame, criteria: dict[str, str]) -> DataFrame:
    """criterion, n of rows(reason); a reason that no criterion names is an error."""
    known = F.create_map(*[F.lit(x) for kv in criteria.items() for x in kv])
    named = F.coalesce(F.try_element_at(known, F.col("reason")), F.raise_error(F.concat(F.lit("unknown reason: "), F.col("reason"))).cast("string"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("k")).groupBy(named.alias("criterion")).agg(F.sum("k").alias("n"))


def spread(values: DataFrame, c: str) -> DataFrame:
    """One row: number, sum, mean, median, 95th percentile, least and greatest."""
    q = F.percentile(c, F.array(F.lit(0.5), F.lit(0.95)))
    return values.agg(F.count(c).alias("n"), F.sum(c).alias("total"), F.avg(c).alias("mean"), q.alias("q"), F.min(c).alias("low"), F.max(c).alias("high")).select("n", "total", "mean", F.element_at("q", 1).alias("median"), F.element_at("q", 2).alias("p95"), "low", "high")


def captured(calls: DataFrame, floors: Sequence[float]) -> DataFrame:
    """One row on calls(mass): least, 5th percentile, median, mean, and the share below each floor."""
    q = F.percentile("mass", F.array(F.lit(0.05), F.lit(0.5)))
    low = [F.avg((F.col("mass") < f).cast("double")).alias(f"below_{i}") for i, f in enumerate(floors)]
    return calls.agg(F.min("mass").alias("low"), q.alias("q"), F.avg("mass").alias("mean"), *low).select("low", F.element_at("q", 1).alias("p5"), F.element_at("q", 2).alias("median"), "mean", *[f"below_{i}" for i in range(len(floors))])


def greatest_gap(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row: how many keys both have, the greatest absolute difference of their values, and where it is (the smallest)."""
    met = a.join(b.withColumnRenamed(value, "__b"), list(keys)).withColumn("gap", F.abs(F.col(value) - F.col("__b")))
    top = met.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.round("gap", 12)).alias("g"), *keys)).alias("x"))
    return top.select("n", (-F.col("x.g")).alias("gap"), *[F.col(f"x.{k}").alias(k) for k in keys])


def graded(exact: DataFrame, soft: DataFrame, closure: DataFrame) -> DataFrame:
    """kind, macro precision, recall and f1 of three one-row tables, and the softness each adds to exact f1."""
    rows = None
    for kind, t in (("exact", exact), ("soft", soft), ("closure", closure)):
        part = t.select(F.lit(kind).alias("kind"), "precision", "recall", "f1")
        rows = part if rows is None else rows.unionByName(part)
    base = exact.select(F.col("f1").alias("base"))
    return rows.crossJoin(F.broadcast(base)).select("kind", "precision", "recall", "f1", (F.col("f1") - F.col("base")).alias("tax"))


def binary(labelled: DataFrame) -> DataFrame:
    """One row on labelled(y, p): accuracy, precision, recall, f1 and the number of wrong ones of each kind."""
    y, p = F.col("y"), F.col("p")
    c = labelled.agg(F.count(F.lit(1)).alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("false_pos"), F.count_if(y & ~p).alias("false_neg"))
    q = prf(F.col("tp"), F.col("false_pos"), F.col("false_neg"))
    return c.select("n", ratio(F.col("n") - F.col("false_pos") - F.col("false_neg"), F.col("n")).alias("accuracy"), *q, "false_pos", "false_neg")


def result_row(gold: DataFrame, pred: DataFrame, reports: DataFrame) -> DataFrame:
    """One row of a results table: micro and macro quality and predictions a report."""
    from grovemark.operators.quality import macro, report_prf, with_reports

    units = with_reports(counted(aligned(gold, pred), "report"), reports)
    whole = units.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.count(F.lit(1)).alias("n_reports"))
    micro = whole.select("n_reports", *prf(F.col("tp"), F.col("fp"), F.col("fn")), ratio(F.col("tp") + F.col("fp"), F.col("n_reports")).alias("predictions_per_report"))
    return micro.crossJoin(macro(report_prf(units)).select("macro_precision", "macro_recall", "macro_f1"))


def main_result(rows: DataFrame, by: Sequence[str], score: str, order: str) -> DataFrame:
    """rows with main: the best score of its group, of equal ones the first in order; null and NaN never win."""
    ok = F.col(score).isNotNull() & ~F.isnan(score)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.when(ok, F.col(score)).desc_nulls_last(), order))
    return rows.withColumn("main", (place == 1) & ok)


def with_placeholders(rows: DataFrame, expected: DataFrame, keys: Sequence[str], reason: str) -> DataFrame:
    """rows, and for every expected key without one a row of nulls that says why."""
    absent = expected.select(*keys).distinct().join(rows, list(keys), "left_anti").withColumn("reason", F.lit(reason))
    return rows.withColumn("reason", F.lit(None).cast("string")).unionByName(absent, allowMissingColumns=True)


def pareto(rows: DataFrame, cost: str, score: str) -> DataFrame:
    """rows with frontier: no cheaper row, nor an equally dear one before it, scores as much. A running maximum over rows by
    rising cost; the rows are points of a table."""
    before = F.max(score).over(Window.orderBy(cost, F.desc(score)).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("frontier", F.coalesce(F.col(score) > before, F.lit(True)))


def side_by_side(rows: DataFrame, key: str, which: str, a: str, b: str, values: Sequence[str]) -> DataFrame:
    """key and for each value its number under a, under b, and the difference; only keys that both have."""
    pick = lambda w: [F.max(F.when(F.col(which) == w, F.col(v))).alias(f"{v}_{w}") for v in values]
    wide = rows.where(F.col(which).isin(a, b)).groupBy(key).agg(*pick(a), *pick(b), F.count_distinct(which).alias("__n")).where("__n = 2")
    return wide.select(key, *[c for v in values for c in (F.col(f"{v}_{a}"), F.col(f"{v}_{b}"), (F.col(f"{v}_{b}") - F.col(f"{v}_{a}")).alias(f"{v}_delta"))])


def availability(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, status, n_files, problems of each expected cell: present, empty (files without rows) or missing."""
    f = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows"), F.count_if("stale").alias("n_stale"))
    met = expected.select(*keys).distinct().join(f, list(keys), "left").na.fill(0)
    status = F.when(F.col("n_files") == 0, "missing").when(F.col("n_rows") == 0, "empty").otherwise("present")
    problem = F.concat_ws("; ", F.when(F.col("n_files") == 0, "no file"), F.when((F.col("n_files") > 0) & (F.col("n_rows") == 0), "no row"), F.when(F.col("n_stale") > 0, F.concat(F.col("n_stale").cast("string"), F.lit(" stale"))))
    return met.select(*keys, status.alias("status"), "n_files", problem.alias("problems"))


def stale_shards(files: DataFrame) -> DataFrame:
    """base, n_shards, merged, stale: of files(name, mtime) by their name without _sKofN_; stale where a shard is newer than
    the merged file or there is none."""
    base = F.regexp_replace("name", r"_s[0-9]+of[0-9]+(?=[_.])", "")
    shard = base != F.col("name")
    g = files.withColumn("base", base).groupBy("base").agg(F.count_if(shard).alias("n_shards"), F.max(F.when(~shard, F.col("mtime"))).alias("at"), F.max(F.when(shard, F.col("mtime"))).alias("newest"))
    return g.where("n_shards > 0").select("base", "n_shards", F.col("at").isNotNull().alias("merged"), (F.col("at").isNull() | (F.col("newest") > F.col("at"))).alias("stale"))


def complete_sums(rows: DataFrame, by: str, member: str, value: str, expected: int) -> DataFrame:
    """by, total: the sum over members, only where all that are expected are there."""
    return rows.groupBy(by).agg(F.sum(value).alias("total"), F.count_distinct(member).alias("n")).where(F.col("n") == expected).select(by, "total")


def first_of(*sources: Column) -> Column:
    """The first source that has a value, and its number."""
    found = F.coalesce(*[F.when(c.isNotNull(), F.struct(F.lit(i).alias("source"), c.alias("value"))) for i, c in enumerate(sources)])
    return found


def crossing(points: DataFrame, by: str, x: str, y: str, target: float) -> DataFrame:
    """by, x: where y first reaches the target along rising x, on the line from the point before."""
    w = Window.partitionBy(by).orderBy(x)
    p = points.select(by, x, y, F.lag(x).over(w).alias("px"), F.lag(y).over(w).alias("py")).where(F.col(y) >= target)
    at = F.when(F.col("py").isNull() | (F.col("py") >= target), F.col(x)).otherwise(F.col("px") + (target - F.col("py")) / (F.col(y) - F.col("py")) * (F.col(x) - F.col("px")))
    return p.withColumn("at", at).groupBy(by).agg(F.min_by("at", x).alias(x))


def chunked(names: DataFrame, size: int) -> DataFrame:
    """names(name) with chunk: size to a chunk, in order."""
    return names.withColumn("chunk", F.floor((F.row_number().over(Window.orderBy("name")) - 1) / size))


def long_metrics(rows: DataFrame, key: str) -> DataFrame:
    """name, value: every numeric cell of a table under key.column."""
    cols = [f.name for f in rows.schema if f.name != key]
    return rows.select(F.explode(F.array(*[F.struct(F.concat_ws(".", F.col(key).cast("string"), F.lit(c)).alias("name"), F.col(c).cast("double").alias("value")) for c in cols])).alias("x")).select("x.name", "x.value").where("value is not null")
