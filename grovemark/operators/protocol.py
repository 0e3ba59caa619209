"""Curves, candidate sets and search tiers of the evaluation protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovemark.operators.resampling import draw


def pr_curve(sample: DataFrame) -> DataFrame:
    """threshold, precision, recall, step: one row per distinct conf of sample(conf, label), from the highest down; step is
    the recall that it adds, so the average precision is the sum of step times precision. Rows are first counted by score;
    only the distinct scores are ordered."""
    atoms = sample.groupBy("conf").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    down = Window.orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("pos").over(Window.partitionBy())
    c = atoms.select("conf", "pos", F.sum("n").over(down).alias("k"), F.sum("pos").over(down).alias("tp"), total.alias("all"))
    return c.select(F.col("conf").alias("threshold"), (F.col("tp") / F.col("k")).alias("precision"), F.try_divide("tp", "all").alias("recall"), F.coalesce(F.try_divide("pos", "all"), F.lit(0.0)).alias("step"))


def selective(sample: DataFrame, taus: list[float]) -> DataFrame:
    """tau, coverage, risk (null without a covered row), generalized: losses are rows of label 0."""
    grid = sample.withColumn("tau", F.explode(F.array(*map(F.lit, taus))))
    on = F.col("conf") >= F.col("tau")
    g = grid.groupBy("tau").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(on, 1)).alias("k"), F.sum(F.when(on, 1 - F.col("label")).otherwise(0)).alias("lost"))
    return g.select("tau", (F.col("k") / F.col("n")).alias("coverage"), F.try_divide("lost", "k").alias("risk"), (F.col("lost") / F.col("n")).alias("generalized"))


def loss_curve(scored: DataFrame, reports: DataFrame, taus: list[float]) -> DataFrame:
    """tau, risk: the mean over reports of the share of gold whose score(report, score) is below tau or null; a report
    without gold loses nothing."""
    low = F.when(F.coalesce(F.col("score") >= F.col("tau"), F.lit(False)), 0).otherwise(1)
    each = scored.withColumn("tau", F.explode(F.array(*map(F.lit, taus)))).groupBy("report", "tau").agg(F.avg(low).alias("loss"))
    n = reports.select("report").distinct().agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("tau").agg(F.sum("loss").alias("loss")).crossJoin(F.broadcast(n)).select("tau", (F.col("loss") / F.col("n")).alias("risk"))


def query_set(annotations: DataFrame, closed: DataFrame) -> DataFrame:
    """report, query, hops: each report's terms and their ancestors, by the fewest hops."""
    up = annotations.join(closed, F.col("term") == F.col("descendant"))
    return up.groupBy("report", F.col("ancestor").alias("query")).agg(F.min("hops").alias("hops"))


def relevance(annotations: DataFrame, closed: DataFrame) -> DataFrame:
    """report, query, segment: a segment counts for a query if annotated with it or a descendant."""
    up = annotations.join(closed, F.col("term") == F.col("descendant"))
    return up.select("report", F.col("ancestor").alias("query"), "segment").distinct()


def frequency_buckets(pairs: DataFrame, terms: DataFrame, n: int = 4) -> DataFrame:
    """term, bucket: the terms that occur, in n groups of equal size by frequency, then id; unseen for the rest. Orders the
    terms, not their occurrences."""
    freq = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    cut = freq.select("term", F.ntile(n).over(Window.orderBy("freq", "term")).cast("string").alias("bucket"))
    return terms.select("term").distinct().join(cut, "term", "left").select("term", F.coalesce("bucket", F.lit("unseen")).alias("bucket"))


def nested_folds(reports: DataFrame, outer: int, inner: int, repetitions: int) -> DataFrame:
    """repetition, outer_fold, inner_fold, report, role: for each repetition and outer fold one row per report: eval with
    inner fold -1 in its own outer fold, else train with the inner fold drawn for that outer one."""
    r = reports.select("report").withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
    mine = r.withColumn("own", F.pmod(draw(F.col("report"), F.col("repetition")), F.lit(outer)))
    rows = mine.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))))
    seed = (F.col("repetition") + 1) * 1000 + F.col("outer_fold")
    held = F.col("own") == F.col("outer_fold")
    drawn = F.pmod(draw(F.col("report"), seed), F.lit(inner))
    return rows.select("repetition", "outer_fold", F.when(held, -1).otherwise(drawn).cast("long").alias("inner_fold"), "report", F.when(held, "eval").otherwise("train").alias("role"))


def search(queries: DataFrame, labels: DataFrame, synonyms: DataFrame, limit: int = 10) -> DataFrame:
    """query, place, term, tier of queries(query) over labels(term, label) and synonyms(term, synonym), compared in lower
    case: 0 the label, 1 its start, 2 a synonym, 3 its start, 4 within the label, 5 within a synonym; ties to the shorter
    label, the label, the term. The queries are what users typed: few, broadcast against the ontology's strings."""
    q = F.broadcast(queries.select("query").distinct())
    strings = labels.select("term", F.lower("label").alias("s"), F.lit(0).alias("kind")).unionByName(synonyms.select("term", F.lower("synonym").alias("s"), F.lit(1).alias("kind")))
    low = F.lower("query")
    tier = F.when(F.col("s") == low, F.col("kind") * 2).when(F.col("s").startswith(low), F.col("kind") * 2 + 1).otherwise(F.col("kind") + 4)
    hits = strings.distinct().join(q, F.col("s").contains(low)).where("trim(query) <> ''").groupBy("query", "term").agg(F.min(tier).alias("tier"))
    named = hits.join(labels.groupBy("term").agg(F.min("label").alias("label")), "term")
    place = F.row_number().over(Window.partitionBy("query").orderBy("tier", F.length("label"), "label", "term"))
    return named.withColumn("place", place).where(F.col("place") <= limit).select("query", "place", "term", "tier")
