"""Queries on votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovemark.operators import votes as v
from grovemark.operators.quality import ratio
from grovemark.plans import fixtures as fx
from grovemark.plans.fixtures import div, sql
from grovemark.plans.registry import query

J = 8
_K = "SELECT k, count(*) AS n_pred, count(g.term) AS tp, " + div("2 * count(g.term)", "(count(*) + (SELECT count(*) FROM gold_d))") + f" AS f1 FROM (SELECT unnest(range(1, votes + 1)) AS k, report, term FROM c WHERE votes <= {J}) x LEFT JOIN gold_d g ON g.report = x.report AND g.term = x.term GROUP BY k"


def _by_k(counts, gold):
    at = v.at_each_k(counts, J).join(gold.withColumn("y", F.lit(1)), ["report", "term"], "left").groupBy("k").agg(F.count(F.lit(1)).alias("n_pred"), F.count("y").alias("tp"))
    return at.crossJoin(gold.agg(F.count(F.lit(1)).alias("t"))).select("k", "n_pred", "tp", ratio(2 * F.col("tp"), F.col("n_pred") + F.col("t")).alias("f1"))


_UNIT = {
    "report": "SELECT report, term, count(DISTINCT juror) AS votes FROM detections GROUP BY ALL",
    "segment": "SELECT report, term, max(n) AS votes FROM (SELECT report, segment, term, count(DISTINCT juror) AS n FROM detections GROUP BY ALL) GROUP BY ALL",
    "window": "SELECT report, term, max(n) AS votes FROM (SELECT c.report, c.segment, d.term, count(DISTINCT d.juror) AS n FROM (SELECT DISTINCT report, segment FROM detections) c JOIN detections d ON d.report = c.report AND d.segment BETWEEN c.segment - 1 AND c.segment + 1 GROUP BY ALL) GROUP BY ALL",
}
for _unit, _text in _UNIT.items():

    @query(f"vote_{_unit}_k", "k:i n_pred:i tp:i f1:d", sql(_K, "detections", "gold_d", c=_text))
    def _(spark, d, unit=_unit):
        return _by_k(v.max_counts(v.packed(fx.detections(spark, d), unit)), fx.gold_d(spark, d))


@query("vote_closure_k", "term:i votes:i n_reports:i", sql("SELECT term, votes, count(*) AS n_reports FROM (SELECT report, ancestor AS term, count(DISTINCT juror) AS votes FROM detections JOIN tree_d ON term = descendant GROUP BY ALL) GROUP BY ALL", "detections", "tree_d"))
def _(spark, d):
    return v.closure_counts(fx.detections(spark, d), fx.small_tree(spark, d)).groupBy("term", "votes").agg(F.count(F.lit(1)).alias("n_reports"))


@query("vote_plurality", "report:i term:i", sql("SELECT DISTINCT report, term FROM (SELECT report, term, rank() OVER (PARTITION BY report, segment ORDER BY n DESC) AS r FROM (SELECT report, segment, term, count(DISTINCT juror) AS n FROM detections GROUP BY ALL)) WHERE r = 1", "detections"))
def _(spark, d):
    return v.plurality(fx.detections(spark, d))


@query("vote_mask_histogram", "mask:i n_terms:i n_gold:i", sql("SELECT * FROM hist", "hist"))
def _(spark, d):
    return v.mask_histogram(fx.detections(spark, d), fx.gold_d(spark, d))


def _values(spark, d, k=3):
    hist = v.mask_histogram(fx.detections(spark, d), fx.gold_d(spark, d))
    return v.subset_f1(hist, fx.gold_d(spark, d).count(), J, k)


_SUB = f"SELECT s.subset, CASE WHEN s.subset = 0 THEN 0 ELSE {div('2 * coalesce(sum(h.n_gold), 0)', '(coalesce(sum(h.n_terms), 0) + (SELECT count(*) FROM gold_d))')} END AS f1 FROM range(256) s(subset) LEFT JOIN hist h ON bit_count(h.mask & s.subset) >= greatest(1, least(3, bit_count(s.subset))) GROUP BY s.subset"


@query("vote_coalition_values", "subset:i f1:d", sql("SELECT * FROM val", "hist", val=_SUB))
def _(spark, d):
    return _values(spark, d)


@query("vote_leave_one_out", "juror:i f1:d", sql("SELECT juror, f1 FROM range(8) j(juror) JOIN val ON subset = 255 - (CAST(1 AS BIGINT) << juror)", "hist", val=_SUB))
def _(spark, d):
    left_out = F.expr("255 - shiftleft(1L, cast(juror as int))")
    return spark.range(J).withColumnRenamed("id", "juror").withColumn("subset", left_out).join(_values(spark, d), "subset").select("juror", "f1")


@query("vote_shapley", "juror:i value:d",
       sql("SELECT juror, sum((b.f1 - a.f1) * CAST(factorial(CAST(bit_count(a.subset) AS INT)) * factorial(CAST(7 - bit_count(a.subset) AS INT)) AS DOUBLE) / 40320) AS value FROM range(8) j(juror) JOIN val a ON (a.subset & (CAST(1 AS BIGINT) << juror)) = 0 JOIN val b ON b.subset = a.subset + (CAST(1 AS BIGINT) << juror) GROUP BY juror", "hist", val=_SUB))
def _(spark, d):
    return v.shapley(_values(spark, d), J)


@query("vote_unique_recall", "juror:i n_gold:i", sql("SELECT juror, sum(n_gold) AS n_gold FROM hist JOIN range(8) j(juror) ON mask = (CAST(1 AS BIGINT) << juror) GROUP BY juror", "hist"))
def _(spark, d):
    h = v.mask_histogram(fx.detections(spark, d), fx.gold_d(spark, d)).where(F.bit_count("mask") == 1)
    return h.groupBy(F.log2("mask").cast("long").alias("juror")).agg(F.sum("n_gold").alias("n_gold"))


@query("vote_coalitions", "mask:i n_terms:i n_gold:i place:i", sql("SELECT * FROM (SELECT *, row_number() OVER (ORDER BY n_terms DESC, mask) AS place FROM hist) WHERE place <= 12", "hist"))
def _(spark, d):
    from pyspark.sql.window import Window

    h = v.mask_histogram(fx.detections(spark, d), fx.gold_d(spark, d))
    return h.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_terms"), "mask"))).where("place <= 12")


@query("voter_profile", "juror:i decisive_tp:i decisive_fp:i", sql("SELECT juror, sum(n_gold) AS decisive_tp, sum(n_terms - n_gold) AS decisive_fp FROM hist JOIN range(8) j(juror) ON (mask & (CAST(1 AS BIGINT) << juror)) <> 0 WHERE bit_count(mask) = 3 GROUP BY juror", "hist"))
def _(spark, d):
    h = v.mask_histogram(fx.detections(spark, d), fx.gold_d(spark, d)).where(F.bit_count("mask") == 3)
    h = h.withColumn("juror", F.explode(F.sequence(F.lit(0), F.lit(J - 1)))).where(F.expr("mask & shiftleft(1L, juror) <> 0"))
    return h.groupBy("juror").agg(F.sum("n_gold").alias("decisive_tp"), F.sum(F.col("n_terms") - F.col("n_gold")).alias("decisive_fp"))


@query("recoverable_by_k", "votes:i n_missed:i", sql("SELECT coalesce(bit_count(m.mask), 0) AS votes, count(*) AS n_missed FROM gold_d g LEFT JOIN masks m ON m.report = g.report AND m.term = g.term WHERE coalesce(bit_count(m.mask), 0) < 3 GROUP BY 1", "masks", "gold_d"))
def _(spark, d):
    m = fx.gold_d(spark, d).join(v.masks(fx.detections(spark, d)), ["report", "term"], "left").select(F.coalesce(F.bit_count("mask"), F.lit(0)).alias("votes"))
    return m.where("votes < 3").groupBy("votes").agg(F.count(F.lit(1)).alias("n_missed"))


_CELL = "SELECT juror AS row, segment AS col, CAST(count(*) AS DOUBLE) AS value FROM detections GROUP BY ALL"


@query("two_way_anova", "ss_row:d ss_col:d ss_interaction:d ss_total:d",
       sql("SELECT sum((r - m) ** 2) AS ss_row, sum((c - m) ** 2) AS ss_col, sum((value - r - c + m) ** 2) AS ss_interaction, sum((value - m) ** 2) AS ss_total FROM (SELECT value, avg(value) OVER (PARTITION BY row) AS r, avg(value) OVER (PARTITION BY col) AS c, avg(value) OVER () AS m FROM cell)", "detections", cell=_CELL))
def _(spark, d):
    cells = fx.detections(spark, d).groupBy(F.col("juror").alias("row"), F.col("segment").alias("col")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return v.two_way(cells)
