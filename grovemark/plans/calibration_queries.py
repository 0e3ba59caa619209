"""Queries on calibration and selective risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovemark.operators import calibration as c
from grovemark.plans import fixtures as fx
from grovemark.plans.fixtures import div, sql
from grovemark.plans.registry import query

_W = "SELECT least(floor(conf * {n}), {m}) AS bin, {by} count(*) AS n, avg(conf) AS mean_conf, avg(label) AS accuracy FROM {src} GROUP BY ALL"
_E = div("sum(abs(accuracy - mean_conf) * n)", "sum(n)") + " AS ece, sum(n) AS n"


def _w(n: int, by: str = "", src: str = "sample") -> str:
    return _W.format(n=n, m=n - 1, by=by, src=src)


@query("reliability_bins", "bin:i n:i mean_conf:d accuracy:d", sql(_w(10), "sample"))
def _(spark, d):
    return c.width_bins(fx.sample(spark, d), 10)


@query("ece_width", "ece:d n:i", sql(f"SELECT {_E} FROM ({_w(10)})", "sample"))
def _(spark, d):
    return c.ece(c.width_bins(fx.sample(spark, d), 10))


_MASS = "SELECT len(list_filter(edges, lambda e: e <= conf)) AS bin, count(*) AS n, avg(conf) AS mean_conf, avg(label) AS accuracy FROM sample, (SELECT quantile_cont(conf, [" + ", ".join(f"{i}/15.0" for i in range(1, 15)) + "]) AS edges FROM sample) GROUP BY 1"


@query("ece_mass", "ece:d n:i", sql(f"SELECT {_E} FROM ({_MASS})", "sample"))
def _(spark, d):
    return c.ece(c.mass_bins(fx.sample(spark, d), 15))


@query("conditional_ece", "grp:s ece:d n:i", sql(f"SELECT grp, {_E} FROM ({_w(15, 'grp,')}) GROUP BY grp", "sample"))
def _(spark, d):
    return c.ece(c.width_bins(fx.sample(spark, d), 15, "grp"), "grp")


@query("tail_ece", "ece:d n:i coverage:d", sql(f"SELECT {_E}, sum(n) / (SELECT count(*) FROM sample) AS coverage FROM ({_w(10, src='(SELECT * FROM sample WHERE conf <= 0.5)')})", "sample"))
def _(spark, d):
    s = fx.sample(spark, d)
    return c.ece(c.width_bins(s.where("conf <= 0.5"), 10)).crossJoin(s.agg(F.count(F.lit(1)).alias("t"))).select("ece", "n", (F.col("n") / F.col("t")).alias("coverage"))


@query("brier", "grp:s brier:d n:i", sql("SELECT grp, avg((conf - label) ** 2) AS brier, count(*) AS n FROM sample GROUP BY grp", "sample"))
def _(spark, d):
    return c.brier(fx.sample(spark, d), "grp")


_Z = c.Z95


@query("discrete_scores_wilson", "score:d n:i positives:i rate:d low:d high:d",
       sql(f"SELECT *, greatest((rate + {_Z**2} / (2 * n) - {_Z} * sqrt(rate * (1 - rate) / n + {_Z**2} / (4 * n * n))) / (1 + {_Z**2} / n), 0) AS low, least((rate + {_Z**2} / (2 * n) + {_Z} * sqrt(rate * (1 - rate) / n + {_Z**2} / (4 * n * n))) / (1 + {_Z**2} / n), 1) AS high FROM (SELECT round(conf, 6) AS score, CAST(count(*) AS DOUBLE) AS n, sum(label) AS positives, avg(label) AS rate FROM sample GROUP BY 1)", "sample"))
def _(spark, d):
    return c.discrete_scores(fx.sample(spark, d))


@query("roelofs_sweep", "bins:i",
       sql("SELECT coalesce(min(m), 31) - 1 AS bins FROM (SELECT m, a, lag(a) OVER (PARTITION BY m ORDER BY bin) AS was FROM (SELECT m, floor(before * m / total) AS bin, sum(y) / sum(n) AS a FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY conf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM (SELECT conf, count(*) AS n, sum(label) AS y FROM sample GROUP BY conf)) CROSS JOIN range(2, 31) r(m) GROUP BY ALL)) WHERE a < was", "sample"))
def _(spark, d):
    return c.monotone_bins(fx.sample(spark, d), 30)


_ATOM = "SELECT conf, count(*) AS n, sum(1 - label) AS loss FROM sample GROUP BY conf"


@query("risk_coverage", "threshold:d coverage:d risk:d generalized_risk:d",
       sql("SELECT conf AS threshold, covered / total AS coverage, lost / covered AS risk, lost / total AS generalized_risk FROM (SELECT conf, CAST(sum(n) OVER w AS DOUBLE) AS covered, CAST(sum(loss) OVER w AS DOUBLE) AS lost, sum(n) OVER () AS total FROM atom WINDOW w AS (ORDER BY conf DESC))", "sample", atom=_ATOM))
def _(spark, d):
    return c.risk_coverage(fx.sample(spark, d))


@query("aurc_augrc", "aurc:d augrc:d",
       sql("SELECT avg(cum / k) AS aurc, avg(cum / n) AS augrc FROM (SELECT row_number() OVER w AS k, sum(l) OVER w AS cum, count(*) OVER () AS n FROM (SELECT conf, avg(1 - label) OVER (PARTITION BY conf) AS l, row_number() OVER (ORDER BY conf DESC) AS i FROM sample) WINDOW w AS (ORDER BY i))", "sample"))
def _(spark, d):
    return c.aurc(fx.sample(spark, d))


@query("auc_mann_whitney", "auc:d n_pos:i n_neg:i",
       sql("SELECT (sum(CASE WHEN label = 1 THEN rank END) - count_if(label = 1) * (count_if(label = 1) + 1) / 2.0) / (CAST(count_if(label = 1) AS DOUBLE) * count_if(label = 0)) AS auc, count_if(label = 1) AS n_pos, count_if(label = 0) AS n_neg FROM (SELECT label, avg(i) OVER (PARTITION BY conf) AS rank FROM (SELECT *, row_number() OVER (ORDER BY conf) AS i FROM sample))", "sample"))
def _(spark, d):
    return c.auc(fx.sample(spark, d).withColumnRenamed("conf", "score"))


@query("score_histogram", "label:i bin:i n:i", sql("SELECT label, least(floor(conf * 20), 19) AS bin, count(*) AS n FROM sample GROUP BY ALL", "sample"))
def _(spark, d):
    return fx.sample(spark, d).groupBy("label", c.width_bin(F.col("conf"), 20).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("f1_by_threshold", "threshold:d precision:d recall:d f1:d",
       sql(f"SELECT conf AS threshold, {div('tp', 'k')} AS precision, {div('tp', 'y')} AS recall, {div('2 * tp', '(k + y)')} AS f1 FROM (SELECT conf, sum(n) OVER w AS k, sum(n - loss) OVER w AS tp, sum(n - loss) OVER () AS y FROM atom WINDOW w AS (ORDER BY conf DESC))", "sample", atom=_ATOM))
def _(spark, d):
    from pyspark.sql.window import Window

    from grovemark.operators.quality import ratio

    atoms = fx.sample(spark, d).groupBy("conf").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
    down = Window.orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, 0)
    run = atoms.select("conf", F.sum("n").over(down).alias("k"), F.sum("p").over(down).alias("tp"), F.sum("p").over(Window.partitionBy()).alias("y"))
    return run.select(F.col("conf").alias("threshold"), ratio(F.col("tp"), F.col("k")).alias("precision"), ratio(F.col("tp"), F.col("y")).alias("recall"), ratio(2 * F.col("tp"), F.col("k") + F.col("y")).alias("f1"))
