"""Queries on flat quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovemark.operators import quality as q
from grovemark.plans import fixtures as fx
from grovemark.plans.fixtures import div, prf_sql, sql
from grovemark.plans.registry import query

_P = prf_sql()
_PRF = ", ".join(f"{v} AS {k}" for k, v in _P.items())
_S = "sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn"


@query("flat_quality_micro", "tp:i fp:i fn:i precision:d recall:d f1:d", sql(f"SELECT *, {_PRF} FROM (SELECT {_S} FROM units)", "units"))
def _(spark, d):
    return q.micro(fx.gold(spark, d), fx.pred(spark, d))


@query("flat_units", "report:i tp:i fp:i fn:i", sql("SELECT * FROM units", "units"))
def _(spark, d):
    return q.flat_units(fx.gold(spark, d), fx.pred(spark, d))


_ALL = "SELECT r.report, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM reports r LEFT JOIN units u ON r.report = u.report"
_EACH = "SELECT report, " + ", ".join(f"CASE WHEN tp + fp + fn = 0 THEN 1 ELSE {v} END AS {k}" for k, v in _P.items()) + f" FROM ({_ALL})"


@query("flat_quality_by_report", "report:i precision:d recall:d f1:d", sql(_EACH, "units", "reports"))
def _(spark, d):
    return q.report_prf(q.with_reports(q.flat_units(fx.gold(spark, d), fx.pred(spark, d)), fx.reports(spark, d)))


_MACRO = "SELECT *, " + div("2 * macro_precision * macro_recall", "(macro_precision + macro_recall)") + " AS macro_f1_of_means FROM (SELECT avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1, count(*) AS n_units FROM ({}))"
_MC = "macro_precision:d macro_recall:d macro_f1:d n_units:i macro_f1_of_means:d"


@query("flat_quality_macro_report", _MC, sql(_MACRO.format(_EACH), "units", "reports"))
def _(spark, d):
    return q.macro(q.report_prf(q.with_reports(q.flat_units(fx.gold(spark, d), fx.pred(spark, d)), fx.reports(spark, d))))


_TERM = f"SELECT *, {_PRF} FROM (SELECT term, sum(g * p) AS tp, sum((1 - g) * p) AS fp, sum(g * (1 - p)) AS fn FROM pairs GROUP BY term)"


@query("flat_quality_macro_term", _MC, sql(_MACRO.format(_TERM), "pairs"))
def _(spark, d):
    t = q.counted(q.aligned(fx.gold(spark, d), fx.pred(spark, d)), "term")
    return q.macro(t.select(*q.prf(F.col("tp"), F.col("fp"), F.col("fn"))))


@query("flat_quality_term_domains", "macro_precision:d n_predicted:i macro_recall:d n_gold:i macro_f1:d n_terms:i",
       sql(f"SELECT avg(CASE WHEN tp + fp > 0 THEN precision END) AS macro_precision, count_if(tp + fp > 0) AS n_predicted, avg(CASE WHEN tp + fn > 0 THEN recall END) AS macro_recall, count_if(tp + fn > 0) AS n_gold, avg(f1) AS macro_f1, count(*) AS n_terms FROM ({_TERM})", "pairs"))
def _(spark, d):
    return q.term_domains(fx.gold(spark, d), fx.pred(spark, d))


@query("empty_case_audit", "both_sides:i gold_only:i pred_only:i neither:i",
       sql(f"SELECT count_if(g AND p) AS both_sides, count_if(g AND NOT p) AS gold_only, count_if(NOT g AND p) AS pred_only, count_if(NOT g AND NOT p) AS neither FROM (SELECT tp + fn > 0 AS g, tp + fp > 0 AS p FROM ({_ALL}))", "units", "reports"))
def _(spark, d):
    return q.empty_cases(q.with_reports(q.flat_units(fx.gold(spark, d), fx.pred(spark, d)), fx.reports(spark, d)))


_LEGACY = "SELECT report, CASE WHEN tp + fp + fn = 0 THEN 1 ELSE " + _P["precision"] + " END AS precision, CASE WHEN tp + fp + fn = 0 THEN 1 ELSE " + _P["recall"] + f" END AS recall FROM ({_ALL})"


@query("legacy_micro_macro", "micro_precision:d micro_recall:d micro_f1:d macro_precision:d macro_recall:d macro_f1:d",
       sql("SELECT a.*, b.*, " + div("2 * macro_precision * macro_recall", "(macro_precision + macro_recall)") + f" AS macro_f1 FROM (SELECT {', '.join(f'{v} AS micro_{k}' for k, v in _P.items())} FROM (SELECT {_S} FROM units)) a, (SELECT avg(precision) AS macro_precision, avg(recall) AS macro_recall FROM ({_LEGACY})) b", "units", "reports"))
def _(spark, d):
    units = q.flat_units(fx.gold(spark, d), fx.pred(spark, d)).persist()
    micro = units.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select(*[c.alias(f"micro_{n}") for c, n in zip(q.prf(F.col("tp"), F.col("fp"), F.col("fn")), ("precision", "recall", "f1"), strict=True)])
    macro = q.macro(q.report_prf(q.with_reports(units, fx.reports(spark, d)))).select("macro_precision", "macro_recall", F.col("macro_f1_of_means").alias("macro_f1"))
    return micro.crossJoin(macro)


_KIND = "CASE WHEN term LIKE 'P%' AND term IN (SELECT term FROM nodes) THEN 'scorable' WHEN term IN (SELECT term FROM nodes) THEN 'out_of_subtree' ELSE 'nonexistent' END"


def _scorable(spark, d):
    from grovemark.operators.graph import nodes

    known = nodes(fx.edges(spark, d))
    return known.where("term like 'P%'"), known


@query("normalise_pairs", "class:s kept:s n:i", sql(f"SELECT class, class <> 'out_of_subtree' AS kept, count(*) AS n FROM (SELECT {_KIND} AS class FROM pred_x) GROUP BY ALL", "nodes", "pred_x"))
def _(spark, d):
    return q.normalised(fx.pred_x(spark, d), *_scorable(spark, d), "pred").groupBy("class", "kept").agg(F.count(F.lit(1)).alias("n"))


_M = "SELECT {0} AS f1 FROM (SELECT sum(CASE WHEN g.term IS NOT NULL AND p.term IS NOT NULL THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN g.term IS NULL THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN p.term IS NULL THEN 1 ELSE 0 END) AS fn FROM gold g FULL JOIN {1} p ON g.report = p.report AND g.term = p.term)"


@query("policy_delta", "raw_f1:d normalised_f1:d delta:d",
       sql(f"SELECT a.f1 AS raw_f1, b.f1 AS normalised_f1, b.f1 - a.f1 AS delta FROM ({_M.format(_P['f1'], 'pred_x')}) a, ({_M.format(_P['f1'], 'kept')}) b", "nodes", "pred_x", "gold", kept=f"SELECT * FROM pred_x WHERE {_KIND} <> 'out_of_subtree'"))
def _(spark, d):
    g, p = fx.gold(spark, d), fx.pred_x(spark, d)
    raw, now = q.micro(g, p).select(F.col("f1").alias("raw_f1")), q.micro(g, q.normalised(p, *_scorable(spark, d), "pred").where("kept")).select(F.col("f1").alias("normalised_f1"))
    return raw.crossJoin(now).withColumn("delta", F.col("normalised_f1") - F.col("raw_f1"))


_AB = "SELECT coalesce(a.report, b.report) AS report, coalesce(a.term, b.term) AS term, CASE WHEN a.term IS NULL THEN 0 ELSE 1 END AS a, CASE WHEN b.term IS NULL THEN 0 ELSE 1 END AS b FROM pred a FULL JOIN pred_b b ON a.report = b.report AND a.term = b.term"


@query("error_diversity", "fp_jaccard:d pred_jaccard:d only_a:i only_b:i shared:i",
       sql(f"SELECT {div('sum(CASE WHEN y THEN a * b END)', 'sum(CASE WHEN y THEN 1 END)')} AS fp_jaccard, {div('sum(a * b)', 'count(*)')} AS pred_jaccard, sum(a * (1 - b)) AS only_a, sum(b * (1 - a)) AS only_b, sum(a * b) AS shared FROM (SELECT x.*, g.term IS NULL AS y FROM ab x LEFT JOIN gold g ON x.report = g.report AND x.term = g.term)", "pred", "pred_b", "gold", ab=_AB))
def _(spark, d):
    return q.diversity(fx.pred(spark, d), fx.pred_b(spark, d), fx.gold(spark, d))


@query("complementarity", "n_gold:i by_method:i by_baseline:i gained:i lost:i missed_by_both:i",
       sql("SELECT count(*) AS n_gold, count_if(a) AS by_method, count_if(b) AS by_baseline, count_if(a AND NOT b) AS gained, count_if(b AND NOT a) AS lost, count_if(NOT a AND NOT b) AS missed_by_both FROM (SELECT p.term IS NOT NULL AS a, b.term IS NOT NULL AS b FROM gold g LEFT JOIN pred p ON g.report = p.report AND g.term = p.term LEFT JOIN pred_b b ON g.report = b.report AND g.term = b.term)", "gold", "pred", "pred_b"))
def _(spark, d):
    return q.marginal_yield(fx.pred(spark, d), fx.gold(spark, d), fx.pred_b(spark, d))
