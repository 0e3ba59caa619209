"""Queries on spans, on what matched annotations agree on, and on ranked retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovemark.operators import curves as cv
from grovemark.operators import graph as g
from grovemark.operators import spans as sp
from grovemark.plans import fixtures as fx
from grovemark.plans.fixtures import div, sql
from grovemark.plans.registry import query

_AT = "(l_partkey * 7) % 100"
_ID = "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey"
_GS = f"SELECT l_orderkey % 500 AS report, {_ID} AS id, {_AT} AS start_, {_AT} + 3 + l_linenumber * 2 AS end_ FROM lineitem WHERE l_returnflag = 'R'"
_PS = f"SELECT l_orderkey % 500 AS report, {_ID} AS id, {_AT} + l_suppkey % 4 * (l_linenumber % 2) AS start_, {_AT} + l_suppkey % 4 * (l_linenumber % 2) + 3 + l_linenumber * 2 AS end_ FROM lineitem WHERE l_quantity >= 25"


def _spans(spark, d):
    li, at, n = fx.table(spark, d, "lineitem"), (F.col("l_partkey") * 7) % 100, F.col("l_linenumber")
    row = lambda start, rows: rows.select((F.col("l_orderkey") % 500).alias("report"), (((F.col("l_orderkey") * 10 + n) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("id"), start.alias("start"), (start + 3 + n * 2).alias("end"))
    return row(at, li.where("l_returnflag = 'R'")), row(at + F.col("l_suppkey") % 4 * (n % 2), li.where("l_quantity >= 25"))


_JAC = "greatest(0, least(g.end_, p.end_) - greatest(g.start_, p.start_)) / CAST(greatest(g.end_, p.end_) - least(g.start_, p.start_) AS DOUBLE)"
_PAIRS = "SELECT g.report, g.g, p.id AS p, " + _JAC + " AS jac, row_number() OVER (PARTITION BY g.report, g.g ORDER BY " + _JAC + " DESC, p.start_, p.end_, p.id) AS o FROM gn g JOIN ps p ON p.report = g.report AND {0}"
_GN = "SELECT *, row_number() OVER (PARTITION BY report ORDER BY start_, end_, id) AS g FROM gs"
_OVER, _SAME = "g.start_ < p.end_ AND p.start_ < g.end_", "g.start_ = p.start_ AND g.end_ = p.end_"
# One gold span a step in every report: its best pair whose predicted span is not yet taken.
_STEP = "SELECT report, 0 AS g, [CAST(0 AS BIGINT)] AS used, CAST(NULL AS DOUBLE) AS jac FROM gs GROUP BY report UNION ALL SELECT r.report, r.g + 1, list_append(r.used, coalesce((SELECT arg_min(c.p, c.o) FROM pairs c WHERE c.report = r.report AND c.g = r.g + 1 AND NOT list_contains(r.used, c.p)), 0)), (SELECT arg_min(c.jac, c.o) FROM pairs c WHERE c.report = r.report AND c.g = r.g + 1 AND NOT list_contains(r.used, c.p)) FROM steps r JOIN gn ON gn.report = r.report AND gn.g = r.g + 1"
_SPRF = f"SELECT tp, np - tp AS fp, ng - tp AS fn, {div('tp', 'np')} AS precision, {div('tp', 'ng')} AS recall, {div('2 * tp', '(np + ng)')} AS f1, mean_jaccard FROM (SELECT count(jac) AS tp, coalesce(avg(jac), 0) AS mean_jaccard FROM steps), (SELECT count(*) AS ng FROM gs), (SELECT count(*) AS np FROM ps)"
_SC = "tp:i fp:i fn:i precision:d recall:d f1:d mean_jaccard:d"


@query("span_prf_overlap", _SC, sql(_SPRF, gs=_GS, ps=_PS, gn=_GN, pairs=_PAIRS.format(_OVER), steps=_STEP))
def _(spark, d):
    gold, pred = _spans(spark, d)
    return sp.span_prf(gold, pred, sp.match(gold, pred))


@query("span_prf_exact", _SC, sql(_SPRF, gs=_GS, ps=_PS, gn=_GN, pairs=_PAIRS.format(_SAME), steps=_STEP))
def _(spark, d):
    gold, pred = _spans(spark, d)
    return sp.span_prf(gold, pred, sp.match(gold, pred, "exact"))


@query("span_pairs", "report:i n_pairs:i best:d total:d", sql("SELECT report, count(*) AS n_pairs, max(jac) AS best, sum(jac) AS total FROM pairs GROUP BY report", gs=_GS, ps=_PS, gn=_GN, pairs=_PAIRS.format(_OVER)))
def _(spark, d):
    """All overlapping pairs by report and how much they overlap."""
    gold, pred = _spans(spark, d)
    return sp.candidates(gold, pred).groupBy("report").agg(F.count(F.lit(1)).alias("n_pairs"), F.max("jaccard").alias("best"), F.sum("jaccard").alias("total"))


_TY = ("FINDING", "NEGATED_FINDING", "RESOLVED_FINDING", "DISEASE_PRESENT", "DISEASE_FAMILY")
_TP = "SELECT ['" + "', '".join(_TY) + "'][l_partkey % 5 + 1] AS gold, ['" + "', '".join(_TY) + "'][CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey % 5 ELSE l_partkey % 5 END + 1] AS pred, l_quantity >= 25 AS term_correct FROM lineitem"


def _types(spark, d):
    name = lambda c: F.element_at(F.array(*map(F.lit, _TY)), (c + 1).cast("int"))
    p, s = F.col("l_partkey") % 5, F.col("l_suppkey")
    return fx.table(spark, d, "lineitem").select(name(p).alias("gold"), name(F.when(s % 3 == 0, s % 5).otherwise(p)).alias("pred"), (F.col("l_quantity") >= 25).alias("term_correct"))


@query("type_confusion", "gold:s pred:s n:i", sql("SELECT gold, pred, count(*) AS n FROM tp GROUP BY ALL", tp=_TP))
def _(spark, d):
    return sp.type_confusion(_types(spark, d))


@query("type_summary", "n:i accuracy:d negated_as_resolved:i resolved_as_negated:i finding_as_disease:i disease_as_finding:i",
       sql("SELECT count(*) AS n, avg(CASE WHEN gold = pred THEN 1.0 ELSE 0 END) AS accuracy, count_if(gold = 'NEGATED_FINDING' AND pred = 'RESOLVED_FINDING') AS negated_as_resolved, count_if(gold = 'RESOLVED_FINDING' AND pred = 'NEGATED_FINDING') AS resolved_as_negated, count_if(ends_with(gold, '_FINDING') AND starts_with(pred, 'DISEASE_')) AS finding_as_disease, count_if(starts_with(gold, 'DISEASE_') AND ends_with(pred, '_FINDING')) AS disease_as_finding FROM tp", tp=_TP))
def _(spark, d):
    return sp.type_summary(_types(spark, d))


@query("polarity_accuracy", "status:s n:i correct:i accuracy:d", sql("SELECT gold AS status, count(*) AS n, count_if(gold = pred) AS correct, avg(CASE WHEN gold = pred THEN 1.0 ELSE 0 END) AS accuracy FROM tp WHERE term_correct GROUP BY 1", tp=_TP))
def _(spark, d):
    return sp.polarity(_types(spark, d))


_SPP = "SELECT CASE l_linenumber % 4 WHEN 0 THEN 'S' || l_suppkey ELSE 'P' || l_partkey END AS gold, CASE l_linenumber % 3 WHEN 0 THEN 'P' || l_partkey WHEN 1 THEN 'S' || l_suppkey ELSE 'R' || l_suppkey % 5 END AS pred FROM lineitem"
_SPE = "SELECT x.*, CASE WHEN x.gold = x.pred THEN 0 WHEN EXISTS (SELECT 1 FROM closed c WHERE (c.descendant = x.gold AND c.ancestor = x.pred) OR (c.descendant = x.pred AND c.ancestor = x.gold)) THEN dp.depth - dg.depth END AS error FROM (SELECT gold, pred, count(*) AS n FROM spp GROUP BY ALL) x LEFT JOIN depth dg ON dg.term = x.gold LEFT JOIN depth dp ON dp.term = x.pred"


def _specific(spark, d):
    part, supp, n = fx.part("l_partkey"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), F.col("l_linenumber")
    pred = F.when(n % 3 == 0, part).when(n % 3 == 1, supp).otherwise(F.concat(F.lit("R"), (F.col("l_suppkey") % 5).cast("string")))
    pairs = fx.table(spark, d, "lineitem").select(F.when(n % 4 == 0, supp).otherwise(part).alias("gold"), pred.alias("pred"))
    closed = fx.closed(spark, d)
    return sp.specificity(pairs, closed, g.depths(fx.edges(spark, d), closed))


@query("specificity_error", "error:i n:i", sql("SELECT error, sum(n) AS n FROM spe GROUP BY error", "closed", "depth", spp=_SPP, spe=_SPE))
def _(spark, d):
    return _specific(spark, d).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("specificity_summary", "n:i n_on_path:i n_off_path:i n_exact:i n_over:i n_under:i mean_over:d mean_under:d",
       sql("SELECT sum(n) AS n, sum(n) FILTER (error IS NOT NULL) AS n_on_path, sum(n) FILTER (error IS NULL) AS n_off_path, sum(n) FILTER (error = 0) AS n_exact, coalesce(sum(n) FILTER (error > 0), 0) AS n_over, coalesce(sum(n) FILTER (error < 0), 0) AS n_under, coalesce(sum(n * error) FILTER (error > 0) / sum(n) FILTER (error > 0), 0) AS mean_over, coalesce(sum(n * error) FILTER (error < 0) / sum(n) FILTER (error < 0), 0) AS mean_under FROM spe", "closed", "depth", spp=_SPP, spe=_SPE))
def _(spark, d):
    return sp.specificity_summary(_specific(spark, d))


@query("escalation_quality", "n_escalated:i n_ambiguous:i precision:d recall:d meets_precision:s meets_recall:s",
       sql(f"SELECT na AS n_escalated, nb AS n_ambiguous, {div('ab', 'na')} AS precision, {div('ab', 'nb')} AS recall, {div('ab', 'na')} > 0.7 AS meets_precision, {div('ab', 'nb')} > 0.9 AS meets_recall FROM (SELECT count(a.term) AS na, count(b.term) AS nb, count_if(a.term = b.term) AS ab FROM (SELECT * FROM pred WHERE score < 0.8) a FULL JOIN pred_b b ON a.report = b.report AND a.term = b.term)", "pred", "pred_b"))
def _(spark, d):
    return sp.escalation(fx.pred(spark, d).where("score < 0.8"), fx.pred_b(spark, d), ["report", "term"])


@query("fabrication_rate", "n:i n_fabricated:i rate:d", sql("SELECT count(*) AS n, count_if(n.term IS NULL) AS n_fabricated, avg(CASE WHEN n.term IS NULL THEN 1.0 ELSE 0 END) AS rate FROM pred_x p LEFT JOIN nodes n ON n.term = p.term", "pred_x", "nodes"))
def _(spark, d):
    return sp.fabrication(fx.pred_x(spark, d), g.nodes(fx.edges(spark, d)))


_M = (1, 2, 3, 5)
_RK = "SELECT report, term, row_number() OVER (PARTITION BY report ORDER BY score DESC, term) AS rank FROM pred"
_TA = "SELECT r.report, m, count(DISTINCT g.term) FILTER (c.rank <= m) AS hits, coalesce(max(n.n), 0) AS n_gold FROM reports r CROSS JOIN (SELECT unnest([1, 2, 3, 5]) AS m) LEFT JOIN rk c ON c.report = r.report LEFT JOIN gold g ON g.report = c.report AND g.term = c.term LEFT JOIN (SELECT report, count(*) AS n FROM gold GROUP BY 1) n ON n.report = r.report GROUP BY ALL"


def _term_at(spark, d):
    place = F.row_number().over(Window.partitionBy("report").orderBy(F.desc("score"), "term"))
    return cv.term_pr_at(fx.pred(spark, d).withColumn("rank", place), fx.gold(spark, d), fx.reports(spark, d), _M)


@query("term_pr_at_m", "report:i m:i hits:i n_gold:i precision:d recall:d", sql("SELECT *, CAST(hits AS DOUBLE) / m AS precision, CAST(hits AS DOUBLE) / nullif(n_gold, 0) AS recall FROM ta", "pred", "gold", "reports", rk=_RK, ta=_TA))
def _(spark, d):
    return _term_at(spark, d)


@query("term_pr_curve", "m:i micro_precision:d micro_recall:d macro_precision:d macro_recall:d n_reports:i n_with_gold:i",
       sql("SELECT m, CAST(sum(hits) AS DOUBLE) / (count(*) * m) AS micro_precision, CAST(sum(hits) AS DOUBLE) / nullif(sum(n_gold), 0) AS micro_recall, avg(CAST(hits AS DOUBLE) / m) AS macro_precision, avg(CAST(hits AS DOUBLE) / nullif(n_gold, 0)) AS macro_recall, count(*) AS n_reports, count_if(n_gold > 0) AS n_with_gold FROM ta GROUP BY m", "pred", "gold", "reports", rk=_RK, ta=_TA))
def _(spark, d):
    return cv.term_pr_curve(_term_at(spark, d))


_CS = "SELECT g.report, avg(CASE WHEN p.term IS NULL THEN 0.0 ELSE 1 END) AS recall FROM gold g LEFT JOIN pred_b p ON p.report = g.report AND p.term = g.term GROUP BY g.report"


@query("candidate_set_recall", "report:i recall:d", sql(_CS, "gold", "pred_b"))
def _(spark, d):
    return cv.candidate_set_recall(fx.pred_b(spark, d), fx.gold(spark, d))


@query("combined_recall_bound", "retrieval:d reach:d bound:d",
       sql("SELECT retrieval, reach, retrieval * reach AS bound FROM (SELECT CAST(sum(hits) AS DOUBLE) / sum(n_gold) AS retrieval FROM ta WHERE m = 3), (SELECT avg(recall) AS reach FROM cs)", "gold", "pred", "pred_b", "reports", rk=_RK, ta=_TA, cs=_CS))
def _(spark, d):
    curve = cv.term_pr_curve(_term_at(spark, d)).where("m = 3").select(F.col("micro_recall").alias("recall"))
    return cv.combined_bound(curve, cv.candidate_set_recall(fx.pred_b(spark, d), fx.gold(spark, d)).agg(F.avg("recall").alias("recall")))


# Scored segments of queries: a query is a part of the report or a nation above it.
_SG = "SELECT l_orderkey % 200 AS report, ((l_linenumber * 1000000 + l_orderkey) * 100000 + l_partkey) * 10000 + l_suppkey AS idx, 'P' || l_partkey % 50 AS term, l_partkey % 6 AS hops, l_quantity / 50 AS score, l_returnflag = 'R' AS relevant FROM lineitem"
_SGR = "SELECT *, row_number() OVER (PARTITION BY report, term ORDER BY score DESC, idx) AS rank, CASE WHEN hops = 0 THEN '0 (annotated)' WHEN hops >= 4 THEN '4+' ELSE CAST(hops AS VARCHAR) END AS hop FROM sg"


def _segments(spark, d):
    li = fx.table(spark, d, "lineitem").select((F.col("l_orderkey") % 200).alias("report"), (((F.col("l_linenumber") * 1000000 + F.col("l_orderkey")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("idx"), F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string")).alias("term"), (F.col("l_partkey") % 6).alias("hops"), (F.col("l_quantity") / 50).alias("score"), (F.col("l_returnflag") == "R").alias("relevant"))
    return cv.ranked(li).withColumn("hop", cv.hop_bucket("hops", 4))


def _grouped(by: str) -> str:
    """By group: counts, reciprocal rank, best ranks, AUC by counting pairs, recall at 1, 3 and 5."""
    auc = f"SELECT {by}, sum(p * (b + q / 2.0)) / nullif(CAST(sum(p) * sum(q) AS DOUBLE), 0) AS auc FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT {by}, score, count_if(relevant) AS p, count_if(NOT relevant) AS q FROM sgr GROUP BY ALL)) GROUP BY {by}"
    ks = ", ".join(f"avg(CASE WHEN best <= {k} THEN 1.0 ELSE 0 END) AS recall_{k}" for k in (1, 3, 5))
    return f"SELECT x.*, n_relevant, auc FROM (SELECT {by}, count(*) AS n_pairs, avg(coalesce(1.0 / best, 0)) AS mrr, median(best) AS median_rank, avg(best) AS mean_rank, {ks} FROM (SELECT {by}, report, term, min(rank) FILTER (relevant) AS best FROM sgr GROUP BY ALL) GROUP BY {by}) x JOIN (SELECT {by}, count_if(relevant) AS n_relevant FROM sgr GROUP BY {by}) y ON y.{by} = x.{by} JOIN ({auc}) z ON z.{by} = x.{by}"


_GC = "n_pairs:i n_relevant:i mrr:d median_rank:d mean_rank:d auc:d recall_1:d recall_3:d recall_5:d"


@query("metrics_by_hop", "hop:s " + _GC, sql(_grouped("hop"), sg=_SG, sgr=_SGR))
def _(spark, d):
    return cv.by_group(_segments(spark, d), "hop", (1, 3, 5))


@query("per_term_retrieval", "term:s " + _GC + " mean_top1:d mean_relevant:d",
       sql("SELECT a.*, b.mean_top1, c.mean_relevant FROM (" + _grouped("term") + ") a JOIN (SELECT term, avg(t) AS mean_top1 FROM (SELECT report, term, max(score) AS t FROM sgr GROUP BY ALL) GROUP BY term) b ON b.term = a.term JOIN (SELECT term, avg(score) FILTER (relevant) AS mean_relevant FROM sgr GROUP BY term) c ON c.term = a.term", sg=_SG, sgr=_SGR))
def _(spark, d):
    s = _segments(spark, d)
    return cv.by_group(s, "term", (1, 3, 5)).join(cv.score_means(s, "term"), "term")


@query("overall_retrieval", _GC, sql("SELECT * FROM (" + _grouped("one") + ")", sg=_SG, s0=_SGR, sgr="SELECT *, 1 AS one FROM s0"))
def _(spark, d):
    return cv.by_group(_segments(spark, d).withColumn("one", F.lit(1)), "one", (1, 3, 5)).drop("one")


@query("segment_error_outcomes", "outcome:s n:i",
       sql("""SELECT CASE WHEN gold = 1 THEN CASE WHEN hits = 0 THEN 'retrieval_failure' WHEN yes = 0 THEN 'classification_failure' WHEN pred = 1 THEN 'true_positive' ELSE 'false_negative_other' END WHEN pred = 1 THEN 'false_positive' ELSE 'true_negative' END AS outcome, count(*) AS n
  FROM (SELECT report, term, count(rel) AS known, count_if(rel) AS hits, count_if(rel AND score >= 0.6) AS yes, max(CASE WHEN relevant THEN 1 ELSE 0 END) AS gold, max(CASE WHEN score >= 0.7 THEN 1 ELSE 0 END) AS pred FROM (SELECT *, CASE WHEN hops < 5 THEN relevant AND rank <= 3 END AS rel FROM sgr) GROUP BY ALL) WHERE gold = 0 OR known > 0 GROUP BY 1""", sg=_SG, sgr=_SGR))  # fmt: skip
def _(spark, d):
    s = _segments(spark, d)
    known = F.when(F.col("hops") < 5, F.col("relevant") & (F.col("rank") <= 3))
    calls = s.select("report", "term", known.alias("relevant"), (F.col("score") >= 0.6).alias("yes"))
    top = s.groupBy("report", "term").agg(F.max(F.col("relevant").cast("int")).alias("gold"), F.max((F.col("score") >= 0.7).cast("int")).alias("pred"))
    return cv.outcomes(calls, top)


@query("survivor_counts", "tau:d hop:s n:i", sql("SELECT tau, hop, count(*) AS n FROM sgr CROSS JOIN (SELECT CAST(unnest([0.2, 0.5, 0.8, 0.96]) AS DOUBLE) AS tau) WHERE score >= tau GROUP BY ALL", sg=_SG, sgr=_SGR))
def _(spark, d):
    return cv.survivors(_segments(spark, d), (0.2, 0.5, 0.8, 0.96), "hop")


@query("tau_grid", "k:i tau:d", sql("SELECT k, max(score) AS tau FROM (SELECT score, sum(n) OVER (ORDER BY score DESC) AS upto FROM (SELECT score, count(*) AS n FROM sg GROUP BY 1)) JOIN (SELECT k, k * (SELECT count(*) FROM (SELECT DISTINCT report, term FROM sg)) / 4 AS need FROM range(1, 5) x(k)) ON upto >= need GROUP BY k", sg=_SG))
def _(spark, d):
    """Thresholds that leave a quarter, a half, ... of one row a query."""
    s = _segments(spark, d)
    return cv.threshold_grid(s, s.select("report", "term").distinct().count() / 4, 4)


@query("operating_points", "hop:s p:d n:i mean_hit:d", sql("SELECT hop, p, count(*) AS n, avg(1 - power(1 - p, g)) AS mean_hit FROM (SELECT hop, report, term, count_if(relevant) AS g FROM sgr GROUP BY ALL) CROSS JOIN (SELECT CAST(unnest([0.1, 0.3, 0.6]) AS DOUBLE) AS p) GROUP BY ALL", sg=_SG, sgr=_SGR))
def _(spark, d):
    """The chance that a random gate of rate p keeps a relevant segment, on the mean over queries of a distance."""
    from grovemark.functions.scalars import at_least_one

    per = _segments(spark, d).groupBy("hop", "report", "term").agg(F.count_if("relevant").alias("g")).withColumn("p", F.explode(F.array(F.lit(0.1), F.lit(0.3), F.lit(0.6))))
    return per.groupBy("hop", "p").agg(F.count(F.lit(1)).alias("n"), F.avg(at_least_one(F.col("g"), F.col("p"))).alias("mean_hit"))
