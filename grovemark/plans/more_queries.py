"""Queries on pooling, retrieval, text, resampling and the event log."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovemark.operators import curation, pooling, retrieval, text
from grovemark.operators import resampling as rs
from grovemark.operators.quality import flat_units, ratio
from grovemark.plans import fixtures as fx
from grovemark.plans.fixtures import div, sql
from grovemark.plans.registry import query
from grovemark.streaming import folds

_SIG = "CASE WHEN {0} >= 0 THEN 1 / (1 + exp(-{0})) ELSE exp({0}) / (1 + exp({0})) END"


@query("pooling_all", "report:i term:s n:i p0:i p1:d p2:d p3:d p4:d lse:d",
       sql(f"SELECT report, term, len(m) AS n, CASE WHEN p[1] > 0.5 THEN 1 ELSE 0 END AS p0, p[1] AS p1, coalesce(p[2], 0) AS p2, 1 - sqrt(list_product(list_transform(p, lambda x: 1 - x))) AS p3, list_avg(p) AS p4, {_SIG.format('(m[1] + ln(list_sum(list_transform(m, lambda x: exp(x - m[1])))))')} AS lse FROM (SELECT *, list_transform(m, lambda x: {_SIG.format('x')}) AS p FROM (SELECT report, term, list(margin ORDER BY margin DESC) AS m FROM calls WHERE rank <= 5 GROUP BY ALL))", "calls"))
def _(spark, d):
    return pooling.pooled(fx.calls(spark, d), 5)


_RK = "SELECT l_orderkey AS query, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS relevant FROM lineitem"


def _ranked(spark, d):
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber"))
    return fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), rank.alias("rank"), (F.col("l_returnflag") == "R").cast("int").alias("relevant"))


@query("mrr_recall_at_k", "mrr:d recall_at_1:d recall_at_3:d",
       sql("SELECT avg(coalesce(1.0::DOUBLE / r, 0)) AS mrr, avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END) AS recall_at_1, avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END) AS recall_at_3 FROM (SELECT query, min(CASE WHEN relevant = 1 THEN rank END) AS r FROM rk GROUP BY query)", rk=_RK))
def _(spark, d):
    return retrieval.mrr_recall(_ranked(spark, d), (1, 3))


@query("pr_at_s", "s:i precision:d recall:d",
       sql("SELECT s, avg(hits / s) AS precision, avg(hits / nullif(tot, 0)) AS recall FROM (SELECT s, query, CAST(sum(CASE WHEN rank <= s THEN relevant ELSE 0 END) AS DOUBLE) AS hits, CAST(sum(relevant) AS DOUBLE) AS tot FROM rk CROSS JOIN (SELECT unnest([1, 3, 5]) AS s) GROUP BY ALL) GROUP BY s", rk=_RK))
def _(spark, d):
    return retrieval.pr_at_s(_ranked(spark, d), (1, 3, 5))


@query("random_hit_closed_form", "query:i chance:d",
       sql("SELECT query, 1 - list_product(list_transform(range(3), lambda t: CAST(greatest(n - g - t, 0) AS DOUBLE) / greatest(n - t, 1))) AS chance FROM (SELECT query, count(*) AS n, sum(relevant) AS g FROM rk GROUP BY query)", rk=_RK))
def _(spark, d):
    n = _ranked(spark, d).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.sum("relevant").alias("g"))
    return n.select("query", retrieval.random_hit(F.col("n"), F.col("g"), 3).alias("chance"))


_REPLY = "lower(text)"
for _p in (r"<think>.*?</think>", r"<unused94>.*?</?unused95>", r"^.*?</think>", r"<think>.*$", r"<unused94>.*$"):
    _REPLY = f"regexp_replace({_REPLY}, '(?s){_p}', ' ', 'g')"
_BOXED = r"'\\boxed\{[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*(yes|no)?[^}]*\}'"


@query("parse_yes_no", "answer:s n:i",
       sql(rf"SELECT coalesce(upper(coalesce(nullif(regexp_extract(reply, {_BOXED}, 1), ''), regexp_extract_all(reply, '\b(yes|no)\b', 1)[-1])), 'AMBIGUOUS') AS answer, count(*) AS n FROM (SELECT {_REPLY} AS reply FROM documents) GROUP BY 1"))
def _(spark, d):
    return fx.table(spark, d, "documents").groupBy(text.answer(F.col("text")).alias("answer")).agg(F.count(F.lit(1)).alias("n"))


@query("segment_documents", "doc_id:i segment_idx:i segment:s")
def _(spark, d):
    return text.segments(fx.table(spark, d, "documents"), "doc_id", "text")


@query("event_fold_last", "key:i action:s event_id:i n:i", sql("SELECT user_id AS key, arg_max(event_type, event_id) AS action, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY user_id"))
def _(spark, d):
    return curation.last_event(fx.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("action"), "event_id"))


@query("events_windowed_counts", "start:s event_type:s n:i", sql("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL"))
def _(spark, d):
    return folds.windowed_counts(fx.table(spark, d, "events")).withColumn("start", F.unix_timestamp("start"))


@query("assign_slots", "event_id:i slot:i", sql("SELECT event_id, CASE WHEN n > 0 THEN n END AS slot FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS n FROM events)"))
def _(spark, d):
    return curation.slots(fx.table(spark, d, "events"), ("user_id", "event_type"), "event_id").select("event_id", "slot")


@query("adjudicate_best_source", "l_orderkey:i l_linenumber:i",
       sql("SELECT l_orderkey, l_linenumber FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 3) AS r FROM lineitem) WHERE r = 1"))
def _(spark, d):
    li = fx.table(spark, d, "lineitem").withColumn("source", F.col("l_suppkey") % 3)
    return curation.best_source(li, ("l_orderkey",), "source").select("l_orderkey", "l_linenumber")


@query("size_tertiles", "report:i tertile:i", sql("SELECT report, ntile(3) OVER (ORDER BY n, report) - 1 AS tertile FROM (SELECT report, count(*) AS n FROM gold GROUP BY report)", "gold"))
def _(spark, d):
    sizes = fx.gold(spark, d).groupBy("report").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("report", (F.ntile(3).over(Window.orderBy("n", "report")) - 1).alias("tertile"))


@query("holm_adjust", "term:s p:d adjusted:d rejected:s",
       sql("SELECT term, p, adjusted, adjusted <= 0.05 AS rejected FROM (SELECT term, p, least(max(p * (m - i + 1)) OVER (ORDER BY p, term ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS adjusted FROM (SELECT term, p, row_number() OVER (ORDER BY p, term) AS i, count(*) OVER () AS m FROM (SELECT term, 1 / (1.0 + count(*)) ** 3 AS p FROM gold GROUP BY term)))", "gold"))
def _(spark, d):
    """p-values of the terms, here a function of their counts, adjusted by Holm's step-down."""
    p = fx.gold(spark, d).groupBy("term").agg(F.pow(1 / (1.0 + F.count(F.lit(1))), F.lit(3.0)).alias("p"))
    order = Window.orderBy("p", "term")
    step = p.select("term", "p", (F.col("p") * (F.count(F.lit(1)).over(Window.partitionBy()) - F.row_number().over(order) + 1)).alias("x"))
    out = step.withColumn("adjusted", F.least(F.max("x").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)))
    return out.select("term", "p", "adjusted", (F.col("adjusted") <= 0.05).alias("rejected"))


@query("bootstrap_ci_hashdraw", "low:d high:d",
       sql(f"SELECT quantile_cont(f1, 0.025) AS low, quantile_cont(f1, 0.975) AS high FROM (SELECT draw, {div('2 * sum(tp * w)', 'sum((2 * tp + fp + fn) * w)')} AS f1 FROM (SELECT draw, tp, fp, fn, (report * 7919 + draw * 104729 + report * draw % 31) % 3 AS w FROM units CROSS JOIN range(200) r(draw)) GROUP BY draw)", "units"))
def _(spark, d):
    """Percentile interval of micro-F1 over 200 reweightings of reports; weights come from arithmetic on the ids, so each
    engine draws the same, and only sufficient statistics are reweighted."""
    u = flat_units(fx.gold(spark, d), fx.pred(spark, d)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(199))))
    w = (F.col("report") * 7919 + F.col("draw") * 104729 + F.col("report") * F.col("draw") % 31) % 3
    f1 = u.groupBy("draw").agg(ratio(2 * F.sum(F.col("tp") * w), F.sum((2 * F.col("tp") + F.col("fp") + F.col("fn")) * w)).alias("f1"))
    return f1.agg(F.percentile("f1", F.lit(0.025)).alias("low"), F.percentile("f1", F.lit(0.975)).alias("high"))


def _mixed(c: str, rows: str, keep: str) -> str:
    for shift, by in ((16, rs.MIX[0]), (15, rs.MIX[1])):
        rows = f"(SELECT {keep}, (xor({c}, {c} >> {shift}) * {by}) & {rs.LOW} AS {c} FROM {rows})"
    return f"SELECT {keep}, xor({c}, {c} >> 16) AS {c} FROM {rows}"


_OWN = _mixed("h", f"(SELECT CAST(report AS BIGINT) & {rs.LOW} AS h, CAST(tp AS BIGINT) AS tp, CAST(2 * tp + fp + fn AS BIGINT) AS den FROM units)", "tp, den")
_HASH = _mixed("h", f"(SELECT tp, den, draw, (h + draw * {rs.SPREAD}) & {rs.LOW} AS h FROM own CROSS JOIN range(10000) r(draw))", "tp, den, draw")
_POIS = "CASE " + " ".join(f"WHEN h < {t} THEN {k}" for k, t in enumerate(rs.POISSON)) + f" ELSE {len(rs.POISSON)} END"


@query("bootstrap_ci_poisson", "low:d high:d",
       sql(f"SELECT quantile_cont(f1, 0.025) AS low, quantile_cont(f1, 0.975) AS high FROM (SELECT draw, {div('2 * sum(tp * w)', 'sum(den * w)')} AS f1 FROM (SELECT tp, den, draw, {_POIS} AS w FROM hs) GROUP BY draw)", "units", own=_OWN, hs=_HASH))
def _(spark, d):
    """Percentile interval of micro-F1 over the reference's 10,000 resamples of reports."""
    f1 = rs.poisson_draws(flat_units(fx.gold(spark, d), fx.pred(spark, d)))
    return f1.agg(F.percentile("f1", F.lit(0.025)).alias("low"), F.percentile("f1", F.lit(0.975)).alias("high"))
