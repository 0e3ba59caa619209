"""Queries on views of a run: fates of terms, gates, intervals over reports, staged inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovemark.operators import graph as g
from grovemark.operators import nested as ns
from grovemark.operators import resampling as rs
from grovemark.operators import views as vw
from grovemark.operators import votes as vt
from grovemark.operators.quality import flat_units, ratio
from grovemark.plans import fixtures as fx
from grovemark.plans.fixtures import div, sql
from grovemark.plans.graph_queries import _GR, scores
from grovemark.plans.more_queries import _POIS, _mixed
from grovemark.plans.nested_queries import gold as gold200
from grovemark.plans.registry import query
from grovemark.plans.span_queries import _SG, _SGR, _segments
from grovemark.plans.traversal_queries import _B, _NEED, _W, _blocked, _visits

_NT = "SELECT coalesce(v.report, gr.report) AS report, coalesce(v.term, gr.term) AS term, CASE WHEN v.term IS NULL THEN 'unreached' WHEN v.expanded THEN 'expanded' ELSE 'closed' END AS state, CASE WHEN gr.term IS NOT NULL THEN CASE WHEN v.accepted THEN 'tp' ELSE 'fn' END WHEN v.accepted THEN 'fp' ELSE 'tn' END AS outcome, v.term IS NULL AS lost FROM v FULL JOIN gr ON gr.report = v.report AND gr.term = v.term"


@query("node_table", "state:s outcome:s depth:i blocked:i n:i", sql("SELECT state, outcome, d.depth, CASE WHEN lost THEN bd.b END AS blocked, count(*) AS n FROM nt LEFT JOIN bd ON bd.report = nt.report AND bd.term = nt.term LEFT JOIN depth d ON d.term = nt.term GROUP BY ALL", *_NEED, **_B, nt=_NT))
def _(spark, d):
    """Every visited term and all unreached gold by state, outcome, depth and where the way to it was cut."""
    v = _visits(spark, d)
    t = vw.node_table(v.join(scores(spark, d), ["report", "term"], "left"), gold200(spark, d), _blocked(spark, d, v), g.depths(fx.edges(spark, d), fx.closed(spark, d)))
    return t.groupBy("state", "outcome", "depth", "blocked").agg(F.count(F.lit(1)).alias("n"))


@query("run_gates", "gate:s n:i n_bad:i ok:s", sql("SELECT 'scores in range' AS gate, count(*) AS n, count_if(score < 0 OR score > 1) AS n_bad, count_if(score < 0 OR score > 1) = 0 AS ok FROM pred UNION ALL SELECT 'terms known', count(*), count_if(n.term IS NULL), count_if(n.term IS NULL) = 0 FROM pred_x x LEFT JOIN nodes n ON n.term = x.term UNION ALL SELECT 'counts fall with k', 8, 0, true", "pred", "pred_x", "nodes"))
def _(spark, d):
    """Gates of a run's tables: scores, ids, and that more votes never give more predictions."""
    known = g.nodes(fx.edges(spark, d)).withColumn("known", F.lit(True))
    counts = vt.max_counts(vt.packed(fx.detections(spark, d), "report"))
    per = spark.range(1, 9).select(F.col("id").alias("k")).join(counts, F.col("votes") >= F.col("k"), "left").groupBy("k").agg(F.count("votes").alias("n")).withColumn("one", F.lit(1))
    falls = per.withColumn("ok", vw.monotone(per, ("one",), "k", "n"))
    return vw.gates({"scores in range": (fx.pred(spark, d), F.col("score").between(0, 1)), "terms known": (fx.pred_x(spark, d).join(known, "term", "left"), F.col("known")), "counts fall with k": (falls, F.col("ok"))})


@query("materialised_candidates", "id:i term:s label:s parents:s n_ancestors:i", sql("SELECT p.report AS id, p.term, x.p_name AS label, coalesce((SELECT string_agg(parent, ';' ORDER BY parent) FROM edges WHERE child = p.term)) AS parents, (SELECT count(*) FROM closed WHERE descendant = p.term AND hops > 0) AS n_ancestors FROM pred p LEFT JOIN part x ON 'P' || x.p_partkey = p.term", "pred", "edges", "closed"))
def _(spark, d):
    labels = fx.table(spark, d, "part").select(fx.part("p_partkey").alias("term"), F.col("p_name").alias("label"))
    c = fx.pred(spark, d).select(F.col("report").alias("id"), "term", "score")
    return vw.materialised(c, labels, fx.edges(spark, d), fx.closed(spark, d)).select("id", "term", "label", "parents", "n_ancestors")


@query("abbreviations", "short:s long:s term:s", r"SELECT DISTINCT trim(short) AS short, trim(long) AS long, k.term FROM (SELECT CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE left(p_type, 2) || p_partkey END AS short, ' ' || p_type || '  ' || p_name AS long FROM part) a LEFT JOIN (SELECT lower(p_type || ' ' || p_name) AS key, min('P' || p_partkey) AS term FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) k ON k.key = lower(trim(regexp_replace(long, '\s+', ' ', 'g'))) WHERE trim(short) <> ''")
def _(spark, d):
    """A table of short forms with the terms that their long forms stand for."""
    from grovemark.operators.text import surface_key

    p = fx.table(spark, d, "part")
    table = p.select(F.when(F.col("p_partkey") % 9 == 0, " ").otherwise(F.concat(F.substring("p_type", 1, 2), F.col("p_partkey").cast("string"))).alias("short"), F.concat(F.lit(" "), "p_type", F.lit("  "), "p_name").alias("long"))
    syn = p.where("p_partkey % 2 = 0").select(surface_key(F.concat_ws(" ", "p_type", "p_name")).alias("key"), fx.part("p_partkey").alias("term"))
    return vw.abbreviations(table, syn).distinct()


def _weights(units: str, draws: int, keep: str) -> dict[str, str]:
    """SQL of the same Poisson weights over units(report, ...)."""
    own = _mixed("h", f"(SELECT *, CAST(report AS BIGINT) & {rs.LOW} AS h FROM {units})", keep)
    hs = _mixed("h", f"(SELECT {keep}, draw, (h + draw * {rs.SPREAD}) & {rs.LOW} AS h FROM own CROSS JOIN range({draws}) r(draw))", f"{keep}, draw")
    return {"own": own, "hs": hs, "ws": f"SELECT {keep}, draw, {_POIS} AS w FROM hs"}


_HE = "SELECT report, s, sum(hit) AS num, count(*) AS den FROM (SELECT report, term, s, max(CASE WHEN relevant AND rank <= s THEN 1 ELSE 0 END) AS hit FROM sgr CROSS JOIN (SELECT unnest([1, 3]) AS s) GROUP BY ALL) GROUP BY ALL"
_HI = _weights("he", 10_000, "s, num, den")


@query("retrieval_sufficiency", "s:i point:d low:d high:d", sql("SELECT a.s, point, low, high FROM (SELECT s, CAST(sum(num) AS DOUBLE) / sum(den) AS point FROM he GROUP BY s) a JOIN (SELECT s, quantile_cont(r, 0.025) AS low, quantile_cont(r, 0.975) AS high FROM (SELECT s, draw, coalesce(CAST(sum(num * w) AS DOUBLE) / nullif(sum(den * w), 0), 0) AS r FROM ws GROUP BY ALL) GROUP BY s) b ON b.s = a.s", sg=_SG, sgr=_SGR, he=_HE, **_HI))
def _(spark, d):
    """The rate at which a query's best s segments hold a relevant one, with intervals over 10,000 resamples of reports."""
    hit = (F.col("relevant") & (F.col("rank") <= F.col("s"))).cast("int")
    per = _segments(spark, d).withColumn("s", F.explode(F.array(F.lit(1), F.lit(3)))).groupBy("report", "term", "s").agg(F.max(hit).alias("hit"))
    units = per.groupBy("report", "s").agg(F.sum("hit").alias("num"), F.count(F.lit(1)).alias("den"))
    return vw.ratio_intervals(units, 10_000, "s")


def _units_sql(where: str) -> str:
    p = f"SELECT DISTINCT l_orderkey % 200 AS report, 'P' || l_partkey AS term FROM lineitem WHERE {where}"
    return f"SELECT report, count_if(a AND b) AS tp, count_if(a AND b) * 2 + count_if(a <> b) AS den FROM (SELECT coalesce(x.report, y.report) AS report, x.term IS NOT NULL AS a, y.term IS NOT NULL AS b FROM gr x FULL JOIN ({p}) y ON x.report = y.report AND x.term = y.term) GROUP BY report"


_PU = "SELECT a.report, a.tp AS ta, a.den AS da, b.tp AS tb, b.den AS db FROM ua a JOIN ub b ON b.report = a.report"


@query("paired_delta", "delta:d low:d high:d p:d", sql(f"SELECT delta, low, high, least(1.0, 2 * least(down, up)) AS p FROM (SELECT {div('2 * sum(ta)', 'sum(da)')} - {div('2 * sum(tb)', 'sum(db)')} AS delta FROM pu), (SELECT quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high, avg(CASE WHEN x <= 0 THEN 1.0 ELSE 0 END) AS down, avg(CASE WHEN x >= 0 THEN 1.0 ELSE 0 END) AS up FROM (SELECT draw, {div('2 * sum(ta * w)', 'sum(da * w)')} - {div('2 * sum(tb * w)', 'sum(db * w)')} AS x FROM ws GROUP BY draw))", gr=_GR, ua=_units_sql("l_quantity >= 25"), ub=_units_sql("l_discount >= 0.05"), pu=_PU, **_weights("pu", 10_000, "ta, da, tb, db")))
def _(spark, d):
    """The difference of two systems' micro F1 with its interval over 10,000 resamples of the same 200 reports."""
    li, y = fx.table(spark, d, "lineitem"), gold200(spark, d)
    own = lambda where: flat_units(y, li.where(where).select((F.col("l_orderkey") % 200).alias("report"), fx.part("l_partkey").alias("term")).distinct())
    return ns.paired_interval(own("l_quantity >= 25"), own("l_discount >= 0.05"))


_SH = "SELECT report, term FROM v WHERE NOT expanded AND term NOT LIKE 'P%'"
_CW = "SELECT gr.report, gr.term, arg_min(c.ancestor, (d.depth, c.ancestor)) AS cut FROM gr JOIN closed c ON c.descendant = gr.term JOIN sh ON sh.report = gr.report AND sh.term = c.ancestor JOIN depth d ON d.term = c.ancestor GROUP BY ALL"


@query("prune_audit", "cut:s n_gold:i n_reports:i n_below:i", sql("SELECT cut, count(*) AS n_gold, count(DISTINCT report) AS n_reports, (SELECT count(*) FROM closed WHERE ancestor = cut AND hops > 0) AS n_below FROM cw GROUP BY cut", *_NEED, **_W, sh=_SH, cw=_CW))
def _(spark, d):
    """The gold that each shut term cost, and how much below it was never asked."""
    shut = _visits(spark, d).where("not expanded and term not like 'P%'").select("report", "term")
    closed = fx.closed(spark, d)
    return vw.cut_savings(gold200(spark, d), closed, shut, g.depths(fx.edges(spark, d), closed))


@query("depth_visits", "depth:i n:i calls:d", sql("SELECT depth, count(*) AS n, sum(c) AS calls FROM (SELECT v.report, d.depth, (v.report % 7 + d.depth * 2) / CAST(count(*) OVER (PARTITION BY v.report, d.depth) AS DOUBLE) AS c FROM v JOIN depth d ON d.term = v.term) GROUP BY depth", *_NEED, **_W))
def _(spark, d):
    """Calls of a depth spread over the terms that were visited there."""
    closed = fx.closed(spark, d)
    nodes = _visits(spark, d).join(g.depths(fx.edges(spark, d), closed), "term").select("report", "term", "depth")
    totals = nodes.select("report", "depth").distinct().withColumn("calls", F.col("report") % 7 + F.col("depth") * 2)
    return vw.spread_calls(nodes, totals).groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.sum("calls").alias("calls"))


@query("pair_bests", "report:i term:s best_rank:i best_score:d n_relevant:i n:i", sql("SELECT report, term, min(rank) FILTER (relevant) AS best_rank, max(score) FILTER (relevant) AS best_score, count_if(relevant) AS n_relevant, count(*) AS n FROM sgr GROUP BY ALL", sg=_SG, sgr=_SGR))
def _(spark, d):
    return vw.pair_bests(_segments(spark, d))


@query("staged_corpus", "id:s n:i digest:s", "SELECT 'd' || p_partkey AS id, length(b) AS n, md5(b) AS digest FROM (SELECT p_partkey, 'd' || p_partkey || chr(10) || p_name || '   ' || p_type || chr(10) AS b FROM part)")
def _(spark, d):
    """Ids and texts on a line each, line ends in texts made blanks of the same number."""
    t = fx.table(spark, d, "part").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("id"), F.concat("p_name", F.lit("\r\n\n"), "p_type").alias("text"))
    return vw.stage_lines(t).select("id", F.length("block").alias("n"), F.md5("block").alias("digest"))


@query("stale_cache", "id:i side:s", "SELECT p_partkey AS id, 'cached' AS side FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 'staged' FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0")
def _(spark, d):
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return vw.stale(p.where("id % 5 = 0"), p.where("id % 3 = 0"))


@query("first_annotated", "report:i", sql("SELECT report FROM reports SEMI JOIN gold USING (report) ORDER BY report LIMIT 25", "reports", "gold"))
def _(spark, d):
    """A cohort of a stated size: the first 25 annotated reports."""
    return vw.first_annotated(fx.reports(spark, d), fx.gold(spark, d), 25)


@query("annotator_tallies", "system:s shared:i only_annotated:i only_system:i", sql(" UNION ALL ".join(f"SELECT '{n}' AS system, count_if(a AND b) AS shared, count_if(a AND NOT b) AS only_annotated, count_if(b AND NOT a) AS only_system FROM (SELECT g.term IS NOT NULL AS a, p.term IS NOT NULL AS b FROM gold g FULL JOIN {t} p ON p.report = g.report AND p.term = g.term)" for n, t in (("a", "pred"), ("b", "pred_b"))), "gold", "pred", "pred_b"))
def _(spark, d):
    return vw.tallies(fx.gold(spark, d), {"a": fx.pred(spark, d), "b": fx.pred_b(spark, d)})


@query("subgroup_intervals", "label:i point:d low:d high:d", sql("SELECT a.label, point, low, high FROM (SELECT label, CAST(sum(num) AS DOUBLE) / sum(den) AS point FROM su GROUP BY 1) a JOIN (SELECT label, quantile_cont(r, 0.025) AS low, quantile_cont(r, 0.975) AS high FROM (SELECT label, draw, coalesce(CAST(sum(num * w) AS DOUBLE) / nullif(sum(den * w), 0), 0) AS r FROM ws GROUP BY ALL) GROUP BY 1) b ON b.label = a.label", gr=_GR, su="SELECT l.report, l.label, count(DISTINCT CASE WHEN q THEN l.term END) AS num, count(DISTINCT l.term) AS den FROM (SELECT l_orderkey % 200 AS report, 'P' || l_partkey AS term, l_linenumber % 2 AS label, bool_or(l_quantity >= 25) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) l GROUP BY ALL", **_weights("su", 2_000, "label, num, den")))
def _(spark, d):
    """Recall of subgroups with intervals over 2,000 resamples of reports."""
    li = fx.table(spark, d, "lineitem").where("l_returnflag = 'R'")
    per = li.groupBy((F.col("l_orderkey") % 200).alias("report"), fx.part("l_partkey").alias("term"), (F.col("l_linenumber") % 2).alias("label")).agg(F.bool_or(F.col("l_quantity") >= 25).alias("q"))
    units = per.groupBy("report", "label").agg(F.count_if("q").alias("num"), F.count(F.lit(1)).alias("den"))
    return vw.ratio_intervals(units, 2_000, "label")


@query("hierarchy_row", "n_reports:i h_f1:d closure_gold:d closure_pred:d", sql(f"SELECT count(*) AS n_reports, {div('2 * sum(tp)', '(2 * sum(tp) + sum(fp) + sum(fn))')} AS h_f1, avg(CAST(tp + fn AS DOUBLE)) AS closure_gold, avg(CAST(tp + fp AS DOUBLE)) AS closure_pred FROM (SELECT report, count_if(a AND b) AS tp, count_if(b AND NOT a) AS fp, count_if(a AND NOT b) AS fn FROM (SELECT coalesce(x.report, y.report) AS report, x.term IS NOT NULL AS a, y.term IS NOT NULL AS b FROM (SELECT DISTINCT report, ancestor AS term FROM gold JOIN closed ON descendant = term) x FULL JOIN (SELECT DISTINCT report, ancestor AS term FROM pred JOIN closed ON descendant = term) y ON x.report = y.report AND x.term = y.term) GROUP BY report)", "gold", "pred", "closed"))
def _(spark, d):
    """Hierarchical F1 and the sizes of both closures."""
    u = g.h_counts(fx.gold(spark, d), fx.pred(spark, d), fx.closed(spark, d))
    s = lambda c: F.sum(c)
    return u.agg(F.count(F.lit(1)).alias("n_reports"), ratio(2 * s("tp"), 2 * s("tp") + s("fp") + s("fn")).alias("h_f1"), F.avg(F.col("tp") + F.col("fn")).alias("closure_gold"), F.avg(F.col("tp") + F.col("fp")).alias("closure_pred"))
