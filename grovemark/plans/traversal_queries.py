"""Queries on pruned walks, their losses and costs, and on folds, randomisation and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovemark.operators import graph as g
from grovemark.operators import resampling as rs
from grovemark.operators import traversal as tr
from grovemark.operators.quality import aligned, flat_units
from grovemark.plans import fixtures as fx
from grovemark.plans.fixtures import div, sql
from grovemark.plans.graph_queries import _GR, _WIDE, scores
from grovemark.plans.registry import query
from grovemark.plans.scratch import settled


def _gold(spark, d):
    return fx.table(spark, d, "lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") % 200).alias("report"), fx.part("l_partkey").alias("term")).distinct()


def _visits(spark, d):
    """A walk at 0.3: terms on an open path; every inner term costs three calls, a leaf one."""
    sc = scores(spark, d)
    wide = g.bottleneck(fx.edges(spark, d), sc).where("r >= 0.3").join(sc, ["report", "term"], "left")
    s, leaf = F.coalesce("score", F.lit(0.0)), F.col("term").startswith("P")
    # Read several times by most queries.
    return settled(wide.select("report", "term", (~leaf & (s >= 0.3)).alias("expanded"), (s >= 0.5).alias("accepted"), F.when(leaf, 1).otherwise(3).alias("n_calls")))


_V = "SELECT w.report, w.term, w.term NOT LIKE 'P%' AND coalesce(score, 0) >= 0.3 AS expanded, coalesce(score, 0) >= 0.5 AS accepted, CASE WHEN w.term LIKE 'P%' THEN 1 ELSE 3 END AS n_calls FROM wide w LEFT JOIN sc s ON s.report = w.report AND s.term = w.term WHERE r >= 0.3"
_W = {**_WIDE, "v": _V, "gr": _GR}
_NEED = ("calls", "edges", "nodes", "closed", "depth")


def _cut(prev: str) -> str:
    return f"SELECT p.report, e.child AS term, CASE WHEN NOT bool_or(p.b IS NULL AND coalesce(v.expanded, false)) THEN max(coalesce(p.b, d.depth)) END AS b FROM {prev} p JOIN edges e ON e.parent = p.term JOIN depth d ON d.term = p.term LEFT JOIN v ON v.report = p.report AND v.term = p.term GROUP BY ALL"


_B = {**_W, "b1": "SELECT report, term, CAST(NULL AS BIGINT) AS b FROM r1", "b2": _cut("b1"), "b3": _cut("b2"), "b4": _cut("b3"), "bd": "SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3 UNION ALL SELECT * FROM b4"}


def _blocked(spark, d, visits):
    depth = g.depths(fx.edges(spark, d), fx.closed(spark, d))
    return tr.blocking_depths(fx.edges(spark, d), depth, visits.where("expanded"), spark.range(200).withColumnRenamed("id", "report"))


@query("blocking_depth", "blocked:i n:i", sql("SELECT b AS blocked, count(*) AS n FROM bd GROUP BY b", *_NEED, **_B))
def _(spark, d):
    return _blocked(spark, d, _visits(spark, d)).groupBy("blocked").agg(F.count(F.lit(1)).alias("n"))


@query("prune_ledger", "fate:s blocked:i n:i",
       sql("SELECT fate, CASE WHEN fate = 'blocked' THEN b END AS blocked, count(*) AS n FROM (SELECT CASE WHEN v.accepted THEN 'found' WHEN v.accepted IS NOT NULL THEN 'rejected' WHEN bd.term IS NULL THEN 'outside_graph' WHEN b IS NULL THEN 'unreached' ELSE 'blocked' END AS fate, b FROM gr LEFT JOIN v ON v.report = gr.report AND v.term = gr.term LEFT JOIN bd ON bd.report = gr.report AND bd.term = gr.term) GROUP BY ALL", *_NEED, **_B))
def _(spark, d):
    v = _visits(spark, d)
    return tr.prune_ledger(_gold(spark, d), v, _blocked(spark, d, v)).groupBy("fate", "blocked").agg(F.count(F.lit(1)).alias("n"))


@query("lost_at", "lost_at:s n:i",
       sql("SELECT CASE WHEN v.term IS NOT NULL THEN 'itself' ELSE (SELECT arg_min(c.ancestor, (-d.depth, c.ancestor)) FROM closed c JOIN v x ON x.report = m.report AND x.term = c.ancestor AND NOT x.expanded JOIN depth d ON d.term = c.ancestor WHERE c.descendant = m.term AND c.hops > 0) END AS lost_at, count(*) AS n FROM m LEFT JOIN v ON v.report = m.report AND v.term = m.term GROUP BY ALL", *_NEED, **_W, m="SELECT gr.* FROM gr ANTI JOIN (SELECT * FROM v WHERE accepted) y ON y.report = gr.report AND y.term = gr.term"))
def _(spark, d):
    v = _visits(spark, d)
    missed = _gold(spark, d).join(v.where("accepted"), ["report", "term"], "left_anti")
    out = tr.lost_at(missed, v, fx.closed(spark, d), g.depths(fx.edges(spark, d), fx.closed(spark, d)))
    return out.groupBy(F.when(F.col("lost_at") == F.col("term"), "itself").otherwise(F.col("lost_at")).alias("lost_at")).agg(F.count(F.lit(1)).alias("n"))


@query("depth_cost_table", "depth:i frontier:i n_expanded:i survival:d n_accepted:i n_calls:i cum_calls:i cum_frontier:i cum_recall:d",
       sql("SELECT depth, frontier, n_expanded, n_expanded / frontier AS survival, n_accepted, n_calls, sum(n_calls) OVER (ORDER BY depth) AS cum_calls, sum(frontier) OVER (ORDER BY depth) AS cum_frontier, sum(n_gold) OVER (ORDER BY depth) / (SELECT CAST(count(*) AS DOUBLE) FROM gr) AS cum_recall FROM (SELECT depth, CAST(count(*) AS DOUBLE) AS frontier, CAST(count_if(expanded) AS DOUBLE) AS n_expanded, count_if(accepted) AS n_accepted, sum(n_calls) AS n_calls, count(gr.term) AS n_gold FROM v JOIN depth d ON d.term = v.term LEFT JOIN gr ON gr.report = v.report AND gr.term = v.term GROUP BY depth)", *_NEED, **_W))
def _(spark, d):
    return tr.depth_cost(_visits(spark, d), g.depths(fx.edges(spark, d), fx.closed(spark, d)), _gold(spark, d))


@query("call_stats", "n_reports:i mean_calls:d median_calls:d max_calls:i mean_terms:d dedup_ratio:d calls_per_term:d",
       sql(f"SELECT count(*) AS n_reports, avg(c) AS mean_calls, median(c) AS median_calls, max(c) AS max_calls, avg(t) AS mean_terms, {div('(SELECT count(*) FROM v JOIN edges ON parent = term WHERE expanded)', 'sum(t)')} AS dedup_ratio, {div('sum(c)', 'sum(t)')} AS calls_per_term FROM (SELECT report, sum(n_calls) AS c, count(*) AS t FROM v GROUP BY report)", *_NEED, **_W))
def _(spark, d):
    return tr.call_stats(_visits(spark, d), fx.edges(spark, d))


@query("scaling_exponent", "exponent:d intercept:d r2:d sublinear:s",
       sql("SELECT regr_slope(y, x) AS exponent, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, regr_slope(y, x) < 1 - 1e-9 AS sublinear FROM (SELECT ln(count(DISTINCT l_partkey)) AS x, ln(count(*)) AS y FROM lineitem GROUP BY l_suppkey)"))
def _(spark, d):
    return tr.scaling(fx.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("n"), F.count(F.lit(1)).alias("calls")))


@query("fp_factory", "term:s n_fp:i n_reports:i",
       sql("SELECT parent AS term, count(*) AS n_fp, count(DISTINCT w.report) AS n_reports FROM w JOIN edges ON child = w.term JOIN v ON v.report = w.report AND v.term = parent AND expanded GROUP BY parent ORDER BY n_fp DESC, n_reports DESC, term LIMIT 50", *_NEED, **_W, w="SELECT v.report, v.term FROM v ANTI JOIN gr ON gr.report = v.report AND gr.term = v.term WHERE accepted"))
def _(spark, d):
    v = _visits(spark, d)
    wrong = v.where("accepted").select("report", "term").join(_gold(spark, d), ["report", "term"], "left_anti")
    return tr.false_positive_parents(wrong, v, fx.edges(spark, d))


@query("reachability_recall", "micro:d macro:d",
       sql("SELECT CAST(sum(h) AS DOUBLE) / sum(n) AS micro, avg(CAST(h AS DOUBLE) / n) AS macro FROM (SELECT gr.report, count(*) AS n, count(v.term) AS h FROM gr LEFT JOIN v ON v.report = gr.report AND v.term = gr.term GROUP BY 1)", *_NEED, **_W))
def _(spark, d):
    met = _gold(spark, d).join(_visits(spark, d).withColumn("h", F.lit(1)), ["report", "term"], "left")
    per = met.groupBy("report").agg(F.count(F.lit(1)).alias("n"), F.count("h").alias("h"))
    return per.agg((F.sum("h") / F.sum("n")).alias("micro"), F.avg(F.col("h") / F.col("n")).alias("macro"))


def _draw(key: str, seed: str) -> str:
    return f"((({key} % 1000003 + {seed} * 7919 + 11) * {rs.STEP} % {rs.PRIME}) * {rs.STEP} % {rs.PRIME})"


_TERT = "SELECT report, ntile(3) OVER (ORDER BY n, report) - 1 AS stratum FROM (SELECT report, count(*) AS n FROM gold GROUP BY report)"
_FOLD = f"SELECT report, stratum, (row_number() OVER (PARTITION BY stratum ORDER BY {_draw('report', '0')}, report) - 1 + (SELECT count(*) FROM ts y WHERE y.stratum < ts.stratum)) % 5 AS fold FROM ts"


def _strata(spark, d):
    sizes = fx.gold(spark, d).groupBy("report").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("report", (F.ntile(3).over(Window.orderBy("n", "report")) - 1).alias("stratum"))


@query("stratified_folds", "report:i stratum:i fold:i", sql("SELECT * FROM fd", "gold", ts=_TERT, fd=_FOLD))
def _(spark, d):
    return rs.stratified_folds(_strata(spark, d))


_UB = "SELECT coalesce(x.report, y.report) AS report, count_if(x.term IS NOT NULL AND y.term IS NOT NULL) AS tp, count_if(x.term IS NULL) AS fp, count_if(y.term IS NULL) AS fn FROM gold x FULL JOIN pred_b y ON x.report = y.report AND x.term = y.term GROUP BY 1"
_SIDE = "2 * sum(CASE WHEN s THEN {1}tp ELSE {0}tp END)", "(2 * sum(CASE WHEN s THEN {1}tp ELSE {0}tp END) + sum(CASE WHEN s THEN {1}fp + {1}fn ELSE {0}fp + {0}fn END))"
_F1 = lambda x, y: div(_SIDE[0].format(x, y), _SIDE[1].format(x, y))
_PER = f"SELECT draw, {_F1('a', 'b')} - {_F1('b', 'a')} AS d FROM (SELECT *, draw > 0 AND {_draw('report', 'draw')} % 2 = 1 AS s FROM (SELECT coalesce(u.report, w.report) AS report, coalesce(u.tp, 0) AS atp, coalesce(u.fp, 0) AS afp, coalesce(u.fn, 0) AS afn, coalesce(w.tp, 0) AS btp, coalesce(w.fp, 0) AS bfp, coalesce(w.fn, 0) AS bfn FROM units u FULL JOIN ub w ON u.report = w.report) CROSS JOIN range(201) r(draw)) GROUP BY draw"


@query("paired_permutation_hashdraw", "observed:d p:d", sql("SELECT max(o) AS observed, (1 + count_if(draw > 0 AND abs(d) >= abs(o) - 1e-12)) / 201.0 AS p FROM pd CROSS JOIN (SELECT d AS o FROM pd WHERE draw = 0)", "units", "pred_b", ub=_UB, pd=_PER))
def _(spark, d):
    gold = fx.gold(spark, d)
    return rs.paired_randomisation(flat_units(gold, fx.pred(spark, d)), flat_units(gold, fx.pred_b(spark, d)))


GRID = [0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


def _scored(spark, d):
    """report, term, score, y, cohort: predictions with scores, and gold; reports of two halves."""
    pairs = aligned(fx.gold(spark, d), fx.pred(spark, d)).join(fx.pred(spark, d), ["report", "term"], "left")
    return pairs.select("report", "term", "score", (F.col("g") == 1).alias("y"), (F.col("report") % 2).alias("cohort"))


_SCO = "SELECT coalesce(x.report, p.report) AS report, score, x.term IS NOT NULL AS y, coalesce(x.report, p.report) % 2 AS cohort FROM gold x FULL JOIN pred p ON x.report = p.report AND x.term = p.term"
_CURVE = f"SELECT tau, cohort, {div('2 * count_if(s AND y)', '(2 * count_if(s AND y) + count_if(s AND NOT y) + count_if(NOT s AND y))')} AS f1 FROM (SELECT *, coalesce(score >= tau, false) AS s FROM so CROSS JOIN (SELECT CAST(unnest([0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS DOUBLE) AS tau)) GROUP BY ALL"
_BEST = "SELECT cohort, arg_min(tau, (-round(f1, 9), tau)) AS tau, arg_min(f1, (-round(f1, 9), tau)) AS f1 FROM cu GROUP BY cohort"
_T = {"so": _SCO, "cu": _CURVE, "be": _BEST}


@query("threshold_grid_fit", "cohort:i tau:d f1:d", sql("SELECT * FROM be", "gold", "pred", **_T))
def _(spark, d):
    return rs.best_threshold(rs.f1_of(rs.threshold_counts(_scored(spark, d), GRID, "cohort"), "cohort"), "cohort")


@query("transfer_gap", "tau_fit:d f1_fit:d f1_transfer:d tau_oracle:d f1_oracle:d gap:d",
       sql("SELECT a.tau AS tau_fit, a.f1 AS f1_fit, c.f1 AS f1_transfer, b.tau AS tau_oracle, b.f1 AS f1_oracle, b.f1 - c.f1 AS gap FROM be a JOIN be b ON a.cohort = 0 AND b.cohort = 1 JOIN cu c ON c.cohort = 1 AND c.tau = a.tau", "gold", "pred", **_T))
def _(spark, d):
    return rs.transfer_gap(_scored(spark, d), GRID, "cohort")


_X = _CURVE.replace("cohort", "fold, held").replace("FROM so CROSS JOIN", "FROM (SELECT so.*, k.fold, k.fold = fd.fold AS held FROM so JOIN fd ON fd.report = so.report CROSS JOIN range(5) k(fold)) CROSS JOIN")


@query("crossval_select", "fold:i tau:d f1_train:d f1_held:d",
       sql("SELECT t.fold, t.tau, t.f1 AS f1_train, h.f1 AS f1_held FROM (SELECT fold, arg_min(tau, (-round(f1, 9), tau)) AS tau, arg_min(f1, (-round(f1, 9), tau)) AS f1 FROM cv WHERE NOT held GROUP BY fold) t JOIN cv h ON h.held AND h.fold = t.fold AND h.tau = t.tau", "gold", "pred", so=_SCO, ts=_TERT, fd=_FOLD, cv=_X))
def _(spark, d):
    return rs.crossval_select(_scored(spark, d), rs.stratified_folds(_strata(spark, d)), GRID)


@query("provenance_restrict", "report:i term:s", sql("SELECT l_orderkey AS report, 'P' || l_partkey AS term FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL HAVING NOT bool_and(l_linestatus = 'O' OR l_suppkey % 3 = 0)"))
def _(spark, d):
    """Gold pairs with a source that is not excluded."""
    li = fx.table(spark, d, "lineitem").where("l_returnflag = 'R'")
    out = (F.col("l_linestatus") == "O") | (F.col("l_suppkey") % 3 == 0)
    return li.groupBy(F.col("l_orderkey").alias("report"), fx.part("l_partkey").alias("term")).agg(F.bool_and(out).alias("x")).where("not x").select("report", "term")


@query("subgroup_recall", "label:i n_gold:i n_found:i n_outside:i recall:d",
       sql(f"SELECT label, count(g.term) AS n_gold, count_if(g.term IS NOT NULL AND p.term IS NOT NULL) AS n_found, count_if(g.term IS NULL) AS n_outside, {div('count_if(g.term IS NOT NULL AND p.term IS NOT NULL)', 'count(g.term)')} AS recall FROM (SELECT DISTINCT l_orderkey AS report, 'P' || l_partkey AS term, l_linenumber % 3 AS label FROM lineitem WHERE l_tax >= 0.04) s LEFT JOIN gold g ON g.report = s.report AND g.term = s.term LEFT JOIN pred p ON p.report = s.report AND p.term = s.term GROUP BY label", "gold", "pred"))
def _(spark, d):
    """Recall over the labelled pairs that are gold, and how many labelled pairs are not."""
    rows = fx.table(spark, d, "lineitem").where("l_tax >= 0.04").select(F.col("l_orderkey").alias("report"), fx.part("l_partkey").alias("term"), (F.col("l_linenumber") % 3).alias("label")).distinct()
    met = rows.join(aligned(fx.gold(spark, d), fx.pred(spark, d)), ["report", "term"], "left")
    found = (F.col("g") == 1) & (F.col("p") == 1)
    n = met.groupBy("label").agg(F.count_if(F.col("g") == 1).alias("n_gold"), F.count_if(found).alias("n_found"), F.count_if(F.coalesce("g", F.lit(0)) == 0).alias("n_outside"))
    return n.withColumn("recall", F.coalesce(F.try_divide(F.col("n_found"), F.col("n_gold")), F.lit(0.0)))
