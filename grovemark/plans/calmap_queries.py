"""Queries on calibration maps, grouped calibration, samples of walks, and score distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovemark.operators import calibration as c
from grovemark.operators import calmaps as m
from grovemark.operators import graph as g
from grovemark.operators.resampling import stratified_folds
from grovemark.plans import fixtures as fx
from grovemark.plans.fixtures import div, sql
from grovemark.plans.graph_queries import _GR, _WIDE, scores
from grovemark.plans.registry import query
from grovemark.plans.traversal_queries import _FOLD, _TERT, _V, _strata, _visits

_AT = "SELECT conf, CAST(count(*) AS DOUBLE) AS n, CAST(sum(label) AS DOUBLE) AS y FROM sample GROUP BY conf"


def _newton(rows: str, by: str = "", steps: int = 25) -> str:
    """A recursion of Newton steps on the penalised logistic loss over counted scores."""
    b, on, key = (f"{by}, ", f"r.{by} = f.{by}", f"r.{by}, ") if by else ("", "true", "")
    p = "(1 / (1 + exp(-(f.a * r.conf + f.b))))"
    step = f"SELECT {key}f.i + 1 AS i, f.a, f.b, sum((r.y - r.n * {p}) * r.conf) - f.a AS g1, sum(r.y - r.n * {p}) AS g0, sum(r.n * {p} * (1 - {p}) * r.conf * r.conf) + 1 AS h11, sum(r.n * {p} * (1 - {p}) * r.conf) AS h10, sum(r.n * {p} * (1 - {p})) AS h00 FROM {{}} f JOIN {rows} r ON {on} WHERE f.i < {steps} GROUP BY {key}f.i, f.a, f.b"
    move = "i, a + (h00 * g1 - h10 * g0) / (h11 * h00 - h10 * h10) AS a, b + (h11 * g0 - h10 * g1) / (h11 * h00 - h10 * h10) AS b"
    first = f"SELECT DISTINCT {b}0 AS i, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM {rows}"
    return f"{first} UNION ALL SELECT {b}{move} FROM ({step.format('newton')})"


_PL = {"atm": _AT, "newton": _newton("atm"), "pl": "SELECT a AS slope, b AS intercept FROM newton WHERE i = 25"}


@query("calibration_platt", "slope:d intercept:d", sql("SELECT * FROM pl", "sample", **_PL))
def _(spark, d):
    return m.platt(m.atoms(fx.sample(spark, d)))


_ISO = "SELECT k.conf, (SELECT max(lo) FROM (SELECT i.r, min((j.cy - i.cy + i.y) / (j.cn - i.cn + i.n)) AS lo FROM cu i JOIN cu j ON j.r >= k.r WHERE i.r <= k.r GROUP BY i.r)) AS h FROM cu k"
_IS = {"atm": _AT, "cu": "SELECT *, row_number() OVER (ORDER BY conf) AS r, sum(n) OVER (ORDER BY conf) AS cn, sum(y) OVER (ORDER BY conf) AS cy FROM atm", "iso": _ISO}


@query("calibration_isotonic", "conf:d h:d", sql("SELECT * FROM iso", "sample", **_IS))
def _(spark, d):
    return m.isotonic(m.atoms(fx.sample(spark, d)))


_TAUS = [0.1, 0.2, 0.24, 0.3, 0.9]
_GRID = "SELECT i / 20000.0 AS conf FROM range(20001) x(i)"
_LIN = "SELECT g.conf, CASE WHEN l.conf IS NULL THEN (SELECT arg_min(h, conf) FROM iso) WHEN l.nc IS NULL THEN l.h ELSE l.h + (l.nh - l.h) * (g.conf - l.conf) / (l.nc - l.conf) END AS h FROM gd g ASOF LEFT JOIN (SELECT *, lead(conf) OVER (ORDER BY conf) AS nc, lead(h) OVER (ORDER BY conf) AS nh FROM iso) l ON g.conf >= l.conf"
_INV = "SELECT '{0}' AS method, tau, coalesce(min(conf) FILTER (h >= tau), CAST('Infinity' AS DOUBLE)) AS raw FROM {1} CROSS JOIN (SELECT CAST(unnest([0.1, 0.2, 0.24, 0.3, 0.9]) AS DOUBLE) AS tau) GROUP BY tau"


@query("inverse_threshold", "method:s tau:d raw:d",
       sql(" UNION ALL ".join(_INV.format(*x) for x in (("identity", "(SELECT conf, conf AS h FROM gd)"), ("platt", "(SELECT conf, 1 / (1 + exp(-(slope * conf + intercept))) AS h FROM gd, pl)"), ("isotonic", "lin"))), "sample", **_PL, gd=_GRID, cu=_IS["cu"], iso=_ISO, lin=_LIN))
def _(spark, d):
    """The raw score at which each map first reaches a threshold."""
    at, grid = m.atoms(fx.sample(spark, d)), m.grid(spark)
    maps = {"identity": grid.withColumn("h", F.col("conf")), "platt": m.apply_platt(grid, m.platt(at), name="h"), "isotonic": m.at_knots(grid, m.isotonic(at))}
    out = None
    for name, rows in maps.items():
        part = m.inverse_threshold(rows, _TAUS).select(F.lit(name).alias("method"), "tau", "raw")
        out = part if out is None else out.unionByName(part)
    return out


@query("calibration_fits", "grp:i n:i y:i fits:s", "SELECT l_linenumber % 4 AS grp, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' AND l_linenumber % 4 <> 1 THEN 1 ELSE 0 END) AS y, y >= 5 AND y < n AS fits FROM lineitem GROUP BY 1")
def _(spark, d):
    """Which groups a map can be fitted on; a group without positives keeps its scores."""
    y = ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 4 != 1)).cast("int")
    s = fx.table(spark, d, "lineitem").select((F.col("l_linenumber") % 4).alias("grp"), (F.col("l_quantity") / 50).alias("conf"), y.alias("label"))
    return m.usable(m.atoms(s, "grp"), "grp")


@query("f1_threshold_diagnostic", "best_threshold:d best_f1:d half_optimal_f1:d gap:d",
       sql("SELECT best_threshold, best_f1, best_f1 / 2 AS half_optimal_f1, best_threshold - best_f1 / 2 AS gap FROM (SELECT arg_min(conf, (-round(f1, 12), -conf)) AS best_threshold, arg_min(f1, (-round(f1, 12), -conf)) AS best_f1 FROM (SELECT conf, 2 * sum(y) OVER w / (sum(n) OVER w + (SELECT sum(y) FROM atm)) AS f1 FROM atm WINDOW w AS (ORDER BY conf DESC)))", "sample", atm=_AT))
def _(spark, d):
    return m.f1_diagnostic(fx.sample(spark, d))


@query("smooth_ece")
def _(spark, d):
    return m.smooth_ece(fx.sample(spark, d), "grp")


def _ece_sql(rows: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"SELECT {b}sum(n) AS n, sum(abs(acc - mc) * n) / sum(n) AS ece FROM (SELECT {b}least(floor(conf * 15), 14) AS bin, CAST(count(*) AS DOUBLE) AS n, avg(conf) AS mc, avg(label) AS acc FROM {rows} GROUP BY ALL) {'GROUP BY ' + by if by else ''}"


@query("raw_vs_calibrated", "ece_raw:d ece_mapped:d ece_change:d brier_raw:d brier_mapped:d brier_change:d",
       sql(f"SELECT a.ece AS ece_raw, b.ece AS ece_mapped, b.ece - a.ece AS ece_change, x.raw AS brier_raw, x.mapped AS brier_mapped, x.mapped - x.raw AS brier_change FROM ({_ece_sql('sample')}) a, ({_ece_sql('(SELECT mapped AS conf, label FROM mp)')}) b, (SELECT avg((conf - label) ** 2) AS raw, avg((mapped - label) ** 2) AS mapped FROM mp) x", "sample", **_PL, mp="SELECT conf, label, 1 / (1 + exp(-(slope * conf + intercept))) AS mapped FROM sample, pl"))
def _(spark, d):
    s = fx.sample(spark, d)
    mapped = m.apply_platt(s, m.platt(m.atoms(s))).select(F.col("mapped").alias("conf"), "label")
    one = lambda rows, n: c.ece(c.width_bins(rows, 15)).select(F.col("ece").alias(f"ece_{n}")).crossJoin(c.brier(rows).select(F.col("brier").alias(f"brier_{n}")))
    both = one(s, "raw").crossJoin(one(mapped, "mapped"))
    return both.select("ece_raw", "ece_mapped", (F.col("ece_mapped") - F.col("ece_raw")).alias("ece_change"), "brier_raw", "brier_mapped", (F.col("brier_mapped") - F.col("brier_raw")).alias("brier_change"))


@query("calibration_report", "n:i ece_width:d ece_mass:d brier:d tail_ece:d tail_n:i mean_conf:d base_rate:d",
       sql(f"SELECT a.n, a.ece AS ece_width, b.ece AS ece_mass, x.brier, t.ece AS tail_ece, t.n AS tail_n, x.mean_conf, x.base_rate FROM ({_ece_sql('sample')}) a, (SELECT sum(abs(acc - mc) * n) / sum(n) AS ece FROM (SELECT len(list_filter(edges, lambda e: e <= conf)) AS bin, CAST(count(*) AS DOUBLE) AS n, avg(conf) AS mc, avg(label) AS acc FROM sample, (SELECT quantile_cont(conf, [{', '.join(f'{i}/15.0' for i in range(1, 15))}]) AS edges FROM sample) GROUP BY 1)) b, (SELECT avg((conf - label) ** 2) AS brier, avg(conf) AS mean_conf, avg(label) AS base_rate FROM sample) x, ({_ece_sql('(SELECT * FROM sample WHERE conf <= 0.3)')}) t", "sample"))
def _(spark, d):
    """The measures of calibration of one sample in one row."""
    s = fx.sample(spark, d)
    width, mass, tail = c.ece(c.width_bins(s, 15)), c.ece(c.mass_bins(s, 15)), c.ece(c.width_bins(s.where("conf <= 0.3"), 15))
    out = width.select("n", F.col("ece").alias("ece_width")).crossJoin(mass.select(F.col("ece").alias("ece_mass"))).crossJoin(tail.select(F.col("ece").alias("tail_ece"), F.col("n").alias("tail_n")))
    return out.crossJoin(c.brier(s).select("brier")).crossJoin(s.agg(F.avg("conf").alias("mean_conf"), F.avg("label").alias("base_rate")))


@query("signed_gap_bins", "bin:i n:i gap:d direction:s",
       sql("SELECT *, CASE WHEN gap > 0 THEN 'over' WHEN gap < 0 THEN 'under' ELSE 'even' END AS direction FROM (SELECT least(floor(conf * 10), 9) AS bin, count(*) AS n, round(avg(conf) - avg(label), 9) AS gap FROM sample GROUP BY 1)", "sample"))
def _(spark, d):
    gap = F.round(F.col("mean_conf") - F.col("accuracy"), 9)
    return c.width_bins(fx.sample(spark, d), 10).select("bin", "n", gap.alias("gap"), F.when(gap > 0, "over").when(gap < 0, "under").otherwise("even").alias("direction"))


_PSA = "SELECT p.report, p.term, p.score AS conf, CASE WHEN g.term IS NULL THEN 0 ELSE 1 END AS label FROM pred p LEFT JOIN gold g ON g.report = p.report AND g.term = p.term"


def _pairs(spark, d):
    y = fx.gold(spark, d).withColumn("y", F.lit(1))
    return fx.pred(spark, d).join(y, ["report", "term"], "left").select("report", "term", F.col("score").alias("conf"), F.coalesce("y", F.lit(0)).alias("label"))


@query("pair_calibration_sample", "conf:d n:i n_positive:i", sql("SELECT conf, count(*) AS n, sum(label) AS n_positive FROM ps GROUP BY 1", "pred", "gold", ps=_PSA))
def _(spark, d):
    """Predicted pairs with their scores and whether they are gold, counted by score."""
    return m.atoms(_pairs(spark, d)).withColumnRenamed("y", "n_positive")


@query("depth_group_ece", "depth:i n:i ece:d", sql(_ece_sql("(SELECT s.*, d.depth FROM ps s JOIN long_depth d ON d.term = s.term)", "depth"), "pred", "gold", "long_depth", ps=_PSA))
def _(spark, d):
    s = _pairs(spark, d).join(g.longest_depths(fx.edges(spark, d)), "term")
    return c.ece(c.width_bins(s, 15, "depth"), "depth")


@query("layer1_group_ece", "layer1:s n:i ece:d", sql(_ece_sql("(SELECT s.*, c.ancestor AS layer1 FROM ps s JOIN closed c ON c.descendant = s.term AND c.ancestor LIKE 'R%')", "layer1"), "pred", "gold", "closed", ps=_PSA))
def _(spark, d):
    """Calibration by top branch; a term with several counts in each."""
    tops = fx.closed(spark, d).where("ancestor like 'R%'").select(F.col("descendant").alias("term"), F.col("ancestor").alias("layer1"))
    return c.ece(c.width_bins(_pairs(spark, d).join(tops, "term"), 15, "layer1"), "layer1")


_LGT = "ln(least(greatest(conf, 1e-6), 1 - 1e-6) / (1 - least(greatest(conf, 1e-6), 1 - 1e-6)))"
_CF = {
    "ts": _TERT, "fd": _FOLD, "ps": _PSA, "lz": f"SELECT s.report, s.label, {_LGT} AS conf, f.fold FROM ps s JOIN fd f ON f.report = s.report",
    "tr": "SELECT k.fold, conf, CAST(count(*) AS DOUBLE) AS n, CAST(sum(label) AS DOUBLE) AS y FROM lz JOIN range(5) k(fold) ON k.fold <> lz.fold GROUP BY ALL", "newton": _newton("tr", "fold"),
    "cf": "SELECT z.*, 1 / (1 + exp(-(f.a * z.conf + f.b))) AS mapped FROM lz z JOIN newton f ON f.fold = z.fold AND f.i = 25",
}


def _crossfit(spark, d):
    """Pairs with the fold of their report and the score mapped by a fit on the other folds' logits."""
    folds = stratified_folds(_strata(spark, d)).select("report", "fold")
    rows = m.on_logits(_pairs(spark, d)).join(folds, "report")
    others = rows.withColumn("own", F.col("fold")).withColumn("fold", F.explode(F.array(*map(F.lit, range(5))))).where("fold <> own")
    others = others.withColumn("fold", F.col("fold").cast("long"))
    return m.apply_platt(rows.withColumn("fold", F.col("fold").cast("long")), m.platt(m.atoms(others, "fold"), "fold"), "fold")


@query("platt_crossfit", "fold:i n:i mean_mapped:d brier:d", sql("SELECT fold, count(*) AS n, avg(mapped) AS mean_mapped, avg((mapped - label) ** 2) AS brier FROM cf GROUP BY fold", "gold", "pred", **_CF))
def _(spark, d):
    return _crossfit(spark, d).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("mapped").alias("mean_mapped"), F.avg(F.pow(F.col("mapped") - F.col("label"), 2)).alias("brier"))


_Z = c.Z95


@query("reliability_crossfit", "bin:i n:i positives:i mean_predicted:d observed:d wilson_lo:d wilson_hi:d",
       sql(f"SELECT *, greatest((observed + {_Z**2} / (2 * n) - {_Z} * sqrt(observed * (1 - observed) / n + {_Z**2} / (4 * n * n))) / (1 + {_Z**2} / n), 0) AS wilson_lo, least((observed + {_Z**2} / (2 * n) + {_Z} * sqrt(observed * (1 - observed) / n + {_Z**2} / (4 * n * n))) / (1 + {_Z**2} / n), 1) AS wilson_hi FROM (SELECT least(floor(round(mapped, 9) * 40), 39) AS bin, CAST(count(*) AS DOUBLE) AS n, sum(label) AS positives, avg(mapped) AS mean_predicted, avg(label) AS observed FROM cf GROUP BY 1)", "gold", "pred", **_CF))
def _(spark, d):
    """Observed rates with intervals by bins of the cross-fitted score."""
    rows = _crossfit(spark, d)
    b = rows.groupBy(F.least(F.floor(F.round("mapped", 9) * 40), F.lit(39)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.avg("mapped").alias("mean_predicted"), F.avg("label").alias("observed"))
    low, high = c.wilson(F.col("positives"), F.col("n"))
    return b.select("*", low.alias("wilson_lo"), high.alias("wilson_hi"))


_N = ("calls", "edges", "nodes", "closed", "depth")
_UPG = "SELECT DISTINCT gr.report, c.ancestor AS term FROM gr JOIN closed c ON c.descendant = gr.term"
_TS = {**_WIDE, "v": _V, "gr": _GR, "ug": _UPG, "ts_": "SELECT v.report, v.term, coalesce(s.score, 0) AS conf, CASE WHEN x.term IS NULL THEN 0 ELSE 1 END AS label, CASE WHEN u.term IS NULL THEN 0 ELSE 1 END AS under FROM v LEFT JOIN sc s ON s.report = v.report AND s.term = v.term LEFT JOIN gr x ON x.report = v.report AND x.term = v.term LEFT JOIN ug u ON u.report = v.report AND u.term = v.term"}


def _walk(spark, d):
    """Visited terms with score, label (is it gold) and under (is any gold term of the report in its subtree)."""
    gold = fx.table(spark, d, "lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") % 200).alias("report"), fx.part("l_partkey").alias("term")).distinct()
    under = g.ancestors_of(gold, fx.closed(spark, d)).withColumn("under", F.lit(1))
    rows = _visits(spark, d).join(scores(spark, d), ["report", "term"], "left").join(gold.withColumn("label", F.lit(1)), ["report", "term"], "left").join(under, ["report", "term"], "left")
    return rows.select("report", "term", F.coalesce("score", F.lit(0.0)).alias("conf"), F.coalesce("label", F.lit(0)).alias("label"), F.coalesce("under", F.lit(0)).alias("under"))


@query("tree_calibration_sample", "accept_n:i accept_positive:i accept_mean:d prune_positive:i prune_mean:d ece_accept:d ece_prune:d",
       sql(f"SELECT count(*) AS accept_n, sum(label) AS accept_positive, avg(conf) AS accept_mean, sum(under) FILTER (term NOT LIKE 'P%') AS prune_positive, avg(conf) FILTER (term NOT LIKE 'P%') AS prune_mean, (SELECT ece FROM ({_ece_sql('ts_')})) AS ece_accept, (SELECT ece FROM ({_ece_sql(chr(40) + 'SELECT conf, under AS label FROM ts_ WHERE term NOT LIKE ' + chr(39) + 'P%' + chr(39) + chr(41))})) AS ece_prune FROM ts_", *_N, **_TS))
def _(spark, d):
    """Two samples of one walk: acceptance (is the term gold) and expansion (is gold below an inner term)."""
    w = _walk(spark, d)
    inner = w.where("term not like 'P%'")
    e = lambda rows, n: c.ece(c.width_bins(rows, 15)).select(F.col("ece").alias(n))
    a = w.agg(F.count(F.lit(1)).alias("accept_n"), F.sum("label").alias("accept_positive"), F.avg("conf").alias("accept_mean"))
    b = inner.agg(F.sum("under").alias("prune_positive"), F.avg("conf").alias("prune_mean"))
    return a.crossJoin(b).crossJoin(e(w, "ece_accept")).crossJoin(e(inner.select("conf", F.col("under").alias("label")), "ece_prune"))


_DS = "SELECT 'accept' AS decision, conf, label FROM ts_ UNION ALL SELECT 'expand', conf, under FROM ts_ WHERE term NOT LIKE 'P%'"


@query("score_distributions", "decision:s bin:i label:i n:i", sql("SELECT decision, least(floor(conf * 20), 19) AS bin, label, count(*) AS n FROM ds GROUP BY ALL", *_N, **_TS, ds=_DS))
def _(spark, d):
    """Histograms of both decisions' scores by class."""
    w = _walk(spark, d)
    hist = lambda rows, name: m.histogram(rows, F.col("conf"), 0.0, 1.0, 20).select(F.lit(name).alias("decision"), "bin", "label", "n")
    return hist(w, "accept").unionByName(hist(w.where("term not like 'P%'").select("conf", F.col("under").alias("label")), "expand"))


_LZ = _LGT.replace("conf", "round(conf, 9)")


@query("logit_histogram", "bin:i label:i n:i", sql(f"SELECT greatest(0, least(floor(({_LZ} + 15) / 30 * 60), 59)) AS bin, label, count(*) AS n FROM ts_ GROUP BY ALL", *_N, **_TS))
def _(spark, d):
    from grovemark.functions.codes import logit

    return m.histogram(_walk(spark, d), logit(F.round("conf", 9)), -15.0, 15.0, 60)


@query("survival_rows", "cut:d label:i share:d", sql("SELECT cut, label, avg(CASE WHEN conf >= cut THEN 1.0 ELSE 0 END) AS share FROM ts_ CROSS JOIN (SELECT CAST(unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS DOUBLE) AS cut) GROUP BY ALL", *_N, **_TS))
def _(spark, d):
    return m.survival(_walk(spark, d), F.col("conf"), [0.1, 0.25, 0.5, 0.75, 0.9])


_PO = {"P0": "max(CASE WHEN margin > 0 THEN 1.0 ELSE 0 END)", "P1": "max(1 / (1 + exp(-margin)))", "P2": "1 - product(1 - 1 / (1 + exp(-margin)))", "P4": "avg(1 / (1 + exp(-margin)))"}
_PQ = "SELECT pooling, report, term, round(conf, 9) AS conf, label FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS pooling, c.report, c.term, {v} AS conf, max(CASE WHEN x.term IS NULL THEN 0 ELSE 1 END) AS label FROM calls c LEFT JOIN gr x ON x.report = c.report AND x.term = c.term GROUP BY c.report, c.term" for k, v in _PO.items()) + ")"


@query("acceptance_ranking", "pooling:s auc:d average_precision:d",
       sql("SELECT pooling, sum(y * (below + (n - y) / 2.0)) / nullif(sum(y) * sum(n - y), 0) AS auc, sum(y * tp / k) / nullif(sum(y), 0) AS average_precision FROM (SELECT *, coalesce(sum(n - y) OVER (PARTITION BY pooling ORDER BY conf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(n) OVER (PARTITION BY pooling ORDER BY conf DESC) AS k, sum(y) OVER (PARTITION BY pooling ORDER BY conf DESC) AS tp FROM (SELECT pooling, conf, CAST(count(*) AS DOUBLE) AS n, CAST(sum(label) AS DOUBLE) AS y FROM pq GROUP BY ALL)) GROUP BY pooling", "calls", gr=_GR, pq=_PQ))
def _(spark, d):
    """How well each way of pooling a pair's margins ranks gold pairs above the others."""
    from grovemark.functions.codes import sigmoid

    gold = fx.table(spark, d, "lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") % 200).alias("report"), fx.part("l_partkey").alias("term")).distinct().withColumn("y", F.lit(1))
    s = sigmoid(F.col("margin"))
    miss = F.aggregate(F.collect_list(s), F.lit(1.0), lambda acc, x: acc * (1 - x))
    per = fx.calls(spark, d).groupBy("report", "term").agg(F.max((F.col("margin") > 0).cast("double")).alias("P0"), F.max(s).alias("P1"), (1 - miss).alias("P2"), F.avg(s).alias("P4"))
    long = per.join(gold, ["report", "term"], "left").select(F.coalesce("y", F.lit(0)).alias("label"), F.explode(F.create_map(*[x for k in _PO for x in (F.lit(k), F.col(k))])).alias("pooling", "conf"))
    return m.average_precision(long.withColumn("conf", F.round("conf", 9)), "pooling")
