"""Queries on the term graph and on hierarchy-aware quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovemark.operators import graph as g
from grovemark.operators.quality import counted
from grovemark.plans import fixtures as fx
from grovemark.plans.fixtures import div, prf_sql, sql
from grovemark.plans.registry import query

_P = prf_sql()


@query("closure_pairs", "descendant:s ancestor:s hops:i", sql("SELECT * FROM closed", "closed"))
def _(spark, d):
    return fx.closed(spark, d)


@query("closure_sizes", "n_ancestors:i n_terms:i", sql("SELECT n_ancestors, count(*) AS n_terms FROM (SELECT descendant, count(*) AS n_ancestors FROM closed GROUP BY 1) GROUP BY 1", "closed"))
def _(spark, d):
    return fx.closed(spark, d).groupBy("descendant").agg(F.count(F.lit(1)).alias("n_ancestors")).groupBy("n_ancestors").agg(F.count(F.lit(1)).alias("n_terms"))


@query("ancestor_count_distribution", "mean:d median:d low:i high:i",
       sql("SELECT avg(n) AS mean, median(n) AS median, min(n) AS low, max(n) AS high FROM (SELECT report, count(DISTINCT ancestor) AS n FROM gold JOIN closed ON term = descendant GROUP BY report)", "gold", "closed"))
def _(spark, d):
    n = g.ancestors_of(fx.gold(spark, d), fx.closed(spark, d)).groupBy("report").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.min("n").alias("low"), F.max("n").alias("high"))


@query("term_depths", "term:s depth:i", sql("SELECT * FROM depth", "depth"))
def _(spark, d):
    return g.depths(fx.edges(spark, d), fx.closed(spark, d))


@query("term_depths_longest", "term:s depth:i", sql("SELECT * FROM long_depth", "long_depth"))
def _(spark, d):
    return g.longest_depths(fx.edges(spark, d))


@query("layer1_of", "term:s layer1:s n_layer1:i", sql("SELECT descendant AS term, min(ancestor) AS layer1, count(*) AS n_layer1 FROM closed WHERE ancestor LIKE 'R%' GROUP BY 1", "closed"))
def _(spark, d):
    return g.layer1(fx.edges(spark, d), fx.closed(spark, d))


@query("subtree_sizes", "term:s subtree_size:i n_children:i is_leaf:s",
       sql("SELECT ancestor AS term, count(*) AS subtree_size, count_if(hops = 1) AS n_children, count(*) = 1 AS is_leaf FROM closed GROUP BY 1", "closed"))
def _(spark, d):
    return fx.closed(spark, d).groupBy(F.col("ancestor").alias("term")).agg(F.count(F.lit(1)).alias("subtree_size"), F.count_if(F.col("hops") == 1).alias("n_children"), (F.count(F.lit(1)) == 1).alias("is_leaf"))


_COHORT = "SELECT tp, fp, fn, " + ", ".join(f"{v} AS micro_{k}" for k, v in _P.items()) + ", macro_precision, macro_recall, macro_f1 FROM (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _P.items()) + " FROM u))"
_CC = "tp:i fp:i fn:i micro_precision:d micro_recall:d micro_f1:d macro_precision:d macro_recall:d macro_f1:d"
_UP = "SELECT DISTINCT report, ancestor AS term FROM {} JOIN closed ON term = descendant"
_H = "SELECT report, count_if(a AND b) AS tp, count_if(b AND NOT a) AS fp, count_if(a AND NOT b) AS fn FROM (SELECT coalesce(x.report, y.report) AS report, x.term IS NOT NULL AS a, y.term IS NOT NULL AS b FROM hg x FULL JOIN hp y ON x.report = y.report AND x.term = y.term) GROUP BY report"


@query("hier_prf", _CC, sql(_COHORT, "gold", "pred", "closed", hg=_UP.format("gold"), hp=_UP.format("pred"), u=_H))
def _(spark, d):
    return g.cohort(g.h_counts(fx.gold(spark, d), fx.pred(spark, d), fx.closed(spark, d)))


_UNDER = "SELECT report, ancestor AS term, count(*) AS n FROM {} JOIN closed ON term = descendant GROUP BY ALL"
_C = "SELECT coalesce(x.report, y.report) AS report, sum(least(coalesce(x.n, 0), coalesce(y.n, 0))) AS tp, sum(greatest(coalesce(y.n, 0) - coalesce(x.n, 0), 0)) AS fp, sum(greatest(coalesce(x.n, 0) - coalesce(y.n, 0), 0)) AS fn FROM hg x FULL JOIN hp y ON x.report = y.report AND x.term = y.term GROUP BY 1"


@query("cophe", _CC, sql(_COHORT, "gold", "pred", "closed", hg=_UNDER.format("gold"), hp=_UNDER.format("pred"), u=_C))
def _(spark, d):
    return g.cohort(g.cophe_counts(fx.gold(spark, d), fx.pred(spark, d), fx.closed(spark, d)))


_WP = {
    "anc": "SELECT c.descendant, c.ancestor, l.depth FROM closed c JOIN long_depth l ON c.ancestor = l.term",
    "gp": "SELECT p.report, p.term AS a, g.term AS b FROM pred p JOIN gold g ON p.report = g.report",
    "ab": "SELECT DISTINCT a, b FROM gp",
    "lcs": "SELECT ab.a, ab.b, max(x.depth) AS d FROM ab JOIN anc x ON x.descendant = ab.a JOIN anc y ON y.descendant = ab.b AND x.ancestor = y.ancestor GROUP BY ALL",
    "sims": f"SELECT gp.report, gp.a, gp.b, {div('2 * coalesce(lcs.d, 0)', '(da.depth + db.depth)')} AS sim FROM gp LEFT JOIN lcs ON gp.a = lcs.a AND gp.b = lcs.b JOIN long_depth da ON da.term = gp.a JOIN long_depth db ON db.term = gp.b",
}


@query("soft_prf_wu_palmer", "n_reports:i precision:d recall:d f1:d",
       sql(f"SELECT count(*) AS n_reports, avg(p) AS precision, avg(r) AS recall, avg({div('2 * p * r', '(p + r)')}) AS f1 FROM (SELECT k.report, coalesce(x.p, 0) AS p, coalesce(y.r, 0) AS r FROM (SELECT report FROM gold UNION SELECT report FROM pred) k LEFT JOIN (SELECT report, avg(s) AS p FROM (SELECT report, a, max(sim) AS s FROM sims GROUP BY ALL) GROUP BY 1) x ON x.report = k.report LEFT JOIN (SELECT report, avg(s) AS r FROM (SELECT report, b, max(sim) AS s FROM sims GROUP BY ALL) GROUP BY 1) y ON y.report = k.report)", "gold", "pred", "closed", "long_depth", **_WP))
def _(spark, d):
    s = g.soft_prf(fx.gold(spark, d), fx.pred(spark, d), fx.closed(spark, d), g.longest_depths(fx.edges(spark, d)))
    return s.agg(F.count(F.lit(1)).alias("n_reports"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


_MIX = "SELECT report, term FROM pred UNION SELECT l_orderkey, 'S' || l_suppkey FROM lineitem WHERE l_quantity >= 25"


def _mixed(spark, d):
    """Predictions at two levels, so that some are ancestors of others."""
    above = fx.table(spark, d, "lineitem").where("l_quantity >= 25").select(F.col("l_orderkey").alias("report"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("term"))
    return fx.pred(spark, d).select("report", "term").union(above).distinct()


@query("reduce_specific", "report:i term:s", sql("SELECT report, term FROM mix m WHERE NOT EXISTS (SELECT 1 FROM mix x JOIN closed c ON x.term = c.descendant WHERE x.report = m.report AND c.ancestor = m.term AND c.hops > 0)", "pred", "closed", mix=_MIX))
def _(spark, d):
    return g.most_specific(_mixed(spark, d), fx.closed(spark, d))


_HIT = "SELECT m.report, m.term, g.term IS NOT NULL AS hit, EXISTS (SELECT 1 FROM gold x JOIN closed c ON x.term = c.descendant WHERE x.report = m.report AND c.ancestor = m.term) AS above, EXISTS (SELECT 1 FROM gold x WHERE x.report = m.report) AS has_gold FROM mix m LEFT JOIN gold g ON g.report = m.report AND g.term = m.term"


def _sibling(alias: str) -> str:
    return f"EXISTS (SELECT 1 FROM gold x JOIN edges e ON e.child = x.term JOIN edges f ON f.parent = e.parent WHERE x.report = {alias}.report AND f.child = {alias}.term)"


@query("fp_taxonomy_existential", "kind:s n:i share:d",
       sql(f"SELECT kind, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM (SELECT CASE WHEN NOT has_gold THEN 'no_gold' WHEN above THEN 'ancestor' WHEN {_sibling('h')} THEN 'sibling' WHEN EXISTS (SELECT 1 FROM gold x JOIN closed c ON c.descendant = x.term JOIN closed k ON k.ancestor = c.ancestor WHERE x.report = h.report AND k.descendant = h.term AND c.ancestor LIKE 'R%') THEN 'same_branch' ELSE 'unrelated' END AS kind FROM hit h WHERE NOT h.hit) GROUP BY kind", "gold", "pred", "closed", "edges", mix=_MIX, hit=_HIT))
def _(spark, d):
    """Each false positive's closest relation to any gold term of its report, in order: ancestor, sibling, same branch."""
    gold, closed, edges = fx.gold(spark, d), fx.closed(spark, d), fx.edges(spark, d)
    wrong = _mixed(spark, d).join(gold, ["report", "term"], "left_anti")
    mark = lambda rows, n: rows.select("report", "term").distinct().withColumn(n, F.lit(True))
    above = mark(g.ancestors_of(gold, closed), "above")
    parents = gold.join(edges, gold.term == edges.child).select("report", "parent").distinct()
    # Up from the false positives to parents that a gold term of the report has too; never down to all children.
    siblings = mark(wrong.join(edges, F.col("term") == F.col("child")).join(parents, ["report", "parent"], "left_semi"), "sibling")
    tops = g.ancestors_of(gold, closed.where("ancestor like 'R%'")).withColumnRenamed("term", "top")
    mine = wrong.join(closed.where("ancestor like 'R%'"), F.col("term") == F.col("descendant")).select("report", "term", F.col("ancestor").alias("top"))
    branch = mark(mine.join(tops, ["report", "top"], "left_semi"), "branch")
    any_ = gold.select("report").distinct().withColumn("any", F.lit(True))
    met = wrong.join(any_, "report", "left")
    for m in (above, siblings, branch):
        met = met.join(m, ["report", "term"], "left")
    kind = F.when(F.col("any").isNull(), "no_gold").when(F.col("above"), "ancestor").when(F.col("sibling"), "sibling").when(F.col("branch"), "same_branch").otherwise("unrelated")
    n = met.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("t"))).select("kind", "n", (F.col("n") / F.col("t")).alias("share"))


@query("fn_taxonomy", "kind:s n:i",
       sql(f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM mix m JOIN closed c ON c.ancestor = m.term WHERE m.report = g.report AND c.descendant = g.term) THEN 'ancestor_predicted' WHEN EXISTS (SELECT 1 FROM mix x JOIN edges e ON e.child = x.term JOIN edges f ON f.parent = e.parent WHERE x.report = g.report AND f.child = g.term) THEN 'sibling_predicted' WHEN EXISTS (SELECT 1 FROM mix m WHERE m.report = g.report) THEN 'other_predicted' ELSE 'nothing_predicted' END AS kind FROM gold g WHERE NOT EXISTS (SELECT 1 FROM mix m WHERE m.report = g.report AND m.term = g.term)) GROUP BY kind", "gold", "pred", "closed", "edges", mix=_MIX))
def _(spark, d):
    gold, closed, edges, mix = fx.gold(spark, d), fx.closed(spark, d), fx.edges(spark, d), _mixed(spark, d)
    missed = gold.join(mix, ["report", "term"], "left_anti")
    up = missed.join(closed, F.col("term") == F.col("descendant")).select("report", "term", F.col("ancestor").alias("other"))
    above = up.join(mix.withColumnRenamed("term", "other"), ["report", "other"], "left_semi").select("report", "term").distinct().withColumn("above", F.lit(True))
    parents = mix.join(edges, mix.term == edges.child).select("report", "parent").distinct()
    mine = missed.join(edges, F.col("term") == F.col("child")).select("report", "term", "parent")
    sibling = mine.join(parents, ["report", "parent"], "left_semi").select("report", "term").distinct().withColumn("sibling", F.lit(True))
    any_ = mix.select("report").distinct().withColumn("any", F.lit(True))
    met = missed.join(above, ["report", "term"], "left").join(sibling, ["report", "term"], "left").join(any_, "report", "left")
    kind = F.when(F.col("above"), "ancestor_predicted").when(F.col("sibling"), "sibling_predicted").when(F.col("any"), "other_predicted").otherwise("nothing_predicted")
    return met.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("depth_stratified_recall", "depth:i n_gold:i n_found:i recall:d",
       sql(f"SELECT depth, count(*) AS n_gold, sum(p) AS n_found, {div('sum(p)', 'count(*)')} AS recall FROM hp JOIN depth ON hp.term = depth.term GROUP BY depth", "gold", "pred", "closed", "depth", ug=_UP.format("gold"), up=_UP.format("pred"), hp="SELECT x.report, x.term, CASE WHEN y.term IS NULL THEN 0 ELSE 1 END AS p FROM ug x LEFT JOIN up y ON x.report = y.report AND x.term = y.term"))
def _(spark, d):
    closed = fx.closed(spark, d)
    g_, p_ = g.ancestors_of(fx.gold(spark, d), closed), g.ancestors_of(fx.pred(spark, d), closed).withColumn("p", F.lit(1))
    met = g_.join(p_, ["report", "term"], "left").join(g.depths(fx.edges(spark, d), closed), "term")
    return met.groupBy("depth").agg(F.count(F.lit(1)).alias("n_gold"), F.count("p").alias("n_found"), (F.count("p") / F.count(F.lit(1))).alias("recall"))


@query("layer1_performance", "layer1:s tp:i fp:i fn:i",
       sql("SELECT c.ancestor AS layer1, sum(g * p) AS tp, sum((1 - g) * p) AS fp, sum(g * (1 - p)) AS fn FROM pairs JOIN closed c ON term = descendant WHERE c.ancestor LIKE 'R%' GROUP BY 1", "pairs", "closed"))
def _(spark, d):
    from grovemark.operators.quality import aligned

    tops = fx.closed(spark, d).where("ancestor like 'R%'")
    pairs = aligned(fx.gold(spark, d), fx.pred(spark, d)).join(tops, F.col("term") == F.col("descendant")).withColumnRenamed("ancestor", "layer1")
    return counted(pairs, "layer1")


_NB = "SELECT child AS x, parent AS y FROM edges UNION SELECT parent, child FROM edges"
_NEAR = "SELECT w.report, w.term, CASE WHEN EXISTS (SELECT 1 FROM nb JOIN gold g ON g.term = nb.y WHERE nb.x = w.term AND g.report = w.report) THEN 1 WHEN EXISTS (SELECT 1 FROM nb JOIN gn ON gn.y = nb.y WHERE nb.x = w.term AND gn.report = w.report) THEN 2 ELSE -1 END AS distance FROM wrong w"


@query("near_miss_hist", "distance:i n:i",
       sql("SELECT distance, count(*) AS n FROM near GROUP BY distance", "gold", "pred", "edges", nb=_NB, gn="SELECT DISTINCT g.report, nb.y FROM gold g JOIN nb ON nb.x = g.term", wrong="SELECT p.report, p.term FROM pred p ANTI JOIN gold g ON g.report = p.report AND g.term = p.term", near=_NEAR))
def _(spark, d):
    return g.near_misses(fx.gold(spark, d), fx.pred(spark, d), fx.edges(spark, d)).groupBy("distance").agg(F.count(F.lit(1)).alias("n"))


_WRONG = "SELECT p.report, p.term FROM pred p ANTI JOIN (SELECT report, term FROM gold SEMI JOIN nodes USING (term)) g ON g.report = p.report AND g.term = p.term"
#: Distances from every false positive's term to all that it reaches, without a bound on the hops.
_DIST = {"dist(a, node, hops) USING KEY (a, node)": "SELECT DISTINCT term, term, 0 FROM wrong SEMI JOIN nodes USING (term) UNION SELECT d.a, nb.y, min(d.hops + 1) FROM dist d JOIN nb ON nb.x = d.node LEFT JOIN recurring.dist r ON r.a = d.a AND r.node = nb.y WHERE r.a IS NULL GROUP BY d.a, nb.y"}


@query("near_miss_hist_full", "distance:i n:i",
       sql("SELECT distance, count(*) AS n FROM (SELECT w.report, w.term, coalesce(min(t.hops), -1) AS distance FROM wrong w LEFT JOIN gold g ON g.report = w.report LEFT JOIN dist t ON t.a = w.term AND t.node = g.term GROUP BY ALL) GROUP BY distance", "gold", "pred", "nodes", nb=_NB, wrong=_WRONG, **_DIST))
def _(spark, d):
    """The whole histogram of distances; -1 counts those that can't be measured, and only those."""
    return g.near_miss_distances(fx.gold(spark, d), fx.pred(spark, d), fx.edges(spark, d)).groupBy("distance").agg(F.count(F.lit(1)).alias("n"))


_SC = "SELECT report, term, max(1 / (1 + exp(-margin))) AS score FROM calls GROUP BY ALL"


def inner_scores(spark, d):
    inner = g.nodes(fx.edges(spark, d)).where("term not like 'P%'").crossJoin(F.broadcast(spark.range(200).withColumnRenamed("id", "report")))
    at = F.pmod(F.col("report") * 7 + F.length("term") * 13 + F.ascii(F.substring("term", -1, 1)), F.lit(10)) / 10.0
    return inner.select("report", "term", at.alias("score"))


def scores(spark, d):
    """Scores of leaves from the calls, of inner terms the mean of a fixed pattern of the report."""
    leaf = fx.calls(spark, d).groupBy("report", "term").agg(F.max(1 / (1 + F.exp(-F.col("margin")))).alias("score"))
    return leaf.unionByName(inner_scores(spark, d))


_ALLSC = f"{_SC} UNION ALL SELECT report, term, ((report * 7 + length(term) * 13 + ascii(right(term, 1))) % 10) / 10.0 AS score FROM nodes, range(200) r(report) WHERE term NOT LIKE 'P%'"
_R1 = "SELECT report, term, CAST('Infinity' AS DOUBLE) AS r FROM nodes, range(200) q(report) WHERE term LIKE 'R%'"


def _level(prev: str) -> str:
    return f"SELECT p.report, e.child AS term, max(least(p.r, coalesce(s.score, 0))) AS r FROM {prev} p JOIN edges e ON e.parent = p.term LEFT JOIN sc s ON s.report = p.report AND s.term = p.term GROUP BY ALL"


_WIDE = {"sc": _ALLSC, "r1": _R1, "r2": _level("r1"), "r3": _level("r2"), "r4": _level("r3"), "wide": "SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4"}


@query("widest_path_r", "r:d n:i", sql("SELECT least(r, 9) AS r, count(*) AS n FROM wide GROUP BY ALL", "calls", "edges", "nodes", **_WIDE))
def _(spark, d):
    return g.bottleneck(fx.edges(spark, d), scores(spark, d)).groupBy(F.least("r", F.lit(9.0)).alias("r")).agg(F.count(F.lit(1)).alias("n"))


_VIS = "SELECT w.report, w.term, w.r, s.score FROM wide w LEFT JOIN sc s ON s.report = w.report AND s.term = w.term"
_GR = "SELECT DISTINCT l_orderkey % 200 AS report, 'P' || l_partkey AS term FROM lineitem WHERE l_returnflag = 'R'"


@query("replay_grid", "tau_prune:d tau_accept:d visited:i predicted:i found:i",
       sql("SELECT tau_prune, tau_accept, count(*) AS visited, count_if(score >= tau_accept) AS predicted, count_if(score >= tau_accept AND g.term IS NOT NULL) AS found FROM vis v CROSS JOIN (SELECT unnest([0.1, 0.3, 0.5, 0.7]) AS tau_prune) CROSS JOIN (SELECT unnest([0.5, 0.9]) AS tau_accept) LEFT JOIN gr g ON g.report = v.report AND g.term = v.term WHERE r >= tau_prune AND v.term LIKE 'P%' GROUP BY ALL", "calls", "edges", "nodes", **_WIDE, vis=_VIS, gr=_GR))
def _(spark, d):
    """Every threshold pair from one widest-path pass: what is visited, predicted and found."""
    sc = scores(spark, d)
    wide = g.bottleneck(fx.edges(spark, d), sc).where("term like 'P%'").join(sc, ["report", "term"], "left")
    gold = fx.table(spark, d, "lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") % 200).alias("report"), fx.part("l_partkey").alias("term")).distinct().withColumn("y", F.lit(1))
    met = wide.join(gold, ["report", "term"], "left").withColumn("tau_prune", F.explode(F.array(*map(F.lit, (0.1, 0.3, 0.5, 0.7))))).where("r >= tau_prune")
    met = met.withColumn("tau_accept", F.explode(F.array(F.lit(0.5), F.lit(0.9))))
    yes = F.col("score") >= F.col("tau_accept")
    return met.groupBy("tau_prune", "tau_accept").agg(F.count(F.lit(1)).alias("visited"), F.count_if(yes).alias("predicted"), F.count_if(yes & F.col("y").isNotNull()).alias("found"))


@query("crc_threshold", "tau:d risk:d feasible:s",
       sql("SELECT tau, risk, n / (n + 1.0) * risk + 1 / (n + 1.0) <= 0.6 AS feasible FROM (SELECT tau, avg(miss) AS risk, count(*) AS n FROM (SELECT tau, report, 1 - avg(CASE WHEN r >= tau THEN 1.0 ELSE 0.0 END) AS miss FROM (SELECT g.report, coalesce(w.r, -1) AS r FROM gr g LEFT JOIN wide w ON w.report = g.report AND w.term = g.term) CROSS JOIN (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]) AS tau) GROUP BY ALL) GROUP BY tau)", "calls", "edges", "nodes", **_WIDE, gr=_GR))
def _(spark, d):
    """Conformal risk control: each threshold's mean miss rate and whether its corrected risk is within 0.6."""
    wide = g.bottleneck(fx.edges(spark, d), scores(spark, d))
    gold = fx.table(spark, d, "lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") % 200).alias("report"), fx.part("l_partkey").alias("term")).distinct()
    met = gold.join(wide, ["report", "term"], "left").select("report", F.coalesce("r", F.lit(-1.0)).alias("r"), F.explode(F.array(*[F.lit(i / 10) for i in range(1, 8)])).alias("tau"))
    per = met.groupBy("tau", "report").agg((1 - F.avg((F.col("r") >= F.col("tau")).cast("double"))).alias("miss"))
    risk = per.groupBy("tau").agg(F.avg("miss").alias("risk"), F.count(F.lit(1)).alias("n"))
    bound = F.col("n") / (F.col("n") + 1) * F.col("risk") + 1 / (F.col("n") + 1)
    return risk.select("tau", "risk", (bound <= 0.6).alias("feasible"))
