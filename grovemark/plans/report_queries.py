"""Queries on the tables that a study reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovemark.functions.replies import share
from grovemark.operators import graph as g
from grovemark.operators import quality as q
from grovemark.operators import reports as rp
from grovemark.plans import fixtures as fx
from grovemark.plans.fixtures import div, prf_sql, sql
from grovemark.plans.registry import query

_P = prf_sql()
_MIXG = "SELECT report, term FROM gold UNION SELECT l_orderkey, 'S' || l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 5 = 0"
_WD = "SELECT o_orderkey AS report, o_custkey % 400 AS words FROM orders"


def _mixed_gold(spark, d):
    s = fx.table(spark, d, "lineitem").where("l_returnflag = 'R' and l_partkey % 5 = 0").select(F.col("l_orderkey").alias("report"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("term"))
    return fx.gold(spark, d).union(s).distinct()


_Q3 = lambda c, t: ", ".join(f"quantile_cont({c}, {v}) AS {n}" for v, n in ((0.25, f"{t}_q1"), (0.5, f"{t}_median"), (0.75, f"{t}_q3")))


@query("cohort_statistics", "n_reports:i n_empty:i n_pairs:i n_terms:i terms_per_report:d terms_per_nonempty:d depth_q1:d depth_median:d depth_q3:d n_parent_child:i n_ancestor_descendant:i singleton_share:d words_q1:d words_median:d words_q3:d words_mean:d",
       sql(f"SELECT a.*, b.*, c.*, e.*, f.*, h.*, n_reports - n_nonempty AS n_empty, CAST(n_pairs AS DOUBLE) / n_reports AS terms_per_report, CAST(n_pairs AS DOUBLE) / n_nonempty AS terms_per_nonempty FROM (SELECT count(*) AS n_pairs, count(DISTINCT term) AS n_terms, count(DISTINCT report) AS n_nonempty FROM mg) a, (SELECT count(*) AS n_reports, {_Q3('words', 'words')}, avg(words) AS words_mean FROM wd) b, (SELECT {_Q3('depth', 'depth')} FROM mg JOIN depth ON depth.term = mg.term) c, (SELECT count(*) AS n_parent_child FROM mg JOIN edges ON child = mg.term SEMI JOIN mg y ON y.report = mg.report AND y.term = parent) e, (SELECT count(*) AS n_ancestor_descendant FROM mg JOIN closed ON descendant = mg.term AND hops > 0 SEMI JOIN mg y ON y.report = mg.report AND y.term = ancestor) f, (SELECT 100 * avg(CASE WHEN n = 1 THEN 1.0 ELSE 0 END) AS singleton_share FROM (SELECT count(*) AS n FROM mg GROUP BY term)) h", "gold", "edges", "closed", "depth", mg=_MIXG, wd=_WD))
def _(spark, d):
    words = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("report"), (F.col("o_custkey") % 400).alias("words"))
    closed = fx.closed(spark, d)
    return rp.cohort_statistics(_mixed_gold(spark, d), words, fx.edges(spark, d), closed, g.depths(fx.edges(spark, d), closed))


_DF = "SELECT coalesce(a.report, b.report) AS report, coalesce(a.term, b.term) AS term, CASE WHEN a.term = b.term THEN 'kept' WHEN a.term IS NULL THEN 'added' ELSE 'removed' END AS change FROM gold a FULL JOIN pred_b b ON a.report = b.report AND a.term = b.term"


@query("gold_diff", "report:i term:s change:s", sql(_DF, "gold", "pred_b"))
def _(spark, d):
    return rp.gold_diff(fx.gold(spark, d), fx.pred_b(spark, d))


@query("reannotation_statistics", "kept:i added:i removed:i n_union:i jaccard:d", sql(f"SELECT *, {div('kept', 'n_union')} AS jaccard FROM (SELECT count_if(change = 'kept') AS kept, count_if(change = 'added') AS added, count_if(change = 'removed') AS removed, count(*) AS n_union FROM df)", "gold", "pred_b", df=_DF))
def _(spark, d):
    return rp.reannotation(rp.gold_diff(fx.gold(spark, d), fx.pred_b(spark, d)))


@query("curation_drops", "criterion:s n:i", "SELECT CASE WHEN l_returnflag IN ('N', 'A') THEN 'not confirmed' ELSE 'confirmed' END AS criterion, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    return rp.drop_counts(fx.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("reason")), {"N": "not confirmed", "A": "not confirmed", "R": "confirmed"})


@query("status_counts", "status:s n:i", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return fx.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


_SPREAD = "SELECT count(c) AS n, sum(c) AS total, avg(c) AS mean, median(c) AS median, quantile_cont(c, 0.95) AS p95, min(c) AS low, max(c) AS high FROM (SELECT report, count(*) AS c FROM calls GROUP BY 1)"


@query("calls_per_report", "n:i total:i mean:d median:d p95:d low:i high:i", sql(_SPREAD, "calls"))
def _(spark, d):
    """The spread of cached calls over reports."""
    return rp.spread(fx.calls(spark, d).groupBy("report").agg(F.count(F.lit(1)).alias("c")), "c")


_MS = "SELECT (exp(margin) + 1) / (exp(margin) + 1 + exp(rank * 0.3 - 2)) AS mass FROM calls"


@query("captured_mass", "low:d p5:d median:d mean:d below_0:d below_1:d below_2:d below_3:d", sql("SELECT min(mass) AS low, quantile_cont(mass, 0.05) AS p5, median(mass) AS median, avg(mass) AS mean, avg(CASE WHEN mass < 0.5 THEN 1.0 ELSE 0 END) AS below_0, avg(CASE WHEN mass < 0.8 THEN 1.0 ELSE 0 END) AS below_1, avg(CASE WHEN mass < 0.9 THEN 1.0 ELSE 0 END) AS below_2, avg(CASE WHEN mass < 0.95 THEN 1.0 ELSE 0 END) AS below_3 FROM ms", "calls", ms=_MS))
def _(spark, d):
    """How much of the probability the two answers hold over all calls."""
    from grovemark.functions.scalars import captured_mass

    m, rest = F.col("margin"), F.col("rank") * 0.3 - 2
    mass = captured_mass(m, F.lit(0.0), F.log(F.exp(m) + 1 + F.exp(rest)))
    return rp.captured(fx.calls(spark, d).select(mass.alias("mass")), (0.5, 0.8, 0.9, 0.95))


_SG = "1 / (1 + exp(-margin))"


@query("replay_fidelity", "n:i gap:d report:i term:s", sql(f"SELECT count(*) AS n, max(gap) AS gap, arg_min(report, (-gap, report, term)) AS report, arg_min(term, (-gap, report, term)) AS term FROM (SELECT report, term, round(abs(max({_SG}) - avg({_SG})), 12) AS gap FROM calls GROUP BY ALL)", "calls"))
def _(spark, d):
    """Where two ways of pooling differ most."""
    from grovemark.functions.codes import sigmoid

    pool = lambda f: fx.calls(spark, d).groupBy("report", "term").agg(f(sigmoid(F.col("margin"))).alias("score"))
    return rp.greatest_gap(pool(F.max), pool(F.avg), ("report", "term"), "score")


@query("scorer_check", "n:i gap:d", "SELECT count(*) AS n, 0.0 AS gap FROM (SELECT DISTINCT vec_id FROM embeddings)")
def _(spark, d):
    """Two ways of the same cosine, of every vector with its neighbour in id, agree to five digits."""
    v = fx.vectors(spark, d).groupBy("vec_id").agg(F.min("v").alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot("v", "v"))
    unit = v.withColumn("u", F.transform("v", lambda x: F.try_divide(x, norm)))
    a = unit.select("vec_id", (dot("v", "u") / norm).alias("score"))
    b = unit.select("vec_id", dot("u", "u").alias("score"))
    return rp.greatest_gap(a, b, ("vec_id",), "score").select("n", F.round("gap", 5).alias("gap"))


_UCL = "SELECT DISTINCT x.report, c.ancestor AS term FROM {} x JOIN closed c ON c.descendant = x.term"
_H = "SELECT report, count_if(a AND b) AS tp, count_if(b AND NOT a) AS fp, count_if(a AND NOT b) AS fn FROM (SELECT coalesce(x.report, y.report) AS report, x.term IS NOT NULL AS a, y.term IS NOT NULL AS b FROM {} x FULL JOIN {} y ON x.report = y.report AND x.term = y.term) GROUP BY report"
_AVG = "SELECT avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _P.items()) + " FROM {})"
_SIM = {
    "anc": "SELECT c.descendant, c.ancestor, l.depth FROM closed c JOIN long_depth l ON c.ancestor = l.term", "gp": "SELECT p.report, p.term AS a, g.term AS b FROM pred p JOIN gold g ON p.report = g.report", "ab": "SELECT DISTINCT a, b FROM gp",
    "lcs": "SELECT ab.a, ab.b, max(x.depth) AS d FROM ab JOIN anc x ON x.descendant = ab.a JOIN anc y ON y.descendant = ab.b AND x.ancestor = y.ancestor GROUP BY ALL",
    "sims": f"SELECT gp.report, gp.a, gp.b, {div('2 * coalesce(lcs.d, 0)', '(da.depth + db.depth)')} AS sim FROM gp LEFT JOIN lcs ON gp.a = lcs.a AND gp.b = lcs.b JOIN long_depth da ON da.term = gp.a JOIN long_depth db ON db.term = gp.b",
    "soft": f"SELECT avg(p) AS precision, avg(r) AS recall, avg({div('2 * p * r', '(p + r)')}) AS f1 FROM (SELECT k.report, coalesce(x.p, 0) AS p, coalesce(y.r, 0) AS r FROM (SELECT report FROM gold UNION SELECT report FROM pred) k LEFT JOIN (SELECT report, avg(s) AS p FROM (SELECT report, a, max(sim) AS s FROM sims GROUP BY ALL) GROUP BY 1) x ON x.report = k.report LEFT JOIN (SELECT report, avg(s) AS r FROM (SELECT report, b, max(sim) AS s FROM sims GROUP BY ALL) GROUP BY 1) y ON y.report = k.report)",
    "ug": _UCL.format("gold"), "up": _UCL.format("pred"), "ex": _AVG.format("(" + _H.format("gold", "pred") + ")"), "cl": _AVG.format("(" + _H.format("ug", "up") + ")"),
}


@query("graded_quality", "kind:s precision:d recall:d f1:d tax:d", sql("SELECT *, f1 - (SELECT f1 FROM ex) AS tax FROM (SELECT 'exact' AS kind, * FROM ex UNION ALL SELECT 'soft', * FROM soft UNION ALL SELECT 'closure', * FROM cl)", "gold", "pred", "closed", "long_depth", **_SIM))
def _(spark, d):
    """Exact, similarity-weighted and closure quality on the mean of reports, and what each adds to exact F1."""
    y, p, closed = fx.gold(spark, d), fx.pred(spark, d), fx.closed(spark, d)
    mean = lambda t: t.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    per = lambda u: mean(u.select(*q.prf(F.col("tp"), F.col("fp"), F.col("fn"))))
    return rp.graded(per(q.flat_units(y, p)), mean(g.soft_prf(y, p, closed, g.longest_depths(fx.edges(spark, d)))), per(g.h_counts(y, p, closed)))


@query("binary_classification", "n:i accuracy:d precision:d recall:d f1:d false_pos:i false_neg:i", f"SELECT n, {div('n - false_pos - false_neg', 'n')} AS accuracy, {div('tp', '(tp + false_pos)')} AS precision, {div('tp', '(tp + false_neg)')} AS recall, {div('2 * tp', '(2 * tp + false_pos + false_neg)')} AS f1, false_pos, false_neg FROM (SELECT count(*) AS n, count_if(y AND p) AS tp, count_if(NOT y AND p) AS false_pos, count_if(y AND NOT p) AS false_neg FROM (SELECT o_orderstatus IN ('F', 'P') AS y, o_custkey % 3 = 0 AS p FROM orders))")
def _(spark, d):
    return rp.binary(fx.table(spark, d, "orders").select(F.col("o_orderstatus").isin("F", "P").alias("y"), (F.col("o_custkey") % 3 == 0).alias("p")))


_U = "SELECT r.report, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM reports r LEFT JOIN units u ON r.report = u.report"
_RR = f"SELECT n_reports, {', '.join(f'{v} AS {k}' for k, v in _P.items())}, {div('tp + fp', 'n_reports')} AS predictions_per_report, macro_precision, macro_recall, macro_f1 FROM (SELECT count(*) AS n_reports, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM (SELECT tp, fp, fn, {', '.join(f'CASE WHEN tp + fp + fn = 0 THEN 1 ELSE {v} END AS {k}' for k, v in _P.items())} FROM ({_U})))"


@query("result_row", "n_reports:i precision:d recall:d f1:d predictions_per_report:d macro_precision:d macro_recall:d macro_f1:d", sql(_RR, "units", "reports"))
def _(spark, d):
    return rp.result_row(fx.gold(spark, d), fx.pred(spark, d), fx.reports(spark, d))


# Rows of a results table: micro F1 of three systems on two halves of the reports.
_SYS = {"wide": "l_quantity >= 25", "narrow": "l_quantity >= 40", "other": "l_discount >= 0.05"}
_CORE = "SELECT method, cohort, seq, " + div("2 * tp", "(n + g)") + " AS f1, " + div("tp", "g") + " AS recall, n AS cost FROM (SELECT s.method, s.cohort, s.seq, s.n, s.tp, y.g FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS method, p.report % 2 AS cohort, {i} AS seq, count(*) AS n, count(y.term) AS tp FROM (SELECT DISTINCT l_orderkey AS report, 'P' || l_partkey AS term FROM lineitem WHERE {w}) p LEFT JOIN gold y ON y.report = p.report AND y.term = p.term GROUP BY 2" for i, (m, w) in enumerate(_SYS.items())) + ") s JOIN (SELECT report % 2 AS cohort, count(*) AS g FROM gold GROUP BY 1) y ON y.cohort = s.cohort)"


def core(spark, d):
    """method, cohort, seq, f1, recall, cost."""
    y, li, out = fx.gold(spark, d), fx.table(spark, d, "lineitem"), None
    size = y.groupBy((F.col("report") % 2).alias("cohort")).agg(F.count(F.lit(1)).alias("g"))
    for i, (name, where) in enumerate(_SYS.items()):
        p = li.where(where).select(F.col("l_orderkey").alias("report"), fx.part("l_partkey").alias("term")).distinct().join(y.withColumn("y", F.lit(1)), ["report", "term"], "left")
        n = p.groupBy((F.col("report") % 2).alias("cohort")).agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("tp")).select(F.lit(name).alias("method"), "cohort", F.lit(i).alias("seq"), "n", "tp")
        out = n if out is None else out.unionByName(n)
    return out.join(F.broadcast(size), "cohort").select("method", "cohort", "seq", q.ratio(2 * F.col("tp"), F.col("n") + F.col("g")).alias("f1"), q.ratio(F.col("tp"), F.col("g")).alias("recall"), F.col("n").alias("cost"))


@query("main_results", "method:s cohort:i f1:d main:s", sql("SELECT method, cohort, f1, row_number() OVER (PARTITION BY cohort ORDER BY f1 DESC, seq) = 1 AS main FROM core_", "gold", core_=_CORE))
def _(spark, d):
    return rp.main_result(core(spark, d), ("cohort",), "f1", "seq").select("method", "cohort", "f1", "main")


@query("placeholder_rows", "method:s cohort:i f1:d reason:s", sql("SELECT method, cohort, f1, NULL AS reason FROM core_ WHERE method <> 'other' OR cohort = 0 UNION ALL SELECT 'other', 1, NULL, 'not run' UNION ALL SELECT 'absent', c, NULL, 'not run' FROM range(2) x(c)", "gold", core_=_CORE))
def _(spark, d):
    rows = core(spark, d).where("method <> 'other' or cohort = 0").select("method", "cohort", "f1")
    names = spark.createDataFrame([(m,) for m in (*_SYS, "absent")], "method string")
    expected = names.crossJoin(spark.range(2).select(F.col("id").alias("cohort")))
    return rp.with_placeholders(rows, expected, ("method", "cohort"), "not run")


@query("recall_cost_pareto", "method:s cost:i recall:d frontier:s", sql("SELECT method, cost, recall, coalesce(recall > max(recall) OVER (ORDER BY cost, recall DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS frontier FROM core_ WHERE cohort = 0", "gold", core_=_CORE))
def _(spark, d):
    """Which systems no cheaper one matches in recall."""
    return rp.pareto(core(spark, d).where("cohort = 0").select("method", "cost", "recall"), "cost", "recall")


@query("cohort_deltas", "method:s f1_a:d f1_b:d f1_delta:d", sql("SELECT a.method, a.f1 AS f1_a, b.f1 AS f1_b, b.f1 - a.f1 AS f1_delta FROM core_ a JOIN core_ b ON a.method = b.method AND a.cohort = 0 AND b.cohort = 1", "gold", core_=_CORE))
def _(spark, d):
    """Every method's rows under two conditions side by side."""
    rows = core(spark, d).withColumn("under", F.when(F.col("cohort") == 0, "a").otherwise("b"))
    return rp.side_by_side(rows, "method", "under", "a", "b", ("f1",))


@query("flat_metrics", "name:s value:d", sql("SELECT method || '.f1' AS name, f1 AS value FROM core_ WHERE cohort = 0 UNION ALL SELECT method || '.recall', recall FROM core_ WHERE cohort = 0", "gold", core_=_CORE))
def _(spark, d):
    return rp.long_metrics(core(spark, d).where("cohort = 0").select("method", "f1", "recall"), "method")


_FL = "SELECT o_orderkey % 3 AS k, o_custkey % 2 AS cohort, count(*) AS n_files, sum(CASE WHEN o_orderkey % 3 = 1 THEN 0 ELSE 1 END) AS n_rows, count_if(o_orderstatus = 'P') AS n_stale FROM orders WHERE o_orderkey % 3 <> 2 GROUP BY ALL"


@query("availability", "k:i cohort:i status:s n_files:i problems:s", sql("SELECT e.k, e.cohort, CASE WHEN f.k IS NULL THEN 'missing' WHEN n_rows = 0 THEN 'empty' ELSE 'present' END AS status, coalesce(n_files, 0) AS n_files, concat_ws('; ', CASE WHEN f.k IS NULL THEN 'no file' END, CASE WHEN n_rows = 0 THEN 'no row' END, CASE WHEN n_stale > 0 THEN n_stale || ' stale' END) AS problems FROM (SELECT k, cohort FROM range(3) a(k), range(2) b(cohort)) e LEFT JOIN fl f ON f.k = e.k AND f.cohort = e.cohort", fl=_FL))
def _(spark, d):
    """Which cells of a study have results, and what is wrong with them."""
    expected = spark.range(3).select(F.col("id").alias("k")).crossJoin(spark.range(2).select(F.col("id").alias("cohort")))
    k = F.col("o_orderkey") % 3
    found = fx.table(spark, d, "orders").where(k != 2).select(k.alias("k"), (F.col("o_custkey") % 2).alias("cohort"), F.when(k == 1, 0).otherwise(1).alias("n_rows"), (F.col("o_orderstatus") == "P").alias("stale"))
    return rp.availability(expected, found, ("k", "cohort"))


_FN = "SELECT 'calls_' || o_custkey % 50 || CASE o_orderkey % 3 WHEN 0 THEN '_s1of2_' WHEN 1 THEN '_s2of2_' ELSE '_' END || 'x.jsonl' AS name, max(o_orderkey) AS mtime FROM orders WHERE NOT (o_custkey % 50 < 5 AND o_orderkey % 3 = 2) GROUP BY 1"


@query("stale_shards", "base:s n_shards:i merged:s stale:s", sql("SELECT base, count_if(shard) AS n_shards, count_if(NOT shard) > 0 AS merged, coalesce(max(mtime) FILTER (shard) > max(mtime) FILTER (NOT shard), true) AS stale FROM (SELECT *, regexp_replace(name, '_s[0-9]+of[0-9]+_', '_') AS base, regexp_matches(name, '_s[0-9]+of[0-9]+_') AS shard FROM fn_) GROUP BY base HAVING count_if(shard) > 0", fn_=_FN))
def _(spark, d):
    k = F.col("o_orderkey") % 3
    o = fx.table(spark, d, "orders").where(~((F.col("o_custkey") % 50 < 5) & (k == 2)))
    name = F.concat(F.lit("calls_"), (F.col("o_custkey") % 50).cast("string"), F.when(k == 0, "_s1of2_").when(k == 1, "_s2of2_").otherwise("_"), F.lit("x.jsonl"))
    return rp.stale_shards(o.groupBy(name.alias("name")).agg(F.max("o_orderkey").alias("mtime")))


@query("complete_timing", "report:i total:d", "SELECT report, total FROM (SELECT l_orderkey AS report, sum(l_extendedprice) AS total, count(DISTINCT l_linenumber) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1) WHERE n = 3")
def _(spark, d):
    """Sums of reports that have all three of their parts."""
    return rp.complete_sums(fx.table(spark, d, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("report"), F.col("l_linenumber").alias("m"), F.col("l_extendedprice").alias("v")), "report", "m", "v", 3)


@query("cost_sources", "report:i source:i seconds:d", "SELECT o_orderkey AS report, CASE WHEN o_orderkey % 2 = 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 5 = 0 THEN 2 END AS source, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice WHEN o_orderkey % 3 = 0 THEN o_custkey WHEN o_orderkey % 5 = 0 THEN 1 END AS seconds FROM orders")
def _(spark, d):
    """The first source that states a cost, and which it was."""
    k = F.col("o_orderkey")
    x = rp.first_of(F.when(k % 2 == 0, F.col("o_totalprice")), F.when(k % 3 == 0, F.col("o_custkey").cast("double")), F.when(k % 5 == 0, F.lit(1.0)))
    return fx.table(spark, d, "orders").select(k.alias("report"), x.alias("x")).select("report", "x.source", F.col("x.value").alias("seconds"))


_CR = "SELECT l_linenumber AS arm, CAST(l_quantity AS BIGINT) AS bag, sum(count(*)) OVER (PARTITION BY l_linenumber ORDER BY l_quantity) / CAST(sum(count(*)) OVER (PARTITION BY l_linenumber) AS DOUBLE) AS hit FROM lineitem GROUP BY l_linenumber, l_quantity"


@query("cost_to_match", "arm:i bag:d", sql("SELECT arm, arg_min(CASE WHEN ph IS NULL OR ph >= 0.4 THEN bag ELSE pb + (0.4 - ph) / (hit - ph) * (bag - pb) END, bag) AS bag FROM (SELECT *, lag(hit) OVER w AS ph, lag(bag) OVER w AS pb FROM cr WINDOW w AS (PARTITION BY arm ORDER BY bag)) WHERE hit >= 0.4 GROUP BY arm", cr=_CR))
def _(spark, d):
    """The size at which each arm first reaches a hit rate of 0.4, between its points."""
    from pyspark.sql.window import Window

    n = fx.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("arm"), F.col("l_quantity").cast("long").alias("bag")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("arm")
    pts = n.select("arm", F.col("bag").cast("double").alias("bag"), (F.sum("k").over(w.orderBy("bag").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("k").over(w)).alias("hit"))
    return rp.crossing(pts, "arm", "bag", "hit", 0.4)


@query("chunked_names", "name:s chunk:i", "SELECT p_name || p_partkey AS name, (row_number() OVER (ORDER BY p_name || p_partkey) - 1) // 7 AS chunk FROM part")
def _(spark, d):
    return rp.chunked(fx.table(spark, d, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("name")), 7)


@query("variant_rows", "policy:s n:i added:i removed:i", sql("SELECT policy, count(x.term) AS n, count_if(y.term IS NULL) AS added, (SELECT count(*) FROM gold) - count(y.term) AS removed FROM (SELECT DISTINCT 'loose' AS policy, l_orderkey AS report, 'P' || l_partkey AS term FROM lineitem WHERE l_returnflag IN ('R', 'A') UNION ALL SELECT DISTINCT 'strict', l_orderkey, 'P' || l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_tax < 0.05) x LEFT JOIN gold y ON y.report = x.report AND y.term = x.term GROUP BY policy", "gold"))
def _(spark, d):
    """Size of the gold under other policies, and what they add and remove."""
    li, y = fx.table(spark, d, "lineitem"), fx.gold(spark, d)
    out = None
    for name, where in (("loose", "l_returnflag in ('R', 'A')"), ("strict", "l_returnflag = 'R' and l_tax < 0.05")):
        diff = rp.gold_diff(y, li.where(where).select(F.col("l_orderkey").alias("report"), fx.part("l_partkey").alias("term")))
        n = diff.agg(F.count_if(F.col("change") != "removed").alias("n"), F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed")).select(F.lit(name).alias("policy"), "n", "added", "removed")
        out = n if out is None else out.unionByName(n)
    return out


@query("drop_reason_rows", "reason:s source:i n:i in_gold:i", "SELECT l_returnflag AS reason, l_suppkey % 3 AS source, count(*) AS n, count_if(l_returnflag = 'R') AS in_gold FROM lineitem GROUP BY ALL")
def _(spark, d):
    return fx.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("reason"), (F.col("l_suppkey") % 3).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("in_gold"))


@query("evidence_segments", "report:i term:s segments:s", "SELECT l_orderkey % 200 AS report, 'P' || l_partkey AS term, string_agg(DISTINCT l_linenumber, ',' ORDER BY l_linenumber) AS segments FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL")
def _(spark, d):
    e = fx.table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy((F.col("l_orderkey") % 200).alias("report"), fx.part("l_partkey").alias("term")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("s"))
    return e.select("report", "term", F.array_join(F.col("s").cast("array<string>"), ",").alias("segments"))


_CS = "SELECT l_orderkey % 200 AS report, 'P' || l_partkey AS term, l_linenumber AS segment, l_returnflag = 'R' AND l_tax >= 0.03 AS evidence, row_number() OVER (PARTITION BY l_orderkey % 200, l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_extendedprice) AS rank FROM lineitem"


@query("hit_at_s", "s:i n_defined:i n_hit:i rate:d", sql("SELECT s, count(*) AS n_defined, count_if(h) AS n_hit, avg(CASE WHEN h THEN 1.0 ELSE 0 END) AS rate FROM (SELECT c.report, c.term, s, bool_or(c.rank <= s AND e.segment IS NOT NULL) AS h FROM cs c JOIN (SELECT DISTINCT report, term FROM cs WHERE evidence) d ON d.report = c.report AND d.term = c.term LEFT JOIN (SELECT DISTINCT report, term, segment FROM cs WHERE evidence) e ON e.report = c.report AND e.term = c.term AND e.segment = c.segment CROSS JOIN (SELECT unnest([1, 2, 4]) AS s) GROUP BY ALL) GROUP BY s", cs=_CS))
def _(spark, d):
    """Whether the best s segments of a pair hold one of its evidence segments; pairs without evidence are undefined."""
    from pyspark.sql.window import Window

    li = fx.table(spark, d, "lineitem")
    w = Window.partitionBy("report", "term").orderBy(F.desc("l_quantity"), "l_orderkey", "segment", "l_extendedprice")
    c = li.select((F.col("l_orderkey") % 200).alias("report"), fx.part("l_partkey").alias("term"), F.col("l_linenumber").alias("segment"), ((F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.03)).alias("evidence"), "l_quantity", "l_orderkey", "l_extendedprice").withColumn("rank", F.row_number().over(w))
    per = c.groupBy("report", "term").agg(F.collect_set(F.when(F.col("evidence"), F.col("segment"))).alias("e"), F.array_sort(F.collect_list(F.struct("rank", "segment"))).alias("r")).where(F.size("e") > 0)
    at = per.withColumn("s", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))))
    hit = F.arrays_overlap(F.transform(F.slice("r", F.lit(1), F.col("s")), lambda x: x.segment), F.col("e"))
    return at.groupBy("s").agg(F.count(F.lit(1)).alias("n_defined"), F.count_if(hit).alias("n_hit"), F.avg(hit.cast("double")).alias("rate"))


@query("sentence_masks", "report:i segment:i term:i mask:i", sql("SELECT report, segment, term, bit_or(CAST(1 AS BIGINT) << CAST(juror AS BIGINT)) AS mask FROM detections GROUP BY ALL", "detections"))
def _(spark, d):
    return fx.detections(spark, d).groupBy("report", "segment", "term").agg(F.bit_or(F.expr("shiftleft(1L, cast(juror as int))")).alias("mask"))


_WI = "SELECT g.report, g.term, a.term IS NOT NULL AS a, b.term IS NOT NULL AS b FROM gold g LEFT JOIN pred a ON a.report = g.report AND a.term = g.term LEFT JOIN pred_b b ON b.report = g.report AND b.term = g.term"


@query("witnesses", "cell:s n:i n_reports:i", sql("SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_a' WHEN b THEN 'only_b' ELSE 'neither' END AS cell, count(*) AS n, count(DISTINCT report) AS n_reports FROM wi GROUP BY 1", "gold", "pred", "pred_b", wi=_WI))
def _(spark, d):
    """Gold pairs by which of two systems finds them."""
    has = lambda t, n: t.select("report", "term").distinct().withColumn(n, F.lit(True))
    m = fx.gold(spark, d).join(has(fx.pred(spark, d), "a"), ["report", "term"], "left").join(has(fx.pred_b(spark, d), "b"), ["report", "term"], "left")
    cell = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "only_a").when(F.col("b"), "only_b").otherwise("neither")
    return m.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("report").alias("n_reports"))


_SB = "SELECT DISTINCT l_orderkey AS report, 'P' || l_partkey AS term, l_linenumber % 3 AS label FROM lineitem WHERE l_tax >= 0.04"


@query("subgroup_audit", "label:i n_in:i n_out:i n_shared:i", sql("SELECT s.label, count(g.term) AS n_in, count_if(g.term IS NULL) AS n_out, count_if(o.n > 1) AS n_shared FROM sb s LEFT JOIN gold g ON g.report = s.report AND g.term = s.term JOIN (SELECT report, term, count(*) AS n FROM sb GROUP BY ALL) o ON o.report = s.report AND o.term = s.term GROUP BY s.label", "gold", sb=_SB))
def _(spark, d):
    """Labelled pairs inside and outside the gold, and those that carry more than one label."""
    s = fx.table(spark, d, "lineitem").where("l_tax >= 0.04").select(F.col("l_orderkey").alias("report"), fx.part("l_partkey").alias("term"), (F.col("l_linenumber") % 3).alias("label")).distinct()
    n = s.groupBy("report", "term").agg(F.count(F.lit(1)).alias("n"))
    m = s.join(n, ["report", "term"]).join(fx.gold(spark, d).withColumn("y", F.lit(1)), ["report", "term"], "left")
    return m.groupBy("label").agg(F.count("y").alias("n_in"), F.count_if(F.col("y").isNull()).alias("n_out"), F.count_if(F.col("n") > 1).alias("n_shared"))


@query("cells_of_index", "idx:i prompt:i model:i", "SELECT p_partkey AS idx, p_partkey // 6 % 5 AS prompt, p_partkey % 6 AS model FROM part")
def _(spark, d):
    """A cell's number as prompt and model, prompt first."""
    k = F.col("p_partkey")
    return fx.table(spark, d, "part").select(k.alias("idx"), (F.floor(k / 6) % 5).alias("prompt"), (k % 6).alias("model"))


@query("thresholds_of_names", "name:s tau_prune:d tau_accept:d", "SELECT DISTINCT 'tau_p' || printf('%.2f', l_discount) || '_a' || printf('%.2f', l_tax) AS name, round(l_discount, 2) AS tau_prune, round(l_tax, 2) AS tau_accept FROM lineitem")
def _(spark, d):
    """The two thresholds that a folder's name states."""
    name = F.concat(F.lit("tau_p"), F.format_string("%.2f", "l_discount"), F.lit("_a"), F.format_string("%.2f", "l_tax"))
    n = fx.table(spark, d, "lineitem").select(name.alias("name")).distinct()
    at = lambda i: F.regexp_extract("name", r"p([0-9.]+)_a([0-9.]+)", i).cast("double")
    return n.select("name", at(1).alias("tau_prune"), at(2).alias("tau_accept"))


@query("merge_productivity", "juror:i segments:i votes:i", sql("SELECT a.juror, a.n AS segments, coalesce(b.n, 0) AS votes FROM (SELECT juror, count(DISTINCT (report, segment)) AS n FROM detections GROUP BY 1) a LEFT JOIN (SELECT juror, count(*) AS n FROM detections d SEMI JOIN gold_d g ON g.report = d.report AND g.term = d.term WHERE juror <> 3 GROUP BY 1) b ON b.juror = a.juror", "detections", "gold_d"))
def _(spark, d):
    """Two tables of the jurors joined, 0 where the second has no row."""
    det = fx.detections(spark, d)
    a = det.groupBy("juror").agg(F.count_distinct("report", "segment").alias("segments"))
    b = det.where("juror <> 3").join(fx.gold_d(spark, d).distinct(), ["report", "term"], "left_semi").groupBy("juror").agg(F.count(F.lit(1)).alias("votes"))
    return a.join(b, "juror", "left").na.fill(0, ["votes"])


@query("attribution_rows", "report:i n_missed:i n_unnamed:i share:d", sql(f"SELECT g.report, count_if(p.term IS NULL) AS n_missed, count_if(p.term IS NULL AND b.term IS NULL) AS n_unnamed, {div('count_if(p.term IS NULL AND b.term IS NULL)', 'count_if(p.term IS NULL)')} AS share FROM gold g LEFT JOIN pred p ON p.report = g.report AND p.term = g.term LEFT JOIN pred_b b ON b.report = g.report AND b.term = g.term GROUP BY g.report", "gold", "pred", "pred_b"))
def _(spark, d):
    """Missed gold by report, and how much of it no system names."""
    has = lambda t, n: t.select("report", "term").distinct().withColumn(n, F.lit(1))
    m = fx.gold(spark, d).join(has(fx.pred(spark, d), "p"), ["report", "term"], "left").join(has(fx.pred_b(spark, d), "b"), ["report", "term"], "left")
    missed, unnamed = F.count_if(F.col("p").isNull()), F.count_if(F.col("p").isNull() & F.col("b").isNull())
    return m.groupBy("report").agg(missed.alias("n_missed"), unnamed.alias("n_unnamed")).withColumn("share", share(F.col("n_unnamed"), F.col("n_missed")))
