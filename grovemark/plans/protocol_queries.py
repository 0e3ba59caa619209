"""Queries on the protocol's curves, folds, candidate sets and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovemark.operators import protocol
from grovemark.plans import fixtures as fx
from grovemark.plans.fixtures import sql
from grovemark.plans.registry import query
from grovemark.plans.traversal_queries import _draw

_TAUS = [0.1, 0.3, 0.5, 0.7, 0.9]
_TSQL = f"(SELECT unnest({_TAUS}) AS tau)"
_CURVE = "SELECT conf, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER () AS a FROM (SELECT conf, count(*) AS n, sum(label) AS pos FROM sample GROUP BY conf) WINDOW w AS (ORDER BY conf DESC)"


@query("pr_curve", "threshold:d precision:d recall:d", sql("SELECT conf AS threshold, CAST(tp AS DOUBLE) / k AS precision, CAST(tp AS DOUBLE) / a AS recall FROM cu", "sample", cu=_CURVE))
def _(spark, d):
    return protocol.pr_curve(fx.sample(spark, d)).drop("step")


@query("average_precision", "ap:d", sql("SELECT sum(CAST(pos AS DOUBLE) / a * tp / k) AS ap FROM cu", "sample", cu=_CURVE))
def _(spark, d):
    return protocol.pr_curve(fx.sample(spark, d)).agg(F.sum(F.col("step") * F.col("precision")).alias("ap"))


@query("selective_report", "tau:d coverage:d risk:d generalized:d",
       sql(f"SELECT tau, avg(CASE WHEN conf >= tau THEN 1.0 ELSE 0 END) AS coverage, avg(CASE WHEN conf >= tau THEN 1.0 - label END) AS risk, avg(CASE WHEN conf >= tau THEN 1.0 - label ELSE 0 END) AS generalized FROM sample CROSS JOIN {_TSQL} GROUP BY tau", "sample"))
def _(spark, d):
    return protocol.selective(fx.sample(spark, d), _TAUS)


@query("miss_loss_curve", "tau:d risk:d",
       sql(f"SELECT tau, sum(loss) / (SELECT count(*) FROM reports) AS risk FROM (SELECT tau, report, avg(CASE WHEN score >= tau THEN 0.0 ELSE 1.0 END) AS loss FROM (SELECT g.report, p.score FROM gold g LEFT JOIN pred p ON g.report = p.report AND g.term = p.term) CROSS JOIN {_TSQL} GROUP BY ALL) GROUP BY tau", "gold", "pred", "reports"))
def _(spark, d):
    scored = fx.gold(spark, d).join(fx.pred(spark, d), ["report", "term"], "left").select("report", "score")
    return protocol.loss_curve(scored, fx.reports(spark, d), _TAUS)


@query("query_set", "report:i query:s hops:i", sql("SELECT report, ancestor AS query, min(hops) AS hops FROM gold JOIN closed ON term = descendant GROUP BY ALL", "gold", "closed"))
def _(spark, d):
    return protocol.query_set(fx.gold(spark, d), fx.closed(spark, d))


@query("true_path_relevance", "query:s n_reports:i n_segments:i",
       sql("SELECT query, count(DISTINCT report) AS n_reports, count(*) AS n_segments FROM (SELECT DISTINCT l_orderkey AS report, ancestor AS query, l_linenumber AS segment FROM lineitem JOIN closed ON 'P' || l_partkey = descendant WHERE l_returnflag = 'R') GROUP BY query", "closed"))
def _(spark, d):
    a = fx.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("report"), fx.part("l_partkey").alias("term"), F.col("l_linenumber").alias("segment"))
    r = protocol.relevance(a, fx.closed(spark, d)).groupBy("query", "report").agg(F.count(F.lit(1)).alias("n"))
    return r.groupBy("query").agg(F.count(F.lit(1)).alias("n_reports"), F.sum("n").alias("n_segments"))


@query("frequency_buckets", "term:s bucket:s",
       sql("SELECT p.term, coalesce(CAST(b AS VARCHAR), 'unseen') AS bucket FROM (SELECT 'P' || p_partkey AS term FROM part) p LEFT JOIN (SELECT term, ntile(4) OVER (ORDER BY n, term) AS b FROM (SELECT term, count(*) AS n FROM gold GROUP BY term)) f ON f.term = p.term", "gold"))
def _(spark, d):
    return protocol.frequency_buckets(fx.gold(spark, d), fx.table(spark, d, "part").select(fx.part("p_partkey").alias("term")))


@query("term_search_tiers", "query:s place:i term:s tier:i",
       sql("""SELECT query, place, term, tier FROM (SELECT query, term, tier, row_number() OVER (PARTITION BY query ORDER BY tier, length(label), label, term) AS place
  FROM (SELECT query, term, label, min(CASE WHEN s = query THEN 2 * kind WHEN starts_with(s, query) THEN 2 * kind + 1 ELSE kind + 4 END) AS tier FROM q JOIN st ON contains(s, query) GROUP BY ALL)) WHERE place <= 10""",
           st="SELECT 'P' || p_partkey AS term, p_name AS label, unnest([lower(p_name), lower(p_type || ' ' || p_brand)]) AS s, unnest([0, 1]) AS kind FROM part",
           q="SELECT DISTINCT unnest([string_split(lower(p_name), ' ')[2], lower(p_name), lower(p_type)]) AS query FROM part"))
def _(spark, d):
    """Names, their second words and kinds of parts, looked up among names and, as synonyms, kinds with brands."""
    p = fx.table(spark, d, "part")
    asked = p.select(F.explode(F.array(F.get(F.split(F.lower("p_name"), " "), F.lit(1)), F.lower("p_name"), F.lower("p_type"))).alias("query"))
    return protocol.search(asked, p.select(fx.part("p_partkey").alias("term"), F.col("p_name").alias("label")), p.select(fx.part("p_partkey").alias("term"), F.concat("p_type", F.lit(" "), "p_brand").alias("synonym")))


@query("nested_folds", "repetition:i outer_fold:i inner_fold:i role:s n:i",
       sql(f"SELECT repetition, outer_fold, CASE WHEN own = outer_fold THEN -1 ELSE {_draw('report', '((repetition + 1) * 1000 + outer_fold)')} % 5 END AS inner_fold, CASE WHEN own = outer_fold THEN 'eval' ELSE 'train' END AS role, count(*) AS n FROM (SELECT report, repetition, {_draw('report', 'repetition')} % 5 AS own FROM reports CROSS JOIN range(3) r(repetition)) CROSS JOIN range(5) o(outer_fold) GROUP BY ALL", "reports"))
def _(spark, d):
    f = protocol.nested_folds(fx.reports(spark, d), 5, 5, 3)
    return f.groupBy("repetition", "outer_fold", "inner_fold", "role").agg(F.count(F.lit(1)).alias("n"))
