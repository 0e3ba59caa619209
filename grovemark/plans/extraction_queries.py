"""Queries on extraction from texts to predictions, with stand-ins for its two models, and on its prompts and indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovemark.operators import extraction as x
from grovemark.plans import fixtures as fx
from grovemark.plans.alignment_queries import _CV, _turns
from grovemark.plans.fixtures import sql
from grovemark.plans.registry import query

_LB = """SELECT 'P' || p_partkey AS term, p_type || ' ' || p_name AS label, p_brand AS definition FROM part UNION ALL SELECT 'S' || s_suppkey, s_name, '' FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, n_name, NULL FROM nation UNION ALL SELECT 'R' || r_regionkey, r_name, NULL FROM region"""


def _terms(spark, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("term")
    null = F.lit(None).cast("string").alias("definition")
    p = fx.table(spark, d, "part").select(name("P", "p_partkey"), F.concat_ws(" ", "p_type", "p_name").alias("label"), F.col("p_brand").alias("definition"))
    s = fx.table(spark, d, "supplier").select(name("S", "s_suppkey"), F.col("s_name").alias("label"), F.lit("").alias("definition"))
    n = fx.table(spark, d, "nation").select(name("N", "n_nationkey"), F.col("n_name").alias("label"), null)
    return p.union(s).union(n).union(fx.table(spark, d, "region").select(name("R", "r_regionkey"), F.col("r_name").alias("label"), null))


_VEC = r"list_transform(range(8), lambda j: CAST(len(list_filter(list_filter(regexp_split_to_array({0}, '[ \t\n\r\f\v]+'), lambda w: w <> ''), lambda w: length(w) % 8 = j)) AS DOUBLE))"
_UNIT = "list_transform(v, lambda a: CASE WHEN list_sum(list_transform(v, lambda b: b * b)) > 0 THEN a / sqrt(list_sum(list_transform(v, lambda b: b * b))) ELSE 0 END)"
_SV = f"SELECT report, i, t, {_UNIT} AS u FROM (SELECT *, {_VEC.format('t')} AS v FROM cv)"
_TV = f"SELECT term, label, definition, {_UNIT} AS u FROM (SELECT *, {_VEC.format('concat_ws(chr(32), label, definition)')} AS v FROM (SELECT * FROM lb SEMI JOIN nodes USING (term)))"
_NR = "SELECT report, term, i, label, definition, t, row_number() OVER (PARTITION BY report, term ORDER BY c DESC, i) AS rank FROM (SELECT s.report, k.term, s.i, k.label, k.definition, s.t, round(list_sum(list_transform(list_zip(s.u, k.u), lambda p: p[1] * p[2])), 9) AS c FROM sv s, tv k) QUALIFY rank <= 3"
_LEN = len(x.TEMPLATE.replace("{label}", "").replace("{definition}", "").replace("{sent}", ""))
_MG = f"SELECT report, term, max(1 / (1 + exp(-(({_LEN} + length(label) + length(coalesce(definition, '')) + length(t)) % 17 / 4.0 - 2.0)))) AS score, count(*) AS n_calls FROM nr GROUP BY ALL"
_REACH = "SELECT DISTINCT report, term FROM cv, nodes WHERE term LIKE 'R%' UNION SELECT w.report, e.child FROM walk w JOIN mg ON mg.report = w.report AND mg.term = w.term AND mg.score >= 0.7 JOIN edges e ON e.parent = w.term"
_X = {"cv": _CV, "lb": _LB, "sv": _SV, "tv": _TV, "nr": _NR, "mg": _MG, "walk": _REACH}


def _run(spark, d):
    segments = _turns(spark, d).select("report", F.col("i").cast("int").alias("segment_idx"), F.col("t").alias("segment"))
    return x.extract_counted(segments, _terms(spark, d), fx.edges(spark, d), "P%", s=3, tau_prune=0.7)


@query("tree_extract", "report:i n_visited:i n_expanded:i n_accepted:i n_calls:i insertions:i",
       sql("SELECT w.report, count(*) AS n_visited, count_if(score >= 0.7) AS n_expanded, count_if(score >= 0.85) AS n_accepted, sum(n_calls) AS n_calls, coalesce(sum(CASE WHEN score >= 0.7 THEN k.n END), 0) AS insertions FROM walk w JOIN mg ON mg.report = w.report AND mg.term = w.term LEFT JOIN (SELECT parent, count(*) AS n FROM edges GROUP BY 1) k ON k.parent = w.term GROUP BY w.report", "nodes", **_X))
def _(spark, d):
    """Extraction from the conversations down the test graph: what each report's walk visited, opened, accepted and asked."""
    return _run(spark, d).summary(0.85)


@query("tree_predictions", "tau:d n:i n_reports:i", sql("SELECT tau, count(*) AS n, count(DISTINCT w.report) AS n_reports FROM walk w JOIN mg ON mg.report = w.report AND mg.term = w.term CROSS JOIN (SELECT CAST(unnest([0.75, 0.85]) AS DOUBLE) AS tau) WHERE score >= tau AND w.term LIKE 'P%' GROUP BY tau", "nodes", **_X))
def _(spark, d):
    """Predictions at two acceptance thresholds from one walk."""
    r, out = _run(spark, d), None
    for tau in (0.75, 0.85):
        p = r.accepted(tau).where("n > 0").select(F.lit(tau).alias("tau"), "n", "n_reports")
        out = p if out is None else out.unionByName(p)
    return out


@query("tree_depth_table", "level:i n_visited:i n_expanded:i n_calls:i", sql("SELECT CASE left(w.term, 1) WHEN 'R' THEN 1 WHEN 'N' THEN 2 WHEN 'S' THEN 3 ELSE 4 END AS level, count(*) AS n_visited, count_if(score >= 0.7) AS n_expanded, sum(n_calls) AS n_calls FROM walk w JOIN mg ON mg.report = w.report AND mg.term = w.term GROUP BY 1", "nodes", **_X))
def _(spark, d):
    return _run(spark, d).by_depth()


@query("prompts", "id:i n_chars:i digest:s", f"SELECT p_partkey AS id, length(p) AS n_chars, md5(p) AS digest FROM (SELECT p_partkey, replace(replace(replace('{x.TEMPLATE}', '{{label}}', p_type || ' ' || p_name), '{{definition}}', CASE WHEN p_size > 25 THEN p_brand ELSE '' END), '{{sent}}', p_name) AS p FROM part)")
def _(spark, d):
    """A template filled in; a term without a definition leaves its place empty."""
    p = x.render(x.TEMPLATE, label=F.concat_ws(" ", "p_type", "p_name"), definition=F.when(F.col("p_size") > 25, F.col("p_brand")), sent=F.col("p_name"))
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), p.alias("p")).select("id", F.length("p").alias("n_chars"), F.md5("p").alias("digest"))


@query("term_texts", "term:s text:s", "SELECT 'P' || p_partkey AS term, concat_ws(' ', p_name, CASE WHEN p_size > 25 THEN p_brand END, CASE WHEN p_type <> p_name THEN p_type END) AS text FROM part")
def _(spark, d):
    """A term's label, definition and those synonyms that differ from the label, in one text."""
    syn = F.filter(F.array("p_type", "p_name"), lambda s: s != F.col("p_name"))
    t = F.concat_ws(" ", F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_brand")), F.array_join(syn, " "))
    return fx.table(spark, d, "part").select(fx.part("p_partkey").alias("term"), F.trim(t).alias("text"))


@query("surface_links", "id:i term:s cosine:d accepted:s",
       sql(f"SELECT p_partkey AS id, arg_min(k.term, (-c, k.term)) AS term, max(c) AS cosine, max(c) >= 0.98 AS accepted FROM (SELECT p.p_partkey, k.term, round(list_sum(list_transform(list_zip(p.u, k.u), lambda z: z[1] * z[2])), 9) AS c FROM (SELECT p_partkey, {_UNIT} AS u FROM (SELECT p_partkey, {_VEC.format('p_name')} AS v FROM part)) p, (SELECT * FROM tv WHERE term LIKE 'S%' OR term LIKE 'N%') k) k GROUP BY 1", "nodes", lb=_LB, tv=_TV))
def _(spark, d):
    """Every distinct string encoded once and linked to the surface of greatest cosine, accepted from 0.98 on; rejected links
    are kept."""
    names = fx.table(spark, d, "part").select(F.col("p_partkey").alias("report"), F.col("p_name").alias("s"))
    strings = x.vectors(names.select("s").distinct(), "s", x.word_lengths)
    known = fx.edges(spark, d).select(F.col("child").alias("term")).union(fx.edges(spark, d).select("parent")).distinct()
    surfaces = _terms(spark, d).where("term like 'S%' or term like 'N%'").join(known, "term", "left_semi").withColumn("text", F.concat_ws(" ", "label", "definition"))
    # The strings are one block of queries against all surfaces; each group is one block.
    block = F.pmod(F.xxhash64("s"), F.lit(16))
    front = strings.select(block.alias("report"), F.col("s").alias("term"), "vector")
    idx = x.vectors(surfaces, "text", x.word_lengths).withColumn("place", F.dense_rank().over(_by_term()))
    copies = idx.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("report"), F.col("place").cast("int").alias("segment_idx"), "vector")
    best = x.best_segments(front, copies, 1).select(F.col("term").alias("s"), F.col("segment_idx").alias("place"), "cosine")
    linked = best.join(F.broadcast(idx.select("term", F.col("place").cast("int").alias("place"))), "place")
    return names.join(linked, "s").select(F.col("report").alias("id"), "term", "cosine", (F.col("cosine") >= 0.98).alias("accepted"))


def _by_term():
    from pyspark.sql.window import Window

    return Window.orderBy("term")
