"""Queries on cosine retrieval, fuzzy linking and placement."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovemark.operators import fuzzy, placement, vectors
from grovemark.plans import fixtures as fx
from grovemark.plans.fixtures import sql
from grovemark.plans.registry import query

_SIMS = "SELECT s.vec_id AS segment, c.term AS term, max(list_cosine_similarity(s.v, c.v)) AS sim FROM vectors s JOIN vectors c ON s.vec_id <> c.vec_id GROUP BY ALL"
_CEN = "SELECT term, list(x ORDER BY i) AS v FROM (SELECT term, i, avg(x) AS x FROM (SELECT term, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors) GROUP BY ALL) GROUP BY term"


def _sides(spark, d):
    v = fx.vectors(spark, d)
    return v.select(F.col("vec_id").alias("segment"), "v"), v.select(F.col("vec_id").alias("item"), F.col("term").cast("long").alias("term"), "v")


def _sims(spark, d):
    return vectors.pooled_max(*_sides(spark, d))


@query("cosine_pooled_max", "segment:i term:i sim:d", sql("SELECT * FROM sims", "vectors", sims=_SIMS))
def _(spark, d):
    """Every vector against the other vectors of every label."""
    return _sims(spark, d)


@query("topk_segments", "term:i rank:i segment:i sim:d",
       sql("SELECT * FROM (SELECT term, row_number() OVER (PARTITION BY term ORDER BY round(sim, 9) DESC, segment DESC) AS rank, segment, sim FROM sims) WHERE rank <= 5", "vectors", sims=_SIMS))
def _(spark, d):
    return vectors.best(_sims(spark, d), "term", "segment", 5, latest=True).select("term", "rank", "segment", "sim")


@query("segment_top_terms", "segment:i rank:i term:i sim:d",
       sql("SELECT * FROM (SELECT segment, row_number() OVER (PARTITION BY segment ORDER BY round(sim, 9) DESC, term) AS rank, term, sim FROM sims) WHERE rank <= 2", "vectors", sims=_SIMS))
def _(spark, d):
    return vectors.best(_sims(spark, d), "segment", "term", 2).select("segment", "rank", "term", "sim")


@query("term_max_sims", "term:i sim:d", sql("SELECT term, max(sim) AS sim FROM sims GROUP BY term", "vectors", sims=_SIMS))
def _(spark, d):
    return _sims(spark, d).groupBy("term").agg(F.max("sim").alias("sim"))


@query("union_closure_sims", "segment:i query:i sim:d",
       sql("SELECT segment, query, max(sim) AS sim FROM sims JOIN (SELECT DISTINCT q.term AS query, m.term AS term FROM vectors q JOIN (SELECT DISTINCT term FROM vectors) m ON m.term = q.term OR m.term = 2 * q.term + 1 OR m.term = 2 * q.term + 2) USING (term) GROUP BY ALL", "vectors", sims=_SIMS))
def _(spark, d):
    """The labels as a binary heap: a query's members are itself and its children."""
    t = _sides(spark, d)[1].select(F.col("term").alias("query")).distinct()
    members = t.select("query", F.explode(F.array_distinct(F.array(F.col("query"), 2 * F.col("query") + 1, 2 * F.col("query") + 2))).alias("term"))
    return vectors.union_over(_sims(spark, d), members)


@query("definition_hits", "segment:i rank:i term:i sim:d",
       sql("SELECT * FROM (SELECT segment, row_number() OVER (PARTITION BY segment ORDER BY round(sim, 9) DESC, term) AS rank, term, sim FROM (SELECT vec_id AS segment, c.term AS term, list_cosine_similarity(s.v, c.v) AS sim FROM vectors s CROSS JOIN cen c) WHERE sim >= 0.45) WHERE rank <= 3", "vectors", cen=_CEN))
def _(spark, d):
    """Each vector's best labels by the labels' mean vectors, above a floor."""
    segments, context = _sides(spark, d)
    means = vectors.centroids(context).withColumn("item", -1 - F.col("term"))
    sims = vectors.pooled_max(segments, means.select("item", "term", "v"))
    return vectors.best(sims.where("sim >= 0.45"), "segment", "term", 3).select("segment", "rank", "term", "sim")


@query("term_search_fuzzy", "id:i term:s score:d")
def _(spark, d):
    """Names of parts that lack their third letter against the names as they are."""
    p = fx.table(spark, d, "part")
    asked = p.select(F.col("p_partkey").alias("id"), F.concat(F.substring("p_name", 1, 2), F.expr("substr(p_name, 4)")).alias("mention"))
    return fuzzy.fuzzy(asked, p.select(F.concat(F.lit("N:"), "p_name").alias("term"), F.col("p_name").alias("surface")))


_LINES = "SELECT doc_id, i - 1 AS segment_idx, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


def _placed(spark, d):
    docs = fx.table(spark, d, "documents")
    return placement.place(placement.line_ranges(docs, "doc_id", "text"), placement.matches(docs, "doc_id", "text", "[0-9]+"), "doc_id")


@query("span_placement", "doc_id:i ordinal:i segment_idx:i matched:s length:i",
       sql("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY segment_idx, j) - 1 AS ordinal, segment_idx, m AS matched, length(m) AS length FROM (SELECT doc_id, segment_idx, unnest(regexp_extract_all(line, '[0-9]+')) AS m, generate_subscripts(regexp_extract_all(line, '[0-9]+'), 1) AS j FROM lines)", lines=_LINES))
def _(spark, d):
    """Runs of digits placed by their offsets in the whole text; what is returned is cut from the text at these offsets."""
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    cut = F.expr("substr(text, cast(start + 1 as int), cast(stop - start as int))")
    return _placed(spark, d).drop("matched").join(docs, "doc_id").select("doc_id", "ordinal", "segment_idx", cut.alias("matched"), (F.col("stop") - F.col("start")).alias("length"))


@query("repair_density", "doc_id:i segment_idx:i n:i", sql("SELECT doc_id, segment_idx, len(regexp_extract_all(line, '[0-9]+')) AS n FROM lines WHERE regexp_matches(line, '[0-9]')", lines=_LINES))
def _(spark, d):
    return placement.density(_placed(spark, d), "doc_id")
