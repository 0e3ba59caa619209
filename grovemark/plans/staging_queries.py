"""Queries on staged blocks, rewordings, links, resumed work, and intervals over reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovemark.operators import linking
from grovemark.operators import staging as st
from grovemark.plans import fixtures as fx
from grovemark.plans.alignment_queries import _CV, _turns
from grovemark.plans.fixtures import sql
from grovemark.plans.registry import query
from grovemark.plans.source_queries import place
from grovemark.plans.text_queries import _IX, _ME, _PROBES, _SU, _BAG, _mentions, _surfaces
from grovemark.sources import resume

_TERM = r"array_to_string(list_transform(list_transform(string_split({}, chr(10)), lambda x: regexp_replace(x, '\s+$', '')), lambda x: CASE WHEN x <> '' AND NOT regexp_matches(x, '[.;:,!?]$') THEN x || ';' ELSE x END), chr(10))"
_BK = f"SELECT report, i AS segment, 'sentence_number: ' || i || ';' || chr(10) || {_TERM.format('t')} AS block FROM cv"
_BP = "SELECT *, coalesce(sum(length(block) + 1) OVER (PARTITION BY report ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM bk"


def _blocks(spark, d):
    return st.blocks(_turns(spark, d).select("report", F.col("i").alias("segment"), F.col("t").alias("reply")))


@query("staged_blocks", "report:i segment:i start:i finish:i digest:s", sql("SELECT report, segment, a AS start, a + length(block) AS finish, md5(block) AS digest FROM bp", cv=_CV, bk=_BK, bp=_BP))
def _(spark, d):
    """Replies as marked blocks, and where each lies in its report's staged text."""
    return _blocks(spark, d).select("report", "segment", "start", F.col("end").alias("finish"), F.md5("block").alias("digest"))


@query("staged_texts", "report:i n:i digest:s", sql("SELECT report, length(x) AS n, md5(x) AS digest FROM (SELECT report, string_agg(block, chr(10) ORDER BY a) AS x FROM bp GROUP BY report)", cv=_CV, bk=_BK, bp=_BP))
def _(spark, d):
    t = st.staged(_blocks(spark, d))
    return t.select("report", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query("attributed_hits", "report:i id:i segment:i", sql("SELECT report, segment AS id, CASE WHEN segment % 3 > 0 THEN segment END AS segment FROM bp", cv=_CV, bk=_BK, bp=_BP))
def _(spark, d):
    """A tagger's offsets back to segments; every third states another phrase than stands there."""
    b = _blocks(spark, d)
    phrase = F.when(F.col("segment") % 3 == 0, "other").otherwise("sente")
    hits = b.select("report", F.col("segment").alias("id"), F.col("start"), (F.col("start") + 5).alias("end"), phrase.alias("phrase"))
    return st.attributed(hits, b).select("report", "id", "segment")


@query("linked_sets", "report:i n_terms:i terms:s n_linked:i", "SELECT o.o_orderkey AS report, count(DISTINCT CASE WHEN ok THEN t END) AS n_terms, coalesce(string_agg(DISTINCT CASE WHEN ok THEN t END, ';' ORDER BY CASE WHEN ok THEN t END), '') AS terms, count(DISTINCT CASE WHEN ok THEN (s, t) END) AS n_linked FROM orders o LEFT JOIN (SELECT l_orderkey, 'P' || l_partkey AS t, l_linenumber AS s, l_tax <= 0.05 AND l_suppkey % 4 > 0 AS ok FROM lineitem) x ON x.l_orderkey = o.o_orderkey GROUP BY 1")
def _(spark, d):
    """Linked terms of every report, negated and unlinked hits left out."""
    li = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report"), F.col("l_linenumber").alias("segment"), F.when(F.col("l_suppkey") % 4 > 0, fx.part("l_partkey")).alias("term"), (F.col("l_tax") > 0.05).alias("negated"))
    n = st.linkage(li).groupBy("report").agg(F.count(F.lit(1)).alias("n_linked"))
    return st.predicted_sets(li, fx.reports(spark, d)).join(n, "report", "left").select("report", F.size("terms").alias("n_terms"), F.array_join("terms", ";").alias("terms"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))


_LK = "SELECT id, CASE WHEN a.term IS NOT NULL THEN 'exact' WHEN coalesce(b.term, c.term) IS NOT NULL THEN 'singular' WHEN e.term IS NOT NULL THEN 'bag' ELSE 'none' END AS route FROM pr LEFT JOIN ix a ON a.k = pr.k LEFT JOIN ix b ON b.k = k1 LEFT JOIN ix c ON c.k = k2 LEFT JOIN bg e ON e.k = k3"


@query("route_summary", "n_lines:i n_resolved:i on_label_rate:d n_exact:i n_singular:i n_bag:i n_none:i",
       sql("SELECT count(*) AS n_lines, count_if(route <> 'none') AS n_resolved, avg(CASE WHEN route = 'exact' THEN 1.0 ELSE 0 END) AS on_label_rate, count_if(route = 'exact') AS n_exact, count_if(route = 'singular') AS n_singular, count_if(route = 'bag') AS n_bag, count_if(route = 'none') AS n_none FROM lk", su=_SU, me=_ME, ix=_IX, pr=_PROBES, bg=f"SELECT {_BAG.format('k')} AS k, min(term) AS term FROM ix GROUP BY 1", lk=_LK))
def _(spark, d):
    """By which route the mentions were linked."""
    return st.route_summary(linking.link(_mentions(spark, d), _surfaces(spark, d)).withColumnRenamed("tier", "route"))


_NUM, _STOP, _LEM = {"1": "one", "2": "two", "3": "three"}, ("the", "of", "a"), {"parts": "part", "widgets": "widget"}
_WS = "SELECT p_partkey AS id, string_split(lower('The ' || p_size % 6 || ' parts of ' || p_type || ' ' || p_name), ' ') AS w FROM part"


def _worded(spark, d):
    t = F.concat(F.lit("The "), (F.col("p_size") % 6).cast("string"), F.lit(" parts of "), F.col("p_type"), F.lit(" "), F.col("p_name"))
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split(F.lower(t), " ").alias("words"))


@query("simplified_words", "id:i words:s key:s", sql("SELECT id, array_to_string(s, ' ') AS words, array_to_string(list_sort(list_transform(s, lambda x: CASE x WHEN 'parts' THEN 'part' WHEN 'widgets' THEN 'widget' ELSE x END)), ' ') AS key FROM (SELECT id, list_filter(list_transform(w, lambda x: CASE x WHEN '1' THEN 'one' WHEN '2' THEN 'two' WHEN '3' THEN 'three' ELSE x END), lambda x: x NOT IN ('the', 'of', 'a') AND TRY_CAST(x AS DOUBLE) IS NULL) AS s FROM ws)", ws=_WS))
def _(spark, d):
    """Words with numerals spelled out, without stop words and numbers, and their key of base forms."""
    w = _worded(spark, d).withColumn("s", st.simplified(F.col("words"), _NUM, _STOP))
    return w.select("id", F.array_join("s", " ").alias("words"), st.lemma_key(F.col("s"), _LEM).alias("key"))


@query("expanded_spans", "id:i variant:s how:s", sql("SELECT DISTINCT id, variant, how FROM (SELECT id, 'bulk ' || t AS variant, 'whole' AS how FROM sp WHERE k = 'x' || t UNION ALL SELECT id, array_to_string(list_transform(range(1, len(w) + 1), lambda j: CASE WHEN j = i THEN 'TYPE' ELSE w[j] END), ' '), 'word' FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM sp) WHERE w[i] IN (SELECT DISTINCT split_part(lower(p_type), ' ', 1) FROM part) AND len(w) > 1)", sp="SELECT p_partkey AS id, lower(p_type) AS t, '' AS k, string_split(lower(p_type || ' ' || p_name), ' ') AS w FROM part"))
def _(spark, d):
    """Spans reworded by a table: one word at a time, or the whole span."""
    p = fx.table(spark, d, "part")
    spans = p.select(F.col("p_partkey").alias("id"), F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), " ").alias("words"))
    single = p.select(F.split(F.lower("p_type"), " ")[0].alias("word")).distinct().withColumn("to", F.lit("TYPE"))
    whole = spark.createDataFrame([("no such key", "x")], "key string, to string")
    return st.expanded(spans, whole, single)


@query("inflected_patterns", "id:i pattern:s", r"SELECT p_partkey AS id, '\b' || array_to_string(list_transform(list_filter(regexp_split_to_array(p_type || ' ' || p_name, '\s+'), lambda w: w <> ''), lambda w: CASE WHEN length(w) >= 5 AND regexp_matches(w, '^[A-Za-z]+$') THEN left(w, length(w) - 2) || '[a-z]{0,4}' ELSE regexp_replace(w, '([^A-Za-z0-9])', '\\\1', 'g') END), '[\s\-]+') || '\b' AS pattern FROM part")
def _(spark, d):
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), st.inflected(F.concat_ws(" ", "p_type", "p_name")).alias("pattern"))


@query("find_phrases")
def _(spark, d):
    """Where a word of one turn stands in the other turns of its conversation, as written or inflected."""
    t = _turns(spark, d)
    w = F.try_element_at(F.regexp_extract_all("t", F.lit("[a-zA-Z]{5,}"), F.lit(0)), F.lit(1))
    phrases = t.where("i = 0").select("report", F.concat(F.lit("T"), F.col("report").cast("string")).alias("term"), w.alias("phrase")).where("phrase is not null")
    return st.find_phrases(t.select("report", F.col("i").alias("segment"), F.col("t").alias("text")), phrases)


@query("resumed_units", "n_units:i n_rows:i total:i n_logged:i", "SELECT count(DISTINCT o_custkey) AS n_units, count(DISTINCT o_custkey) AS n_rows, sum(o_custkey * 2) AS total, count(DISTINCT o_custkey) AS n_logged FROM (SELECT DISTINCT o_custkey FROM orders)")
def _(spark, d):
    """Work cut off after two of five batches and taken up again: every unit once."""
    path = place(spark)
    units = fx.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("unit"), F.col("o_custkey").alias("k")).distinct()
    log = resume.Checkpoint(spark, f"{path}/log")
    work = lambda part: part.select("unit", (F.col("k") * 2).alias("v"))
    resume.run(units, work, f"{path}/out", log, 5, most=2)
    resume.run(units, work, f"{path}/out", log, 5, resume.Stop(spark, flag=f"{path}/stop"))
    out = spark.read.parquet(f"{path}/out").agg(F.count_distinct("unit").alias("n_units"), F.count(F.lit(1)).alias("n_rows"), F.sum("v").alias("total"))
    return out.crossJoin(log.done().agg(F.count_distinct("unit").alias("n_logged")))


@query("committed_log", "key:i action:s n:i", "SELECT user_id AS key, arg_max(event_type, event_id) AS action, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    """Events appended in two parts; the table derived from the whole log is written anew at the second."""
    path = place(spark)
    e = fx.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("action"), F.col("event_id").alias("seq"))
    log = resume.EventLog(spark, f"{path}/log", "curator")
    log.append(e.where("seq % 2 = 0"))
    last = lambda rows: {"state": rows.groupBy("key").agg(F.max_by("action", "seq").alias("action"), F.count(F.lit(1)).alias("n"))}
    log.commit(e.where("seq % 2 = 1"), last, f"{path}/out", "key long, action string, seq long, event_id string, ts string, author string")
    return spark.read.csv(f"{path}/out/state", header=True).select(F.col("key").cast("long").alias("key"), "action", F.col("n").cast("long").alias("n"))
