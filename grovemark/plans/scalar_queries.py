"""Queries on expressions over replies, ids, margins, nodes and costs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovemark.functions import replies as r
from grovemark.functions import scalars as s
from grovemark.operators import graph, text
from grovemark.plans import fixtures as fx
from grovemark.plans.fixtures import sql
from grovemark.plans.registry import query
from grovemark.plans.text_queries import _STRIP

_L = {k: f"'{v}'" for k, v in enumerate(("<think>a</think> ", "  Yes, ", r"so \boxed{ Yes } ", "No phenotype found in ", "None.", '{"findings": []}', "N/A"))}
_RW = "SELECT conv_id, turn, CASE k WHEN 0 THEN " + _L[0] + " || t WHEN 1 THEN " + _L[1] + " || t WHEN 2 THEN " + _L[2] + " || t WHEN 3 THEN " + _L[3] + " || t WHEN 4 THEN " + _L[4] + " WHEN 5 THEN " + _L[5] + " WHEN 6 THEN " + _L[6] + " WHEN 7 THEN t || ' Yes' ELSE t END AS text FROM (SELECT *, (conv_id + turn) % 9 AS k, coalesce(text, '') AS t FROM conversations)"
_BARE = rf"trim(regexp_replace(regexp_replace(lower({_STRIP}), '[^a-z0-9/ ]', '', 'g'), '\s+', ' ', 'g'))"


def _marked(spark, d):
    """Turns with marks that ask, decline or answer, planted by conversation and turn."""
    t, k = F.coalesce("text", F.lit("")), (F.col("conv_id") + F.col("turn")) % 9
    put = lambda n: F.lit(_L[n][1:-1])
    m = F.when(k == 0, F.concat(put(0), t)).when(k == 1, F.concat(put(1), t)).when(k == 2, F.concat(put(2), t)).when(k == 3, F.concat(put(3), t)).when(k == 4, put(4)).when(k == 5, put(5)).when(k == 6, put(6)).when(k == 7, F.concat(t, F.lit(" Yes"))).otherwise(t)
    return fx.table(spark, d, "conversations").select("conv_id", "turn", m.alias("text"))


@query("reply_flags", "conv_id:i turn:i reasoned:s boxed:s starts_yes:s has_yes:s wrote:s",
       sql(rf"SELECT conv_id, turn, contains(lower(text), '<think>') AS reasoned, regexp_matches(text, '\\boxed\{{[^}}]*\}}', 'i') AS boxed, starts_with(lower(regexp_replace(text, '^\s+', '')), 'yes') AS starts_yes, contains(text, 'Yes') AS has_yes, text <> '' AND bare NOT IN ({', '.join(repr(x) for x in r.DECLINED)}) AND NOT ({' OR '.join(f'contains(bare, {x!r})' for x in r.DECLINING)}) AS wrote FROM (SELECT *, {_BARE} AS bare FROM rw)", rw=_RW))
def _(spark, d):
    t = F.col("text")
    return _marked(spark, d).select("conv_id", "turn", r.has_reasoning(t).alias("reasoned"), r.has_boxed(t).alias("boxed"), r.starts_with_yes(t).alias("starts_yes"), r.contains_yes(t).alias("has_yes"), r.wrote(t).alias("wrote"))


_LAYOUT = "CASE p_partkey % 6 WHEN 0 THEN 'plain' WHEN 1 THEN 'two_column' WHEN 2 THEN 'pipe_first' WHEN 3 THEN 'json' WHEN 4 THEN 'sentence' ELSE 'free' END"
_N = "p_type || ' ' || p_name"
_RP = f"""SELECT p_partkey AS id, {_LAYOUT} AS layout, {_N} AS source, CASE p_partkey % 6 WHEN 0 THEN '- ' || p_name || chr(10) || chr(10) || ' 2. ' || {_N} WHEN 1 THEN p_name || ' => ' || {_N} || chr(10) || 'no ' || p_name
  WHEN 2 THEN '* ' || {_N} || '| ' || p_brand || chr(10) || 'Plain. Prose' WHEN 3 THEN '{{"term": "' || {_N} || '", ''term'' : ''' || p_name || ''', ' WHEN 4 THEN 'It is not ' || p_name || '. It is ' || p_type ELSE p_name || chr(10) || 'normal' END AS text FROM part"""


def _layouts(spark, d):
    k, n = F.col("p_partkey") % 6, F.concat_ws(" ", "p_type", "p_name")
    c = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) and y not in ("p_name", "p_type", "p_brand") else F.col(y) if isinstance(y, str) else y for y in x])
    layout = F.when(k == 0, "plain").when(k == 1, "two_column").when(k == 2, "pipe_first").when(k == 3, "json").when(k == 4, "sentence").otherwise("free")
    t = F.when(k == 0, c("- ", "p_name", "\n\n 2. ", n)).when(k == 1, c("p_name", " => ", n, "\nno ", "p_name")).when(k == 2, c("* ", n, "| ", "p_brand", "\nPlain. Prose"))
    t = t.when(k == 3, c('{"term": "', n, "\", 'term' : '", "p_name", "', ")).when(k == 4, c("It is not ", "p_name", ". It is ", "p_type")).otherwise(c("p_name", "\nnormal"))
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), layout.alias("layout"), n.alias("source"), t.alias("text"))


_LINES = r"list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(regexp_replace(x, '^\s*(?:[-*•]|\d+[.)])\s*', ''))), lambda x: x <> '')"
_TERMS = r"""regexp_extract_all({0}, '["'']term["'']\s*:\s*["'']([^"'']+)["'']', 1)"""
_CAND = "CASE layout WHEN 'two_column' THEN [CASE WHEN strpos({0}, '=>') > 0 THEN substr({0}, strpos({0}, '=>') + 2) ELSE {0} END] WHEN 'pipe_first' THEN [split_part({0}, '|', 1)] WHEN 'json' THEN " + _TERMS + " ELSE [{0}] END"
_LN = f"SELECT id, layout, unnest(l) AS line, unnest(range(len(l))) AS line_index FROM (SELECT id, layout, {_LINES.format('text')} AS l FROM rp)"


@query("reply_terms", "id:i line_index:i candidate:s", sql(f"SELECT id, line_index, unnest({_CAND.format('line')}) AS candidate FROM ln", rp=_RP, ln=_LN))
def _(spark, d):
    """Every candidate term of every line; a layout decides which part of a line it is."""
    lines = _layouts(spark, d).select("id", "layout", F.posexplode(r.output_lines(F.col("text"))).alias("line_index", "line"))
    return lines.select("id", "line_index", F.explode(r.term_candidates(F.col("line"), F.col("layout"))).alias("candidate"))


_W = r"list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[-_\"''\\\t\r\n]', ' ', 'g'), '\s+'), lambda w: w <> '')"
_NEG = "[" + ", ".join(f"'{x}'" for x in r.NEGATIONS) + "]"
_KEPT = r"NOT regexp_matches(line, '^\s*\d+[.)]\s+') AND (layout <> 'pipe_first' OR contains(line, '|')) AND (layout <> 'two_column' OR contains(line, '=>')) AND len(list_filter(c, lambda p: len(" + _W.format("p") + r") > 12 OR regexp_matches(p, '[.!?;]\s+\S'))) = 0"
_RATES = f"""SELECT layout, count(*) AS n, sum(n_lines) AS n_lines, avg(CASE WHEN layout <> 'sentence' THEN exactness END) AS exactness, avg(traps) AS traps, avg(CASE layout WHEN 'free' THEN 1 WHEN 'sentence' THEN CASE WHEN n_lines = 1 THEN 1 ELSE 0 END WHEN 'json' THEN CASE WHEN n_terms > 0 THEN 1 ELSE 0 END ELSE kept END) AS compliance FROM (
  SELECT x.id, layout, count(*) AS n_lines, avg(CASE WHEN len(list_intersect({_W.format('line')}, {_NEG})) > 0 THEN 1.0 ELSE 0 END) AS traps, avg(CASE WHEN {_KEPT} THEN 1.0 ELSE 0 END) AS kept, sum(len({_TERMS.format('line')})) AS n_terms, coalesce(max(e.exactness), 0) AS exactness
  FROM x LEFT JOIN (SELECT id, avg(CASE WHEN k.key IS NOT NULL THEN 1.0 ELSE 0 END) AS exactness FROM (SELECT id, array_to_string(list_sort({_W.format('cand')}), ' ') AS key FROM (SELECT id, unnest(c) AS cand FROM x)) q LEFT JOIN known k ON k.key = q.key GROUP BY id) e ON e.id = x.id GROUP BY x.id, layout) GROUP BY layout"""


@query("reply_rates", "layout:s n:i n_lines:i exactness:d traps:d compliance:d",
       sql(_RATES, rp=_RP, ln=_LN, x=f"SELECT *, {_CAND.format('line')} AS c FROM ln", known=f"SELECT DISTINCT array_to_string(list_sort({_W.format('p_type || chr(32) || p_name')}), ' ') AS key FROM part WHERE p_partkey % 3 < 2"))
def _(spark, d):
    """Per layout the means over replies: share of candidates that are known phrases, of lines that negate, and of lines that
    keep to the layout. Prose has no candidates, so its exactness is null."""
    lines = _layouts(spark, d).where(r.wrote(F.col("text"))).select("id", "layout", F.posexplode(r.output_lines(F.col("text"))).alias("line_index", "line"))
    lines = lines.withColumn("words", text.words(F.col("line"))).withColumn("cand", r.term_candidates(F.col("line"), F.col("layout")))
    known = fx.table(spark, d, "part").where("p_partkey % 3 < 2").select(F.array_join(F.array_sort(text.words(F.concat_ws(" ", "p_type", "p_name"))), " ").alias("key")).distinct().withColumn("hit", F.lit(1))
    cands = lines.select("id", "line_index", F.posexplode_outer("cand").alias("pos", "c")).withColumn("w", text.words(F.col("c"))).withColumn("key", F.array_join(F.array_sort("w"), " "))
    met = cands.join(known, "key", "left")
    exact = met.where("c is not null").groupBy("id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("exactness"))
    counts = met.groupBy("id", "line_index").agg(F.collect_list(F.size("w")).alias("counts"))
    kept = lines.join(counts, ["id", "line_index"]).withColumn("kept", r.keeps_layout(F.col("line"), F.col("cand"), F.col("counts"), F.col("layout")))
    per = kept.groupBy("id", "layout").agg(F.collect_list("line").alias("lines"), F.collect_list("words").alias("words"), F.collect_list("kept").alias("kept")).join(exact, "id", "left")
    per = per.select("layout", F.size("lines").alias("n"), F.when(F.col("layout") != "sentence", F.coalesce("exactness", F.lit(0.0))).alias("exactness"), r.negation_rate(F.col("words")).alias("traps"), r.compliance(F.col("lines"), F.col("kept"), F.col("layout")).alias("compliance"))
    return per.groupBy("layout").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("n_lines"), *[F.avg(c).alias(c) for c in ("exactness", "traps", "compliance")])


_CELL = "SELECT l_orderkey AS id, l_linenumber AS slot, l_linenumber * 1000000 + l_partkey AS number, CASE l_linenumber WHEN 1 THEN 'HP' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') WHEN 2 THEN 'HP:HP:' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') || ',HP:0000001' WHEN 3 THEN ' hp ' || l_partkey WHEN 4 THEN l_partkey || '.75' WHEN 5 THEN 'No\\tterm' || chr(10) || chr(10) || ' found' WHEN 6 THEN l_partkey || 'q' ELSE 'a' || chr(13) || chr(10) || 'b' END AS cell FROM lineitem"


def _cells(spark, d):
    n, p = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    padded = F.lpad(p, 7, "0")
    cell = F.when(n == 1, F.concat(F.lit("HP"), padded)).when(n == 2, F.concat(F.lit("HP:HP:"), padded, F.lit(",HP:0000001"))).when(n == 3, F.concat(F.lit(" hp "), p)).when(n == 4, F.concat(p, F.lit(".75"))).when(n == 5, F.lit("No\\tterm\n\n found")).when(n == 6, F.concat(p, F.lit("q"))).otherwise("a\r\nb")
    return fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), n.alias("slot"), cell.alias("cell"))


@query("id_cells", "id:i slot:i colon:s single:s ids:s digits:s number:s digit:s whole:i flat:s plain:s line:s key:s",
       sql(r"""SELECT id, slot, CASE WHEN contains(cell, ':') OR length(cell) <= 2 THEN cell ELSE cell[:2] || ':' || cell[3:] END AS colon,
  CASE WHEN starts_with(trim(replace(cell, 'HP:HP:', 'HP:')), 'HP:') THEN trim(replace(cell, 'HP:HP:', 'HP:')) END AS single, array_to_string(regexp_extract_all(replace(cell, 'HP:HP:', 'HP:'), 'HP:[0-9]+'), ';') AS ids,
  CASE WHEN regexp_matches(regexp_replace(regexp_replace(lower(cell), '[^0-9a-z]', '', 'g'), '^hp', ''), '^[0-9]+$') THEN regexp_replace(regexp_replace(lower(cell), '[^0-9a-z]', '', 'g'), '^hp', '') END AS digits,
  TRY_CAST(trim(cell) AS DOUBLE) IS NOT NULL AS number, regexp_matches(cell, '[0-9]') AS digit, CAST(trunc(TRY_CAST(trim(cell) AS DOUBLE)) AS BIGINT) AS whole, trim(regexp_replace(cell, '\s+', ' ', 'g')) AS flat,
  regexp_replace(cell, '\\[tnr]', ' ', 'g') AS plain, translate(cell, chr(13) || chr(10), '  ') AS line, 'src|' || id || '|' || cell || CASE WHEN slot > 1 THEN '|' || slot ELSE '' END AS key FROM cell_""", cell_=_CELL))  # fmt: skip
def _(spark, d):
    c = F.col("cell")
    slot = F.when(F.col("slot") > 1, F.col("slot"))
    return _cells(spark, d).select(
        "id", "slot", s.with_colon(c).alias("colon"), s.single_prefix(c).alias("single"), F.array_join(s.ids_in(c), ";").alias("ids"), s.id_digits(c).alias("digits"), s.is_number(c).alias("number"),
        s.has_digit(c).alias("digit"), s.whole_or_null(c).alias("whole"), s.flattened(c).alias("flat"), s.unescaped_blanks(c).alias("plain"), s.one_line(c).alias("line"), s.target_key(F.lit("src"), F.col("id"), c, slot).alias("key"),
    )


@query("event_stamps", "event_id:i stamp:s", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def _(spark, d):
    return fx.table(spark, d, "events").select("event_id", s.utc_stamp(F.col("ts")).alias("stamp"))


_MG = "SELECT l_orderkey AS id, l_linenumber AS n, l_discount * 9 AS tau, l_tax * 5 AS tau_cache, (l_quantity - 25) / 5 AS yes, (l_linenumber - 3) / 2.0 AS no, CASE l_linenumber % 6 WHEN 0 THEN 'P0' WHEN 5 THEN 'LR' ELSE 'P' || l_linenumber % 6 END AS pooling FROM lineitem"


@query("margin_scalars", "id:i n:i needed:d supported:s mass:d gate:d hit:d",
       sql("""SELECT id, n, -ln(1 - tau) / (1 - ln(1 - tau)) AS needed, pooling <> 'LR' AND (pooling <> 'P0' OR tau_cache <= 0.5) AND tau_cache <= -ln(1 - tau) / (1 - ln(1 - tau)) + 1e-15 AS supported,
  (exp(yes) + exp(no)) / (exp(yes) + exp(no) + exp(0.5)) AS mass, 1 / (1 + exp(-(-0.5 + 0.2 * (CASE WHEN n = 7 THEN 5.0 ELSE n END) - 0.1 * ln(1 + n * 10) + 0.3 * yes + CASE WHEN n = 7 THEN 0.4 ELSE 0 END))) AS gate, 1 - power(1 - tau, n) AS hit FROM mg""", mg=_MG))  # fmt: skip
def _(spark, d):
    """Scalars on a call's margins: the cache threshold that a replay needs and whether a cache meets it, the mass of the two
    answers, the logistic gate over a node's features, and the chance that one of n passes."""
    n = F.col("l_linenumber")
    rows = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), n.alias("n"), (F.col("l_discount") * 9).alias("tau"), (F.col("l_tax") * 5).alias("tau_cache"), ((F.col("l_quantity") - 25) / 5).alias("yes"), ((n - 3) / 2).alias("no"),
                                                F.when(n % 6 == 0, "P0").when(n % 6 == 5, "LR").otherwise(F.concat(F.lit("P"), (n % 6).cast("string"))).alias("pooling"))
    tau, yes, no = F.col("tau"), F.col("yes"), F.col("no")
    features = s.gate_features(F.when(F.col("n") != 7, F.col("n")), F.col("n") * 10, yes, 5.0)
    named = dict(zip(("depth_long", "log1p_subtree_size", "margin_max", "depth_long_missing"), features, strict=True))
    weights = {"depth_long": 0.2, "log1p_subtree_size": -0.1, "margin_max": 0.3, "depth_long_missing": 0.4}
    return rows.select("id", "n", s.containment_threshold(tau).alias("needed"), s.cache_supports(F.col("pooling"), tau, F.col("tau_cache")).alias("supported"),
                       s.captured_mass(yes, no, F.log(F.exp(yes) + F.exp(no) + F.exp(F.lit(0.5)))).alias("mass"), s.gate(named, weights, -0.5).alias("gate"), s.at_least_one(F.col("n"), tau).alias("hit"))


_DUAL = "term LIKE 'S%'"
_META = "SELECT t.term, subtree_size, n_children, n_children = 0 AS is_leaf, d.depth, l.depth AS depth_long, y.layer1 FROM (SELECT ancestor AS term, count(*) - 1 AS subtree_size, count_if(hops = 1) AS n_children FROM closed GROUP BY 1) t LEFT JOIN depth d ON d.term = t.term LEFT JOIN long_depth l ON l.term = t.term LEFT JOIN (SELECT descendant, string_agg(ancestor, ';' ORDER BY ancestor) AS layer1 FROM closed WHERE ancestor LIKE 'R%' GROUP BY 1) y ON y.descendant = t.term"


@query("node_metadata", "term:s subtree_size:i n_children:i is_leaf:s depth:i depth_long:i layer1:s band:s cost:d shard:i",
       sql(f"SELECT *, CASE WHEN (p // 7) % 2 = 0 THEN p % 7 ELSE 6 - p % 7 END AS shard FROM (SELECT *, CASE WHEN depth <= 1 THEN '1' WHEN depth <= 3 THEN CAST(depth AS VARCHAR) WHEN depth <= 5 THEN '4-5' WHEN depth IS NOT NULL THEN '6+' END AS band, round(c, 9) AS cost, row_number() OVER (ORDER BY round(c, 9) DESC, term) - 1 AS p FROM (SELECT *, ln(1 + subtree_size) + CASE WHEN {_DUAL} THEN 40.0 ELSE 20.0 END AS c FROM meta))", "closed", "depth", "long_depth", meta=_META))
def _(spark, d):
    """Covariates of every term, its cost to score, and its shard when terms are dealt forth and back by falling cost."""
    edges, closed = fx.edges(spark, d), fx.closed(spark, d)
    size = closed.groupBy(F.col("ancestor").alias("term")).agg((F.count(F.lit(1)) - 1).alias("subtree_size"), F.count_if(F.col("hops") == 1).alias("n_children"))
    tops = closed.where("ancestor like 'R%'").groupBy(F.col("descendant").alias("term")).agg(F.array_join(F.array_sort(F.collect_set("ancestor")), ";").alias("layer1"))
    meta = size.join(graph.depths(edges, closed), "term", "left").join(graph.longest_depths(edges).withColumnRenamed("depth", "depth_long"), "term", "left").join(tops, "term", "left")
    meta = meta.withColumn("cost", F.round(s.node_cost(F.col("subtree_size"), F.col("term").like("S%")), 9))
    # The ontology's terms, thousands at any size of the corpus, are ranked in one window.
    place = F.row_number().over(Window.orderBy(F.col("cost").desc(), "term")) - 1
    return meta.select("term", "subtree_size", "n_children", (F.col("n_children") == 0).alias("is_leaf"), "depth", "depth_long", "layer1", s.depth_band(F.col("depth")).alias("band"), "cost", s.snake_shard(place, 7).alias("shard"))


_GB = "1073741824.0"


@query("cost_profile", "priority:s n_reports:i seconds:d seconds_per_report:d peak_gb:d hours_per_term:d bytes_per_term:d break_even:d",
       f"SELECT priority, n_reports, s AS seconds, s / n_reports AS seconds_per_report, b / {_GB} AS peak_gb, s / 3600 / n_terms AS hours_per_term, b / n_terms AS bytes_per_term, CASE WHEN 150000 > s / n_reports THEN s / (150000 - s / n_reports) ELSE CAST('Infinity' AS DOUBLE) END AS break_even FROM (SELECT o_orderpriority AS priority, count(*) AS n_reports, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100.0 AS s, max(o_totalprice) * 1e6 AS b, count(DISTINCT o_custkey) AS n_terms FROM orders GROUP BY 1)")
def _(spark, d):
    """Cost columns of runs, here the orders of a priority: time and memory a report, set-up cost a term, break-even size."""
    o = fx.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n_reports"), (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100).alias("seconds"), (F.max("o_totalprice") * 1e6).alias("bytes"), F.countDistinct("o_custkey").alias("terms"))
    hours, each = F.col("seconds") / 3600, F.col("seconds") / F.col("n_reports")
    return o.select("priority", "n_reports", "seconds", each.alias("seconds_per_report"), (F.col("bytes") / 1024**3).alias("peak_gb"), (hours / F.col("terms")).alias("hours_per_term"), (F.col("bytes") / F.col("terms")).alias("bytes_per_term"), s.break_even(hours, F.lit(150000.0), each).alias("break_even"))


_LS = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN -1.0 WHEN 1 THEN 1.0 WHEN 2 THEN NULL ELSE (p_partkey % 90) / 100.0 END AS score FROM part"


@query("link_sources", "source:s n:i", sql("SELECT CASE WHEN score = -1 THEN 'llm' WHEN score = 1 THEN 'dictionary' WHEN score IS NOT NULL THEN 'retrieval' END AS source, count(*) AS n FROM ls GROUP BY 1", ls=_LS))
def _(spark, d):
    k = F.col("p_partkey")
    score = F.when(k % 5 == 0, -1.0).when(k % 5 == 1, 1.0).when(k % 5 != 2, (k % 90) / 100)
    return fx.table(spark, d, "part").select(s.link_source(score).alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
