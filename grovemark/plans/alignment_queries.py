"""Queries on places in texts: aligned segments, triggers, repairs, tables, and merged records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovemark.operators import alignment as al
from grovemark.operators import merging as mg
from grovemark.plans import fixtures as fx
from grovemark.plans.fixtures import sql
from grovemark.plans.registry import query

_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TURN = "row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1"
_CV = f"SELECT conv_id AS report, {_TURN} AS i, coalesce(text, '') AS t FROM conversations"
_TX = "SELECT report, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text FROM cv GROUP BY report"
_SE = f"SELECT report, i, CASE (report + i) % 5 WHEN 0 THEN translate(t, '{_LOW}', '{_UP}') WHEN 1 THEN replace(t, ' ', '  ') WHEN 2 THEN t || ' qqq' ELSE t END AS segment FROM cv"


def _turns(spark, d):
    c = fx.table(spark, d, "conversations").select(F.col("conv_id").alias("report"), "turn", "role", "text")
    i = F.row_number().over(Window.partitionBy("report").orderBy("turn", "role", "text")) - 1
    return c.select("report", i.alias("i"), F.coalesce("text", F.lit("")).alias("t"))


def _texts(spark, d):
    g = _turns(spark, d).groupBy("report").agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("x"))
    return g.select("report", F.array_join(F.transform("x", lambda x: x.t), "\n\n").alias("text"))


def _segments(spark, d):
    """The turns as another pipeline might have written them: capitals, wider blanks, added words."""
    k = (F.col("report") + F.col("i")) % 5
    s = F.when(k == 0, F.translate("t", _LOW, _UP)).when(k == 1, F.replace("t", F.lit(" "), F.lit("  "))).when(k == 2, F.concat("t", F.lit(" qqq"))).otherwise(F.col("t"))
    return _turns(spark, d).select("report", F.col("i").alias("segment_idx"), s.alias("segment"))


_NORM = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
_NT = f"SELECT report, {_NORM.format('text')} AS t FROM tx"
_NS = f"SELECT report, i, {_NORM.format('segment')} AS s FROM se"
_WALK = """SELECT report, -1 AS i, 0 AS cur, CAST(NULL AS BIGINT) AS at_ FROM nt UNION ALL
  SELECT report, i, CASE WHEN k IS NULL THEN cur ELSE greatest(cur, k + n) END, k FROM (SELECT w.report, ns.i, w.cur, length(ns.s) AS n,
    CASE WHEN ns.s = '' THEN NULL WHEN strpos(substr(nt.t, w.cur + 1), ns.s) > 0 THEN w.cur + strpos(substr(nt.t, w.cur + 1), ns.s) - 1 WHEN strpos(nt.t, ns.s) > 0 THEN strpos(nt.t, ns.s) - 1 END AS k
    FROM walk w JOIN ns ON ns.report = w.report AND ns.i = w.i + 1 JOIN nt ON nt.report = w.report)"""
_AL = {"cv": _CV, "tx": _TX, "se": _SE, "nt": _NT, "ns": _NS, "walk": _WALK}


def _aligned(spark, d):
    return al.align(_texts(spark, d), _segments(spark, d))


@query("align_segments", "report:i segment_idx:i norm_at:i reads:s", sql("SELECT report, i AS segment_idx, at_ AS norm_at, at_ IS NOT NULL AS reads FROM walk WHERE i >= 0", **_AL))
def _(spark, d):
    """Where each segment stands in the normal form of its report, and whether the range in the text itself reads like it."""
    a = _aligned(spark, d).join(_texts(spark, d), "report")
    cut = F.substr("text", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return a.select("report", "segment_idx", F.col("at").alias("norm_at"), F.coalesce(al.normal(cut) == al.normal(F.col("segment")), F.lit(False)).alias("reads"))


@query("alignment_stats", "n_segments:i n_aligned:i n_unaligned:i", sql("SELECT count(*) AS n_segments, count(at_) AS n_aligned, count(*) - count(at_) AS n_unaligned FROM walk WHERE i >= 0", **_AL))
def _(spark, d):
    return al.alignment_stats(_aligned(spark, d))


@query("segment_texts", "report:i segment_idx:i chars:i digest:s",
       sql("SELECT w.report, w.i AS segment_idx, length(s.s) AS chars, md5(s.s) AS digest FROM walk w JOIN ns s ON s.report = w.report AND s.i = w.i WHERE w.i >= 0", **_AL))
def _(spark, d):
    """The segments as the text spells them, compared in their normal form."""
    t = al.normal(F.col("shown"))
    return al.segment_texts(_aligned(spark, d), _texts(spark, d)).select("report", "segment_idx", F.length(t).alias("chars"), F.md5(t).alias("digest"))


_PT = "SELECT report, i AS id, i * 37 + report % 11 AS p FROM cv"
_LN = "SELECT report, i, coalesce(sum(length(t) + 2) OVER (PARTITION BY report ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(t) AS n FROM cv"


def _ranges(spark, d):
    before = F.coalesce(F.sum(F.length("t") + 2).over(Window.partitionBy("report").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _turns(spark, d).select("report", "i", "t", before.alias("start"), (before + F.length("t")).alias("end"))


@query("points_in_ranges", "report:i id:i turn_at:i", sql("SELECT p.report, p.id, coalesce(min(l.i), -1) AS turn_at FROM pt p LEFT JOIN ln l ON l.report = p.report AND l.a <= p.p AND p.p < l.a + l.n GROUP BY ALL", cv=_CV, pt=_PT, ln=_LN))
def _(spark, d):
    """Which turn of a report holds an offset; -1 between turns and beyond the end."""
    points = _turns(spark, d).select("report", F.col("i").alias("id"), (F.col("i") * 37 + F.col("report") % 11).alias("p"))
    return al.in_ranges(points, _ranges(spark, d).withColumnRenamed("i", "turn_at"), "p", "turn_at").select("report", "id", "turn_at")


@query("offsets_hold", "report:i n:i n_ok:i", sql("SELECT l.report, count(*) AS n, count_if(n > 0 AND (CASE WHEN l.i % 3 = 0 THEN 1 ELSE 0 END) = 0) AS n_ok FROM ln l GROUP BY 1", cv=_CV, ln=_LN))
def _(spark, d):
    """Whether stated ranges read as their own text; every third is moved by a character beyond the end of its turn."""
    off = (F.col("i") % 3 == 0).cast("int")
    spans = _ranges(spark, d).select("report", (F.col("start") + off).alias("start"), (F.col("end") + 2 * off).alias("end"), F.col("t").alias("text"))
    return al.offsets_hold(spans, _texts(spark, d)).groupBy("report").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"))


_TG = "SELECT report, i, text, CASE i % 3 WHEN 0 THEN upper(w1) WHEN 1 THEN w1 || ' ' || w2 ELSE 'zzz' END AS trigger FROM (SELECT report, i, t AS text, coalesce(regexp_extract_all(t, '[a-zA-Z]+')[2], '') AS w1, coalesce(regexp_extract_all(t, '[a-zA-Z]+')[3], '') AS w2 FROM (SELECT report, i, regexp_replace(t, '[^ -~]', 'x', 'g') AS t FROM cv))"
_TS = r"SELECT report, i, lower(text) AS text, regexp_replace(lower(trim(trigger)), '\s+', '\\s+', 'g') AS p, trim(trigger) AS trigger FROM tg"
_TF = r"SELECT report, i, CASE WHEN trigger = '' THEN NULL WHEN regexp_matches(text, '\b' || p || '\b') THEN length(regexp_extract(text, '^(.*?)\b' || p || '\b', 1, 's')) WHEN regexp_matches(text, p) THEN length(regexp_extract(text, '^(.*?)' || p, 1, 's')) END AS start, CASE WHEN regexp_matches(text, '\b' || p || '\b') THEN length(regexp_extract(text, '\b' || p || '\b')) ELSE length(regexp_extract(text, p)) END AS n FROM ts"


@query("find_trigger", "report:i i:i start:i finish:i", sql("SELECT report, i, start, CASE WHEN start IS NOT NULL THEN start + n END AS finish FROM tf", cv=_CV, tg=_TG, ts=_TS, tf=_TF))
def _(spark, d):
    """The first place of a trigger in its turn: bounded by word ends, else anywhere; blanks match runs of blanks."""
    w = F.regexp_extract_all("t", F.lit("[a-zA-Z]+"), F.lit(0))
    w1, w2 = (F.coalesce(F.try_element_at(w, F.lit(k)), F.lit("")) for k in (2, 3))
    trigger = F.when(F.col("i") % 3 == 0, F.upper(w1)).when(F.col("i") % 3 == 1, F.concat(w1, F.lit(" "), w2)).otherwise("zzz")
    # The engines differ in what a word end is beside other than ASCII letters.
    rows = _turns(spark, d).withColumn("t", F.regexp_replace("t", "[^ -~]", "x")).withColumn("trigger", trigger).withColumn("x", al.find_trigger(F.col("t"), F.col("trigger")))
    return rows.select("report", "i", "x.start", F.col("x.end").alias("finish"))


@query("resolve_offset")
def _(spark, d):
    """Stated offsets of words, some of them moved: kept where the word stands there, mended where it stands near."""
    w = F.regexp_extract_all("t", F.lit("[a-zA-Z]{6,}"), F.lit(0))
    rows = _turns(spark, d).withColumn("w", F.try_element_at(w, F.lit(1))).where("w is not null").withColumn("right", F.instr("t", F.col("w")) - 1)
    rows = rows.withColumn("stated", F.col("right") + F.when(F.col("i") % 2 == 0, 0).otherwise(5))
    return rows.select("report", "i", "right", "stated", al.resolve_offset(F.col("t"), F.col("stated"), F.col("w")).alias("found"))


_RT = r"SELECT p_partkey AS report, CASE p_partkey % 6 WHEN 0 THEN p_name || ' 5 gmol and 6 umol' WHEN 1 THEN 'homocysteinernia 3 um01 ' || p_name WHEN 2 THEN '12 mol / mol creatinine ' || p_type WHEN 3 THEN 'modernic ' || p_name || ' pmo1' ELSE p_name END AS text FROM part"
_RL = (("rnia", r"[a-z]rnia\b", 1, "ocr"), ("rnic", r"[a-z]rnic\b", 1, "ocr"), ("rnal", r"[a-z]rnal\b", 1, "ocr"), ("gmol", r"\bgmol\b", 0, "unit"), ("um01", r"(?i)\bum0?1\b", 0, "unit"), ("umol", r"\bumol\b", 0, "unit"), ("pmo1", r"\bpmo1\b", 0, "unit"), ("mol", r"(?i)\bmol\s*/\s*mol", 0, "ambiguous"))


def _count(kind: str) -> str:
    return " + ".join(f"len(regexp_extract_all(text, '{p}'))" for _, p, _, k in _RL if k == kind)


@query("detect_repairs", "report:i ocr:i unit:i ambiguous:i", sql(f"SELECT * FROM (SELECT report, {_count('ocr')} AS ocr, {_count('unit')} AS unit, {_count('ambiguous')} AS ambiguous FROM rt) WHERE ocr + unit + ambiguous > 0", rt=_RT))
def _(spark, d):
    """Damaged words and units by report."""
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    t = F.when(k == 0, F.concat(n, F.lit(" 5 gmol and 6 umol"))).when(k == 1, F.concat(F.lit("homocysteinernia 3 um01 "), n)).when(k == 2, F.concat(F.lit("12 mol / mol creatinine "), F.col("p_type"))).when(k == 3, F.concat(F.lit("modernic "), n, F.lit(" pmo1"))).otherwise(n)
    r = al.repairs(fx.table(spark, d, "part").select(F.col("p_partkey").alias("report"), t.alias("text")))
    return r.groupBy("report").agg(F.count_if(F.col("kind") == "ocr").alias("ocr"), F.count_if((F.col("kind") == "unit") & ~F.col("ambiguous")).alias("unit"), F.count_if("ambiguous").alias("ambiguous"))


_TB = "SELECT o_orderkey AS report, 'Intro text' || chr(10) || CASE o_orderkey % 4 WHEN 0 THEN 'Ammonia  ' || o_custkey || '  umol' WHEN 1 THEN 'Na  K  Cl' || chr(10) || '1.5  2-3  <4' || chr(10) || '7  8' WHEN 2 THEN 'Na  K' || chr(10) || 'words' || chr(10) || '1  2' ELSE 'A  B  3  4' END || chr(10) || 'End' AS text FROM orders"


@query("detect_tables", "report:i line:i kind:s n_labels:i n_values:i aligned:s",
       sql("SELECT report, unnest(CASE report % 4 WHEN 0 THEN [1] WHEN 1 THEN [2, 3] WHEN 2 THEN [] ELSE [1] END) AS line, unnest(CASE report % 4 WHEN 1 THEN ['block', 'block'] WHEN 2 THEN [] ELSE ['inline'] END) AS kind, unnest(CASE report % 4 WHEN 0 THEN [2] WHEN 1 THEN [3, 3] WHEN 2 THEN [] ELSE [2] END) AS n_labels, unnest(CASE report % 4 WHEN 0 THEN [1] WHEN 1 THEN [3, 2] WHEN 2 THEN [] ELSE [2] END) AS n_values, unnest(CASE report % 4 WHEN 1 THEN [true, false] WHEN 2 THEN [] ELSE [true] END) AS aligned FROM tb", tb=_TB))
def _(spark, d):
    """Tables of four kinds of report: an inline row, a block with a short row, a header that a line cuts off, pairs."""
    k = F.col("o_orderkey") % 4
    body = F.when(k == 0, F.concat(F.lit("Ammonia  "), F.col("o_custkey").cast("string"), F.lit("  umol"))).when(k == 1, "Na  K  Cl\n1.5  2-3  <4\n7  8").when(k == 2, "Na  K\nwords\n1  2").otherwise("A  B  3  4")
    texts = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("report"), F.concat(F.lit("Intro text\n"), body, F.lit("\nEnd")).alias("text"))
    return al.tables(texts).select("report", "line", "kind", F.size("labels").alias("n_labels"), F.size("values").alias("n_values"), "aligned")


_MN = rf"SELECT report, i AS id, CASE (report * 3 + i) % 6 WHEN 0 THEN t WHEN 1 THEN translate(t, '{_LOW}', '{_UP}') WHEN 2 THEN left(t, length(t) // 2) WHEN 3 THEN array_to_string(list_reverse(string_split(t, ' ')), ' ') WHEN 4 THEN 'no such context at all' ELSE '' END AS context FROM cv"
_MS = f"SELECT n.report, n.id, s.i, n.context, s.t, {_NORM.format('n.context')} AS a, {_NORM.format('s.t')} AS b FROM mn n JOIN cv s ON s.report = n.report"
_MT = "SELECT report, id, i, sh, CASE WHEN a = '' THEN NULL WHEN context = t THEN 1 WHEN lower(context) = lower(t) THEN 2 WHEN b <> '' AND (contains(a, b) OR contains(b, a)) THEN 3 WHEN sh >= 0.5 THEN 4 END AS tier FROM (SELECT *, len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' ')))) / CAST(len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) AS DOUBLE) AS sh FROM ms)"


@query("match_to_segments", "report:i id:i segment_idx:i tier:i",
       sql("SELECT n.report, n.id, x.segment_idx, x.tier FROM mn n LEFT JOIN (SELECT report, id, arg_min(i, (tier, CASE WHEN tier = 4 THEN -round(sh, 12) ELSE 0 END, i)) AS segment_idx, min(tier) AS tier FROM mt WHERE tier IS NOT NULL GROUP BY ALL) x ON x.report = n.report AND x.id = n.id", cv=_CV, mn=_MN, ms=_MS, mt=_MT))
def _(spark, d):
    k, t = (F.col("report") * 3 + F.col("i")) % 6, F.col("t")
    half = F.substr(t, F.lit(1), F.floor(F.length(t) / 2).cast("int"))
    c = F.when(k == 0, t).when(k == 1, F.translate(t, _LOW, _UP)).when(k == 2, half).when(k == 3, F.array_join(F.reverse(F.split(t, " ")), " ")).when(k == 4, "no such context at all").otherwise("")
    turns = _turns(spark, d)
    return al.match_to_segments(turns.select("report", F.col("i").alias("id"), c.alias("context")), turns.select("report", F.col("i").alias("segment_idx"), t.alias("segment")))


@query("shared_runs", "n:i", sql("SELECT count(*) AS n FROM (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS run FROM (SELECT list_transform(regexp_extract_all(text, '[a-zA-ZäöüÄÖÜß0-9]+'), lambda x: lower(x)) AS w FROM benchmark)) SEMI JOIN (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS run FROM (SELECT list_transform(regexp_extract_all(text, '[a-zA-ZäöüÄÖÜß0-9]+'), lambda x: lower(x)) AS w FROM conversations)) USING (run)"))
def _(spark, d):
    """Runs of five words that the benchmark's items share with the conversations."""
    text = lambda n: fx.table(spark, d, n).select("text")
    return al.shared_runs(text("benchmark"), text("conversations")).agg(F.count(F.lit(1)).alias("n"))


_SRC = ("confirmed", "prior", "detector", "cross_check")


def _records(spark, d):
    li = fx.table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    span = F.when((F.col("l_quantity") >= 30), F.concat_ws(":", (n % 3).cast("string"), (F.col("l_suppkey") % 2).cast("string")))
    src = F.element_at(F.array(*map(F.lit, _SRC)), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return li.select((F.col("l_orderkey") % 300).alias("report"), F.concat(F.lit("C"), (F.col("l_partkey") % 5).cast("string")).alias("code"), (((F.col("l_orderkey") * 10 + n) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("id"), src.alias("source"), span.alias("span"),
                     F.when(F.col("l_tax") > 0.04, F.concat(F.lit("t"), (n % 2).cast("string"))).alias("trigger"), F.when(F.col("l_discount") > 0.05, (n % 3).cast("long")).alias("segment"), F.when(n == 1, F.lit("ctx")).alias("context"), F.when(F.col("l_returnflag") == "R", F.lit(True)).alias("confirmed"))


@query("merge_identical")
def _(spark, d):
    """Records of one code that don't contradict each other's place, folded; the cross-check stays apart."""
    return mg.merge_identical(_records(spark, d), {s: i for i, s in enumerate(_SRC[:3])})


@query("merge_totals", "report:i code:s n_records:i n_apart:i",
       sql("SELECT l_orderkey % 300 AS report, 'C' || l_partkey % 5 AS code, count(*) AS n_records, count_if(l_suppkey % 4 = 3) AS n_apart FROM lineitem GROUP BY ALL"))
def _(spark, d):
    """No record is lost by merging: the hosts' counts add up, and every cross-check is its own host."""
    m = mg.merge_identical(_records(spark, d), {s: i for i, s in enumerate(_SRC[:3])})
    return m.groupBy("report", "code").agg(F.sum("n_merged").alias("n_records"), F.count_if(F.col("sources") == "cross_check").alias("n_apart"))


@query("has_position", "positioned:s n:i", "SELECT l_tax > 0.04 OR l_discount > 0.05 OR l_quantity >= 30 AS positioned, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    r = _records(spark, d)
    return r.select(mg.has_position(F.col("trigger"), F.col("segment"), F.col("span")).alias("positioned")).groupBy("positioned").agg(F.count(F.lit(1)).alias("n"))


_VOC = ("absent", "family", "unclear", "resolved")


@query("clean_labels", "id:i labels:s source:s", "SELECT p_partkey AS id, array_to_string(list_filter(['absent', 'family', 'unclear', 'resolved'], lambda v: list_contains(CASE p_partkey % 3 WHEN 0 THEN ['resolved', 'zzz', 'absent', 'absent'] WHEN 1 THEN ['unclear'] ELSE [] END, v)), ',') AS labels, CASE p_partkey % 4 WHEN 0 THEN 'current' WHEN 1 THEN 'current|7' WHEN 2 THEN 'olden' ELSE 'x|old' END AS source FROM part")
def _(spark, d):
    """Labels in the vocabulary's order, and source labels under their present names."""
    k = F.col("p_partkey")
    given = F.when(k % 3 == 0, F.array(*map(F.lit, ("resolved", "zzz", "absent", "absent")))).when(k % 3 == 1, F.array(F.lit("unclear")))
    source = F.when(k % 4 == 0, "old").when(k % 4 == 1, "old|7").when(k % 4 == 2, "olden").otherwise("x|old")
    return fx.table(spark, d, "part").select(k.alias("id"), F.array_join(mg.known_labels(given, list(_VOC)), ",").alias("labels"), mg.current_label(source, {"old": "current"}).alias("source"))


@query("best_location", "report:i code:s location:i", "SELECT l_orderkey AS report, 'P' || l_partkey AS code, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS location FROM lineitem GROUP BY ALL")
def _(spark, d):
    rows = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report"), fx.part("l_partkey").alias("code"), F.col("l_linenumber").alias("rank"), F.col("l_suppkey").alias("location"))
    return mg.best_location(rows, ("report", "code"), "rank")
