"""Queries on the curation log, policies, rankings and the panel pipeline with stand-ins for its models."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovemark.functions.codes import parse_codes
from grovemark.operators import curation, panel
from grovemark.operators.quality import flat_units, ratio
from grovemark.plans import fixtures as fx
from grovemark.plans.fixtures import div, sql
from grovemark.plans.registry import query

_ACT = {"signup": "suggest", "error": "withdraw", "purchase": "approve", "click": "label", "view": "edit"}
_LOG = f"SELECT user_id AS key, event_id, CASE WHEN value > 300 THEN 'other' {' '.join(f'''WHEN event_type = '{k}' THEN '{v}' ''' for k, v in _ACT.items())} END AS action, CASE WHEN value < 20 THEN '' ELSE regexp_extract(props, '[0-9]+') END AS payload FROM events"
_AFTER = "arg_max({0}, event_id) FILTER (action = '{1}' AND event_id > floor)"


@query("event_fold_state", "key:i removed:s status:s label:s edit:s n:i n_unknown:i",
       sql(f"""SELECT key, any_value(floor) > -1 AND count(*) FILTER (action = 'suggest' AND event_id > floor) = 0 AS removed,
  arg_max(CASE WHEN action = 'suggest' THEN 'suggested' ELSE 'approved' END, event_id) FILTER (action IN ('suggest', 'approve') AND event_id > floor) AS status,
  nullif({_AFTER.format('payload', 'label')}, '') AS label, nullif({_AFTER.format('payload', 'edit')}, '') AS edit, count(*) AS n, count(*) FILTER (action = 'other') AS n_unknown
  FROM lg JOIN (SELECT key, CASE WHEN s < w THEN w ELSE -1 END AS floor FROM (SELECT key, min(event_id) FILTER (action = 'suggest') AS s, max(event_id) FILTER (action = 'withdraw') AS w FROM lg GROUP BY key)) USING (key) GROUP BY key""", lg=_LOG))  # fmt: skip
def _(spark, d):
    e = fx.table(spark, d, "events")
    kinds = F.create_map(*[F.lit(x) for kv in _ACT.items() for x in kv])
    action = F.when(F.col("value") > 300, "other").otherwise(kinds[F.col("event_type")])
    payload = F.when(F.col("value") >= 20, F.regexp_extract("props", "[0-9]+", 0))
    out = curation.fold_state(e.select(F.col("user_id").alias("key"), "event_id", action.alias("action"), payload.alias("payload")))
    return out.select("key", "removed", "status", "label", "edit", "n", "n_unknown")


# policy, lets undecided pass, lets doubtful pass, lets loose pass
_POLICIES = [("strict", False, False, False), ("anchored", True, True, False), ("certain", True, False, True), ("decided", False, True, True), ("firm", True, False, False), ("all", True, True, True)]
_PSQL = "SELECT * FROM (VALUES " + ", ".join(str(p).replace("True", "true").replace("False", "false") for p in _POLICIES) + ") t(policy, undecided, doubtful, loose)"


@query("gold_policies", "policy:s reason:s n:i",
       sql("""SELECT policy, CASE WHEN l_returnflag = 'N' THEN 'rejected' WHEN l_returnflag <> 'R' AND NOT undecided THEN 'undecided' WHEN l_discount >= 0.08 AND NOT doubtful THEN 'uncertain'
  WHEN l_tax >= 0.07 AND NOT loose THEN 'unanchored' ELSE 'kept' END AS reason, count(*) AS n FROM lineitem CROSS JOIN po GROUP BY ALL""", po=_PSQL))  # fmt: skip
def _(spark, d):
    """What each of six policies does with the annotations, by reason."""
    status = F.when(F.col("l_returnflag") == "N", "rejected").when(F.col("l_returnflag") == "R", "approved").otherwise("open")
    records = fx.table(spark, d, "lineitem").select(status.alias("status"), (F.col("l_discount") >= 0.08).alias("uncertain"), (F.col("l_tax") < 0.07).alias("anchored"))
    policies = spark.createDataFrame(_POLICIES, "policy string, undecided boolean, doubtful boolean, loose boolean")
    return curation.decide(records, policies).groupBy("policy", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("cohort_reasons", "report:i reasons:s",
       sql("SELECT report, concat_ws(',', CASE WHEN a THEN 'approved' END, CASE WHEN b THEN 'anchored' END, CASE WHEN c THEN 'many' END) AS reasons FROM (SELECT l_orderkey AS report, bool_or(l_returnflag = 'R') AS a, bool_and(l_tax < 0.07) AS b, count(*) >= 5 AS c FROM lineitem GROUP BY 1) WHERE a OR b OR c"))
def _(spark, d):
    """Reports that any criterion includes, with all that do."""
    r = fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("report")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("approved"), F.bool_and(F.col("l_tax") < 0.07).alias("anchored"), (F.count(F.lit(1)) >= 5).alias("many"))
    reasons = F.concat_ws(",", *[F.when(F.col(c), c) for c in ("approved", "anchored", "many")])
    return r.select("report", reasons.alias("reasons")).where("reasons <> ''")


@query("rank_reports", "side:s place:i report:i f1:d",
       sql(f"SELECT * FROM (SELECT 'best' AS side, row_number() OVER (ORDER BY f1 DESC, size DESC, report) AS place, report, f1 FROM sc UNION ALL SELECT 'worst', row_number() OVER (ORDER BY f1, size DESC, report), report, f1 FROM sc) WHERE place <= 10", "units", sc=f"SELECT report, tp + fn AS size, round({div('2 * tp', '2 * tp + fp + fn')}, 9) AS f1 FROM units WHERE tp + fn >= 2"))
def _(spark, d):
    """The ten best and ten worst reports with at least two gold terms; a distributed top-k each."""
    u = flat_units(fx.gold(spark, d), fx.pred(spark, d)).where("tp + fn >= 2")
    s = u.select("report", (F.col("tp") + F.col("fn")).alias("size"), F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 9).alias("f1"))

    def ten(side, by):
        top = s.orderBy(by, F.desc("size"), "report").limit(10)
        return top.select(F.lit(side).alias("side"), F.row_number().over(Window.orderBy(by, F.desc("size"), "report")).alias("place"), "report", "f1")

    return ten("best", F.desc("f1")).union(ten("worst", F.asc("f1")))


@query("code_cells", "id:i n:i codes:s",
       sql("SELECT id, count(*) AS n, string_agg(c, '|' ORDER BY ln, c) AS codes FROM (SELECT l_orderkey AS id, 'P' || l_partkey AS c, min(l_linenumber) AS ln FROM lineitem GROUP BY ALL) GROUP BY id"))
def _(spark, d):
    """Cells of codes in the three spellings that files use, read by one rule."""
    li = fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", fx.part("l_partkey").alias("c")))).alias("x"))
    c = F.transform("x", lambda s: s["c"])
    cell = F.when(F.col("id") % 3 == 0, F.array_join(c, ";")).when(F.col("id") % 3 == 1, F.array_join(c, ", ")).otherwise(F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']")))
    return li.select("id", parse_codes(cell).alias("codes")).select("id", F.size("codes").alias("n"), F.array_join("codes", "|").alias("codes"))


_WD = "SELECT doc_id, i - 1 AS segment, line, unnest(list_distinct(regexp_extract_all(lower(line), '[a-z0-9]+'))) AS word FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


@query("jury_extract_standin", "doc_id:i n_terms:i terms:s",
       sql("SELECT d.doc_id, count(word) AS n_terms, coalesce(string_agg(word, '|' ORDER BY word), '') AS terms FROM documents d LEFT JOIN (SELECT doc_id, word FROM wd JOIN dict USING (word) CROSS JOIN range(5) j(juror) WHERE (length(line) + length(word) + juror) % 3 <> 0 GROUP BY ALL HAVING count(DISTINCT juror) >= 4) x ON x.doc_id = d.doc_id GROUP BY d.doc_id",
           wd=_WD, dict="SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]{7,}')) AS word FROM benchmark"))
def _(spark, d):
    """The panel pipeline end to end: lines, five stand-in jurors that each find dictionary words, agreement of four, and one
    result per document. The dictionary holds the longer words of benchmark."""
    words = fx.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{7,}"), F.lit(0))).alias("surface")).distinct()
    out = panel.extract(fx.table(spark, d, "documents"), "doc_id", "text", words.select("surface", F.col("surface").alias("term")), 5, 4)
    return out.select("doc_id", F.size("terms").alias("n_terms"), F.array_join("terms", "|").alias("terms"))
