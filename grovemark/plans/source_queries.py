"""Queries that write the test tables in a format, torn lines and odd cells included, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovemark.plans import fixtures as fx
from grovemark.plans import scratch
from grovemark.plans.fixtures import sql
from grovemark.plans.registry import query
from grovemark.sources import exports as ex
from grovemark.sources import readers as rd
from grovemark.sources import records as rc
from grovemark.sources import writers as wr


def place(spark) -> str:
    return f"{scratch.folder(spark)}/grovemark-io-{uuid.uuid4().hex}"


def put(spark, name: str, text: str) -> None:
    """One small file, through Spark's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(text.encode()))
    out.close()


def moved(spark, folder: str, name: str) -> None:
    """The one part file of a folder, under another name; nothing where it is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(name).getParent())
    for f in fs.listStatus(path(folder)):
        if f.getPath().getName().startswith("part-") and f.getLen():
            fs.rename(f.getPath(), path(name))


def texts(rows, path: str):
    """rows of one string column as lines of text files."""
    rows.write.text(path)
    return path


def _json(rows, *torn: str):
    """The rows as JSON lines, and some that are no JSON."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).unionByName(rows.sparkSession.createDataFrame([(t,) for t in torn], "value string"))


@query("read_detections", "report:s segment:i term:s count:i", sql("SELECT CAST(report AS VARCHAR) AS report, segment, 'T' || term AS term, count(*) AS count FROM detections GROUP BY ALL", "detections"))
def _(spark, d):
    """Detections of all jurors from JSON lines: repeated rows are summed, torn and incomplete ones go."""
    x = fx.detections(spark, d)
    rows = x.select(F.col("report").cast("string").alias("report_id"), F.col("segment").alias("sentence_number"), F.concat(F.lit("T"), F.col("term").cast("string")).alias("hpo_id"), F.lit(1).alias("count"))
    return rd.read_detections(spark, texts(_json(rows, '{"report_id": "7", "hpo', '{"report_id": "7"}', ""), place(spark)))


_CL = "SELECT CAST(l_orderkey % 200 AS VARCHAR) AS report_id, 'P' || l_partkey AS hpo_id, CASE WHEN l_suppkey % 4 = 0 THEN 'own' ELSE 'union' END AS ctx_type, row_number() OVER (PARTITION BY l_orderkey % 200, l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_suppkey) AS rank, l_linenumber AS sent_index, (l_quantity - 25) / 5 AS margin FROM lineitem"


def _calls(spark, d):
    li = fx.table(spark, d, "lineitem")
    w = Window.partitionBy(F.col("l_orderkey") % 200, "l_partkey").orderBy("l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey")
    return li.select((F.col("l_orderkey") % 200).cast("string").alias("report_id"), fx.part("l_partkey").alias("hpo_id"), F.when(F.col("l_suppkey") % 4 == 0, "own").otherwise("union").alias("ctx_type"), F.row_number().over(w).alias("rank"), F.col("l_linenumber").alias("sent_index"), ((F.col("l_quantity") - 25) / 5).alias("margin"))


@query("read_score_cache", "report_id:s hpo_id:s n:i first:d", sql("SELECT report_id, hpo_id, count(*) AS n, arg_min(margin, rank) AS first FROM cl WHERE ctx_type = 'union' GROUP BY ALL", cl=_CL))
def _(spark, d):
    """Calls of one kind of context from JSON lines with torn ones, as margins in order of rank."""
    path = texts(_json(_calls(spark, d), '{"report_id": "1", "rank": ', "not json"), place(spark))
    c = rd.score_cache(rd.read_calls(spark, path))
    return c.select("report_id", "hpo_id", F.size("margins").alias("n"), F.element_at("margins", 1).alias("first"))


@query("read_archive", "report_id:s hpo_id:s n:i top:d tau:d", sql("SELECT report_id, hpo_id, count(*) AS n, max(margin) AS top, 0.25 AS tau FROM cl WHERE CAST(report_id AS INT) < 50 GROUP BY ALL", cl=_CL))
def _(spark, d):
    """Calls kept by index, read back for some reports, with the threshold they were made at."""
    path, calls = place(spark), _calls(spark, d)
    rc.write_archive(calls, path, "ontology", 0.25)
    rc.write_archive(calls.where("rank = 1"), path, "exemplar", 0.5)
    few = spark.range(50).select(F.col("id").cast("string").alias("report_id"))
    rows = rc.read_archive(spark, path, "ontology", few).groupBy("report_id", "hpo_id").agg(F.count(F.lit(1)).alias("n"), F.max("margin").alias("top"))
    return rows.crossJoin(F.broadcast(rc.read_provenance(spark, path).where("retrieval_index = 'ontology'").select("tau")))


@query("context_types", "ctx_type:s", sql("SELECT DISTINCT ctx_type FROM cl", cl=_CL))
def _(spark, d):
    return rc.context_types(spark, texts(_json(_calls(spark, d)), place(spark)))


@query("ranked_segments", "report_id:s hpo_id:s segments:s", sql("SELECT report_id, hpo_id, string_agg(sent_index, ',' ORDER BY rank) AS segments FROM cl GROUP BY ALL", cl=_CL))
def _(spark, d):
    s = rc.ranked_segments(rd.read_calls(spark, texts(_json(_calls(spark, d)), place(spark)), None))
    return s.select("report_id", "hpo_id", F.array_join(F.col("segments").cast("array<string>"), ",").alias("segments"))


_PS = "SELECT r.report, coalesce(string_agg(p.term, ';' ORDER BY p.term), '') AS codes FROM reports r LEFT JOIN pred_b p ON p.report = r.report GROUP BY r.report"


@query("prediction_sets_file", "report:s codes:s", sql("SELECT CAST(report AS VARCHAR) AS report, codes FROM ps", "reports", "pred_b", ps=_PS))
def _(spark, d):
    """Sets written and read back; reports without any keep their line."""
    path = place(spark)
    wr.write_prediction_sets(fx.reports(spark, d).join(fx.pred_b(spark, d), "report", "left"), path)
    return rd.read_prediction_sets(spark, path).groupBy("report").agg(F.array_join(F.array_sort(F.collect_list("term")), ";").alias("codes"))


@query("read_positional_gold", "report:s idx:i term:s", "SELECT CAST(p_partkey AS VARCHAR) AS report, i AS idx, ['B', 'A'][i + 1] || p_partkey AS term FROM part CROSS JOIN range(2) r(i)")
def _(spark, d):
    """Codes in the order of their cell, whose separator and quotes differ, without repeats."""
    p, path = F.col("p_partkey").cast("string"), place(spark)
    a, b = F.concat(F.lit("A"), p), F.concat(F.lit("B"), p)
    cell = F.when(F.col("p_partkey") % 2 == 0, F.concat(b, F.lit("; "), a, F.lit(";"), b)).otherwise(F.concat(F.lit("['"), b, F.lit("', '"), a, F.lit("']")))
    fx.table(spark, d, "part").select(p.alias("who"), cell.alias("what")).write.csv(path, header=True)
    return rc.read_positional(spark, path)


@query("read_annotations", "report:s code:s trigger:s segment:i confirmed:s source:s n:i",
       "SELECT CAST(l_orderkey AS VARCHAR) AS report, 'P' || l_partkey AS code, CASE WHEN l_linenumber > 1 THEN 'w' || l_linenumber END AS trigger, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS segment, CASE l_returnflag WHEN 'R' THEN 'true' WHEN 'N' THEN 'false' END AS confirmed, 'prior' AS source, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'C' || o_custkey, NULL, NULL, NULL, 'code_only', 1 FROM orders")
def _(spark, d):
    """Two tables of other make in one schema; flags are true, false or not stated."""
    a, b, n = place(spark), place(spark), F.col("l_linenumber")
    yes = F.when(F.col("l_returnflag") == "R", " Yes.").when(F.col("l_returnflag") == "N", "FALSE").otherwise("?")
    fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("patient"), fx.part("l_partkey").alias("hpo"), F.when(n > 1, F.concat(F.lit(" w"), n.cast("string"), F.lit(" "))).otherwise("  ").alias("word"), F.when(n % 2 == 0, F.concat(n.cast("string"), F.lit(".0"))).otherwise("none").alias("idx"), yes.alias("ok")).write.csv(a, header=True)
    fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("code")).write.csv(b, header=True)
    rows = rc.read_annotations(spark, a, "prior", {"report": "patient", "code": "hpo", "trigger": "word", "segment": "idx", "confirmed": "ok"})
    both = rows.unionByName(rc.read_annotations(spark, b, "code_only", {"report": "id", "code": "code"}))
    return both.groupBy("report", "code", "trigger", "segment", F.col("confirmed").cast("string").alias("confirmed"), "source").agg(F.count(F.lit(1)).alias("n"))


@query("read_ids", "report:s", "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS report FROM lineitem WHERE l_linenumber = 1")
def _(spark, d):
    """A list of ids with a header, comments, blank lines and repeats."""
    ids = fx.table(spark, d, "lineitem").where("l_linenumber = 1").select(F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit(" ,x")).alias("value"))
    return rc.read_ids(spark, texts(ids.unionByName(spark.createDataFrame([("Report,y",), ("",), ("# no",)], "value string")), place(spark)), "report")


@query("read_either_delimiter", "file:s line:i n_cells:i last:s", "SELECT 'n' || n_nationkey || '.csv' AS file, i AS line, 2 AS n_cells, n_name || i AS last FROM nation CROSS JOIN range(1, 3) r(i) WHERE n_nationkey % 5 <> 4")
def _(spark, d):
    """Small tables that part cells by a semicolon or a comma; those with a broken line are left out."""
    path = place(spark)
    for r in fx.table(spark, d, "nation").collect():
        k, s = r["n_nationkey"], ";" if r["n_nationkey"] % 2 else ","
        put(spark, f"{path}/n{k}.csv", f"id{s}name\n1{s}{r['n_name']}1\r\n\n2{s}{r['n_name']}2\n" + (f"3{s}x{s}y\n" if k % 5 == 4 else ""))
    rows, _bad = rc.read_either_delimiter(spark, path)
    return rows.select("file", "line", F.size("cells").alias("n_cells"), F.element_at("cells", -1).alias("last"))


@query("read_reports", "report:s n_chars:i", "SELECT 'r' || n_nationkey AS report, CASE WHEN n_nationkey % 6 = 0 THEN 0 ELSE length(n_name) + 5 END AS n_chars FROM nation")
def _(spark, d):
    """Reports from one file each, empty ones too."""
    path = place(spark)
    for r in fx.table(spark, d, "nation").collect():
        put(spark, f"{path}/r{r['n_nationkey']}.txt", "" if r["n_nationkey"] % 6 == 0 else f"{r['n_name']}\n\nend")
    return rd.read_reports(spark, path).select("report", F.length("text").alias("n_chars"))


@query("read_span_annotations", "report:s start:i stop:i term:s mention:s", "SELECT 'r' || n_nationkey AS report, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey END AS start, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey + length(n_name) END AS stop, CASE WHEN n_nationkey % 4 > 0 THEN 'HP:000' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') END AS term, CASE WHEN n_nationkey % 4 > 0 THEN n_name END AS mention FROM nation")
def _(spark, d):
    """Spans, a code and a mention a line; files without a valid line keep one row, sidecar files don't count."""
    path = place(spark)
    for r in fx.table(spark, d, "nation").collect():
        k, n = r["n_nationkey"], r["n_name"]
        put(spark, f"{path}/r{k}", f"{k}:{k + len(n)}\tHP:{k:07d}\t{n}\n\nno line\n" if k % 4 else "nothing here\n")
        put(spark, f"{path}/._r{k}", "1:2\tHP:0000001\tx\n")
    return rd.read_span_annotations(spark, path)


@query("read_blocks", "report:s start:i stop:i mention:s term:s score:d", "SELECT 'b' || n_nationkey AS report, CASE WHEN n_nationkey % 3 > 0 THEN i END AS start, CASE WHEN n_nationkey % 3 > 0 THEN i + 2 END AS stop, CASE WHEN n_nationkey % 3 > 0 THEN n_name END AS mention, CASE WHEN n_nationkey % 3 > 0 THEN 'T' || i END AS term, CASE WHEN n_nationkey % 3 > 0 THEN 0.5 END AS score FROM nation JOIN range(2) r(i) ON i = 0 OR n_nationkey % 3 > 0")
def _(spark, d):
    """A linker's blocks of id, text and hits; a block without hits keeps one row."""
    path, out = place(spark), []
    for r in fx.table(spark, d, "nation").collect():
        k, n = r["n_nationkey"], r["n_name"]
        out.append(f"b{k}\n{n} text\n" + ("".join(f"{i}\t{i + 2}\t{n}\tT{i}\t0.5\n" for i in range(2)) + "torn\tline\n" if k % 3 else ""))
    put(spark, f"{path}/out.txt", "\n".join(out))
    return rc.read_blocks(spark, path)


@query("block_counts", "n_blocks:i n_hits:i n_terms:i n_unparsed:i", "SELECT count(*) AS n_blocks, 2 * count_if(n_nationkey % 3 > 0) AS n_hits, 2 AS n_terms, count_if(n_nationkey % 3 > 0) AS n_unparsed FROM nation")
def _(spark, d):
    path, out = place(spark), []
    for r in fx.table(spark, d, "nation").collect():
        k = r["n_nationkey"]
        out.append(f"b{k}\ntext\n" + ("0\t1\ta\tT0\t1\n1\t2\tb\tT1\t1\ntorn\tline\n" if k % 3 else ""))
    put(spark, f"{path}/out.txt", "\n".join(out))
    return rc.block_counts(spark, path)


@query("read_tagger", "report:s start:i phrase:s term:s score:d negated:s", "SELECT 't' || n_nationkey AS report, n_nationkey AS start, n_name || chr(10) || 'x' AS phrase, 'T' || n_regionkey AS term, 0.25 AS score, n_nationkey % 2 = 0 AS negated FROM nation")
def _(spark, d):
    """A tagger's tables, whose phrases may hold line ends."""
    path = place(spark)
    for r in fx.table(spark, d, "nation").collect():
        k = r["n_nationkey"]
        put(spark, f"{path}/t{k}.txt", f"{k}\t{k + 3}\t{r['n_name']}\nx\tT{r['n_regionkey']}\t0.25{chr(9) + 'Neg' if k % 2 == 0 else ''}\n")
    return rd.read_tagger(spark, path).select("report", "start", "phrase", "term", "score", "negated")


@query("read_grid", "prompt:s normaliser:s model:s n:i", sql("SELECT 'p' || juror // 4 AS prompt, 'n' || segment % 2 AS normaliser, 'm' || juror % 4 AS model, count(DISTINCT (report, term)) AS n FROM detections WHERE segment < 2 GROUP BY ALL", "detections"))
def _(spark, d):
    """Detections of every cell of a grid from files that name the cell; rows that repeat count once."""
    path, x = place(spark), fx.detections(spark, d).where("segment < 2")
    cells = [(j, s) for j in range(8) for s in range(2)]
    for j, s in cells:
        part = f"{path}-raw/{j}-{s}"
        x.where((F.col("juror") == j) & (F.col("segment") == s)).select("report", "term").coalesce(1).write.json(part)
        moved(spark, part, f"{path}/p{j // 4}/detections_m{j % 4}__n{s}.jsonl")
    return rc.read_grid(spark, path, "report long, term long").groupBy("prompt", "normaliser", "model").agg(F.count(F.lit(1)).alias("n"))


@query("read_traversal", "report_id:s depth:i n_visited:i n_calls:i calls_per_visit:d", "SELECT CAST(o_orderkey AS VARCHAR) AS report_id, i AS depth, o_custkey % 5 AS n_visited, i * 3 AS n_calls, CASE WHEN o_custkey % 5 > 0 THEN i * 3.0 / (o_custkey % 5) ELSE 0 END AS calls_per_visit FROM orders CROSS JOIN range(2) r(i)")
def _(spark, d):
    """Nested tables by depth, one row each."""
    row = lambda i: F.struct(F.lit(i).alias("depth"), (F.col("o_custkey") % 5).cast("int").alias("n_visited"), F.lit(3 * i).alias("n_slm_calls"))
    rows = fx.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("report_id"), F.lit(7).alias("n_slm_calls"), F.array(row(0), row(1)).alias("depth_table"))
    return rc.depth_rows(rc.read_traversal(spark, texts(_json(rows, '{"report_id": '), place(spark))))


@query("read_candidates", "report_id:s rank:i term:s", sql("SELECT CAST(report AS VARCHAR) AS report_id, row_number() OVER (PARTITION BY report ORDER BY score DESC, term) AS rank, term FROM pred", "pred"))
def _(spark, d):
    """Ranked candidates from summary rows; rows per term are passed over."""
    p = fx.pred(spark, d).groupBy(F.col("report").cast("string").alias("report_id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "term"))).alias("c"))
    rows = p.select("report_id", F.lit(True).alias("summary"), F.transform("c", lambda x: x.term).alias("candidates"))
    other = p.select("report_id", F.lit(False).alias("summary"), F.array(F.lit("x")).alias("candidates"))
    return rc.read_candidates(spark, texts(_json(rows.unionByName(other)), place(spark)))


@query("rule_file", "n_terms:i n_summaries:i n_predicted:i n_gold:i", sql("SELECT count(*) AS n_terms, (SELECT count(*) FROM reports) AS n_summaries, sum(p) AS n_predicted, sum(g) AS n_gold FROM pairs", "pairs", "reports"))
def _(spark, d):
    """A rule's file: rows per term, then one summary a report; the summaries are what readers go by."""
    path = place(spark)
    ex.rule_rows(fx.pred(spark, d), fx.gold(spark, d), fx.reports(spark, d)).withColumn("report_id", F.col("report_id").cast("string")).write.json(path)
    s = rd.read_summaries(spark, path)
    n = spark.read.json(path).where("not summary").agg(F.count(F.lit(1)).alias("n_terms"))
    return s.agg(F.count(F.lit(1)).alias("n_summaries"), F.sum(F.size("predicted_set")).alias("n_predicted"), F.sum(F.size("gold_set")).alias("n_gold")).crossJoin(n)


@query("walk_files", "tau_accept:d report:i n_visited:i n_accepted:i n_calls:i n_predicted:i", "SELECT ta AS tau_accept, l_orderkey % 200 AS report, count(*) AS n_visited, count_if(l_quantity / 50 >= ta) AS n_accepted, 3 * count(*) AS n_calls, count_if(l_quantity / 50 >= ta) AS n_predicted FROM lineitem CROSS JOIN (SELECT CAST(unnest([0.5, 0.9]) AS DOUBLE) AS ta) GROUP BY ALL")
def _(spark, d):
    """A walk's artefacts in folders by thresholds, read back over all of them."""
    path = place(spark)
    v = fx.table(spark, d, "lineitem").select((F.col("l_orderkey") % 200).alias("report"), fx.part("l_partkey").alias("term"), (F.col("l_quantity") / 50).alias("accept_score"), F.lit(3).alias("n_calls"))
    for t in (0.5, 0.9):
        ex.write_walk(v, path, 0.3, t)
    p = ex.read_walk(spark, path, "predictions").groupBy("tau_accept", "report").agg(F.count(F.lit(1)).alias("n_predicted"))
    return ex.read_walk(spark, path, "traversal").join(p, ["tau_accept", "report"], "left").na.fill(0, ["n_predicted"]).select("tau_accept", "report", "n_visited", "n_accepted", "n_calls", "n_predicted")


@query("call_records", "report:i segment:i margin:d verdict:s captured_mass:d", "SELECT l_orderkey AS report, l_linenumber AS segment, l_quantity / 10 - l_discount * 20 AS margin, CASE WHEN l_quantity / 10 - l_discount * 20 > 0 THEN 'Yes' ELSE 'No' END AS verdict, (exp(l_quantity / 10) + exp(l_discount * 20)) / (exp(l_quantity / 10) + exp(l_discount * 20) + 2) AS captured_mass FROM lineitem")
def _(spark, d):
    y, n = F.col("l_quantity") / 10, F.col("l_discount") * 20
    c = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report"), F.col("l_linenumber").alias("segment"), y.alias("logit_yes"), n.alias("logit_no"), F.log(F.exp(y) + F.exp(n) + 2).alias("logsumexp_all"))
    return ex.call_records(c).select("report", "segment", "margin", "verdict", "captured_mass")


@query("folds_file", "repetition:i outer_fold:i n_eval:i n_train:i n_inner:i first:s", "SELECT r AS repetition, k AS outer_fold, count_if((report + r) % 4 = k) AS n_eval, count_if((report + r) % 4 <> k) AS n_train, 3 AS n_inner, min(CAST(report AS VARCHAR)) FILTER ((report + r) % 4 = k) AS first FROM range(300) x(report), range(2) y(r), range(4) z(k) GROUP BY ALL")
def _(spark, d):
    """Folds written and read back as the reports that evaluate and train."""
    path = place(spark)
    r = spark.range(300).select(F.col("id").alias("report")).withColumn("repetition", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("outer_fold", F.explode(F.array(*map(F.lit, range(4)))))
    held = (F.col("report") + F.col("repetition")) % 4 == F.col("outer_fold")
    wr.write_folds(r.select("repetition", "outer_fold", (F.col("report") % 3).alias("inner_fold"), "report", F.lit(0).alias("stratum"), F.when(held, "eval").otherwise("train").alias("role")), path)
    f = ex.read_folds(spark, path)
    return f.select("repetition", "outer_fold", F.size("eval").alias("n_eval"), F.size("train").alias("n_train"), F.size("inner").alias("n_inner"), F.element_at("eval", 1).alias("first"))


_LB = "SELECT p_partkey AS report, 'C' || p_size AS code, CASE p_partkey % 3 WHEN 0 THEN ['absent', 'other'] WHEN 1 THEN ['family'] ELSE [] END AS labels FROM part"
_VO = [("absent", "status"), ("family", "person"), ("unclear", "status")]


def _labels(spark, d):
    k = F.col("p_partkey")
    lab = F.when(k % 3 == 0, F.array(F.lit("absent"), F.lit("other"))).when(k % 3 == 1, F.array(F.lit("family"))).otherwise(F.array().cast("array<string>"))
    return fx.table(spark, d, "part").select(k.alias("report"), F.concat(F.lit("C"), F.col("p_size").cast("string")).alias("code"), lab.alias("labels"))


@query("long_labels", "report:i code:s label:s group_:s", sql("SELECT report, code, label, v.g AS group_ FROM (SELECT report, code, unnest(labels) AS label FROM lb) JOIN (VALUES ('absent', 'status'), ('family', 'person'), ('unclear', 'status')) v(l, g) ON l = label", lb=_LB))
def _(spark, d):
    return ex.long_labels(_labels(spark, d), spark.createDataFrame(_VO, "label string, group string")).withColumnRenamed("group", "group_")


@query("wide_labels", "report:i absent:i family:i unclear:i", sql("SELECT report, CASE WHEN list_contains(labels, 'absent') THEN 1 ELSE 0 END AS absent, CASE WHEN list_contains(labels, 'family') THEN 1 ELSE 0 END AS family, 0 AS unclear FROM lb", lb=_LB))
def _(spark, d):
    return ex.wide_labels(_labels(spark, d), fx.table(spark, d, "part").select(F.col("p_partkey").alias("report")), [v for v, _ in _VO])


@query("flat_comments", "report:i place:i comment:s", "SELECT user_id AS report, row_number() OVER (PARTITION BY user_id ORDER BY ts, 'c' || event_id) AS place, 'c' || event_id AS comment FROM events")
def _(spark, d):
    e = fx.table(spark, d, "events").groupBy(F.col("user_id").alias("report")).agg(F.collect_list(F.struct("ts", F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("comment"))).alias("comments"))
    return ex.flat_comments(e).select("report", "place", "comment")


@query("linkage_file", "n:i n_linked:i n_negated:i", "SELECT count(*) AS n, count_if(l_suppkey % 3 > 0) AS n_linked, count_if(l_tax > 0.05) AS n_negated FROM lineitem")
def _(spark, d):
    """Linkage rows with fields in order; null ids are written out."""
    path, li = place(spark), fx.table(spark, d, "lineitem")
    rows = li.select(F.col("l_orderkey").cast("string").alias("report_id"), F.col("l_linenumber").alias("sentence_number"), F.lit(0).alias("line_index"), fx.part("l_partkey").alias("candidate_string"), F.lit("d").alias("normaliser"), F.when(F.col("l_suppkey") % 3 > 0, F.lit("T")).alias("hpo_id"), F.lit(1.0).alias("score"), F.lit("x").alias("source"), (F.col("l_tax") > 0.05).alias("negated"))
    ex.write_linkage(rows, path)
    return rd.read_jsonl(spark, path, rd.LINKAGE).agg(F.count(F.lit(1)).alias("n"), F.count("hpo_id").alias("n_linked"), F.count_if("negated").alias("n_negated"))


@query("merged_shards", "base:s n:i", "SELECT 'a_x.jsonl' AS base, count(DISTINCT p_partkey // 2) AS n FROM part UNION ALL SELECT 'b_x.jsonl', count(*) FROM part")
def _(spark, d):
    """Shards of a run: repeats of a keyed line go, a stale merged file is passed over, lines without key are all kept."""
    p = fx.table(spark, d, "part")
    k = F.floor(F.col("p_partkey") / 2).cast("string")
    keyed = F.concat(F.lit('{"report_id": "'), k, F.lit('"}'))
    rows = p.select(F.concat(F.lit("a_s"), (F.col("p_partkey") % 2 + 1).cast("string"), F.lit("of2_x.jsonl")).alias("name"), keyed.alias("value"))
    stale = p.select(F.lit("a_x.jsonl").alias("name"), F.lit('{"report_id": "stale"}').alias("value"))
    plain = p.select(F.lit("b_s1of1_x.jsonl").alias("name"), F.lit("{}").alias("value"))
    return ex.merged_shards(rows.unionByName(stale).unionByName(plain), "report_id").groupBy("base").agg(F.count(F.lit(1)).alias("n"))


@query("first_of_key", "report:i term:s", "SELECT l_orderkey AS report, arg_min('P' || l_partkey, l_linenumber * 1000000 + l_partkey) AS term FROM lineitem GROUP BY 1")
def _(spark, d):
    rows = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report"), fx.part("l_partkey").alias("term"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("o"))
    return ex.first_of_key(rows, "report", "o").select("report", "term")


@query("dataset_manifest", "part:s n_rows:i n_read:i", sql("SELECT 'gold' AS part, count(*) AS n_rows, count(*) AS n_read FROM gold UNION ALL SELECT 'reports', count(*), count(*) FROM reports", "gold", "reports"))
def _(spark, d):
    """A data set's parts with their sizes, as counted and as read back."""
    path = place(spark)
    m = ex.write_dataset(path, gold=fx.gold(spark, d), reports=fx.reports(spark, d))
    n = lambda p: spark.read.csv(f"{path}/{p}", header=True).agg(F.count(F.lit(1)).alias("n_read")).select(F.lit(p).alias("part"), "n_read")
    return m.join(n("gold").unionByName(n("reports")), "part").select("part", "n_rows", "n_read")


@query("fingerprints", "file:s fingerprint:s", "SELECT 'n' || n_nationkey || '.txt' AS file, substr(sha256(n_name), 1, 12) AS fingerprint FROM nation")
def _(spark, d):
    path = place(spark)
    for r in fx.table(spark, d, "nation").collect():
        put(spark, f"{path}/n{r['n_nationkey']}.txt", r["n_name"])
    return rc.fingerprints(spark, path)


@query("cohort_catalogue", "cohort:s n_reports:i n_gold:i", sql("SELECT 'even' AS cohort, count_if(report % 2 = 0) AS n_reports, (SELECT count(*) FROM gold WHERE report % 2 = 0) AS n_gold FROM reports UNION ALL SELECT 'all', count(*), (SELECT count(*) FROM gold) FROM reports", "gold", "reports"))
def _(spark, d):
    """Cohorts by name, one of them restricted to listed reports."""
    both = {"all": (lambda s: fx.reports(s, d), lambda s: fx.gold(s, d)), "even": (lambda s: fx.reports(s, d), lambda s: fx.gold(s, d))}
    out = None
    for name, only in (("all", None), ("even", fx.reports(spark, d).where("report % 2 = 0"))):
        r, y = rc.cohort(spark, name, both, only)
        part = r.agg(F.count(F.lit(1)).alias("n_reports")).crossJoin(y.agg(F.count(F.lit(1)).alias("n_gold"))).select(F.lit(name).alias("cohort"), "n_reports", "n_gold")
        out = part if out is None else out.unionByName(part)
    return out


@query("first_texts", "report:s text:s", "SELECT CAST(p_partkey AS VARCHAR) AS report, p_name || ', \"quoted\"' || chr(10) || 'line' AS text FROM part")
def _(spark, d):
    """The first text that a report's rows give; cells hold quotes, commas and line ends."""
    path = place(spark)
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(', "quoted"\nline')).alias("body"))
    rows = p.select("id", F.explode(F.array(F.lit(None).cast("string"), F.col("body"), F.lit("later"))).alias("body"))
    rows.write.csv(path, header=True, quoteAll=True, escape='"')
    return rc.first_texts(spark, path, "id", "body")
