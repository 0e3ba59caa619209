"""Further readers: annotation tables of several makes in one schema, lists of ids, blocks of text, archives of scores, grids of
files, and what a folder holds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemark.functions.codes import flag, parse_codes
from grovemark.sources.readers import read_calls, read_jsonl, required

#: The schema that annotation tables are brought to.
RECORD = "report string, code string, name string, trigger string, segment int, context string, offset int, confirmed boolean, source string"
TRAVERSAL = "report_id string, n_unique_nodes_visited int, total_frontier_insertions int, n_slm_calls int, n_accepted int, depth_table array<struct<depth: int, n_visited: int, n_expanded: int, n_accepted: int, n_slm_calls: int, cumulative_visited: int>>"
CANDIDATES = "report_id string, summary boolean, candidates array<string>"


def file_name() -> Column:
    return F.col("_metadata.file_name")


def read_ids(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    """report: the first column of every line but blank ones, comments and a header of the given name; once each."""
    first = F.trim(F.regexp_replace(F.split("value", ",")[0], '"', ""))
    ids = spark.read.text(path).select(first.alias("report")).where((F.col("report") != "") & ~F.col("report").startswith("#"))
    return (ids if header is None else ids.where(F.lower("report") != header.lower())).distinct()


def read_annotations(spark: SparkSession, path: str, source: str, columns: dict[str, str]) -> DataFrame:
    """RECORD from a table whose columns go by other names (columns: ours to theirs); absent ones are null. Cells that don't
    read as numbers or flags are null; rows without report or code go."""
    rows = required(spark.read.csv(path, header=True, multiLine=True, escape='"'), columns["report"], columns["code"])
    out = []
    for part in RECORD.split(", ")[:-1]:
        name, kind = part.split()
        c = F.col(f"`{columns[name]}`") if columns.get(name) in rows.columns else F.lit(None).cast("string")
        c = flag(c) if kind == "boolean" else c.try_cast("double").try_cast("int") if kind == "int" else F.when(F.trim(c) != "", F.trim(c))
        out.append(c.alias(name))
    return rows.select(*out, F.lit(source).alias("source")).where("report is not null and code is not null")


def first_texts(spark: SparkSession, path: str, report: str, text: str) -> DataFrame:
    """report, text: the first text that a table's rows give for a report, in the file's order."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("__n", F.monotonically_increasing_id())
    return rows.where(F.col(text).isNotNull()).groupBy(F.col(report).alias("report")).agg(F.min_by(text, "__n").alias("text"))


def read_positional(spark: SparkSession, path: str) -> DataFrame:
    """report, idx, term: the first two columns whatever their names; codes in order, once each."""
    rows = spark.read.csv(path, header=True)
    return rows.select(F.col(f"`{rows.columns[0]}`").alias("report"), F.posexplode(parse_codes(F.col(f"`{rows.columns[1]}`"))).alias("idx", "term"))


def read_either_delimiter(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, line, cells) of tables whose header tells by a semicolon that it parts them, else a comma; and the files of
    which a line has another number of cells than the header."""
    files = spark.read.text(path, wholetext=True).select(file_name().alias("file"), F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("lines"))
    mark = F.when(F.get("lines", F.lit(0)).contains(";"), ";").otherwise(",")
    cut = files.withColumn("mark", mark).withColumn("n", F.size(F.split(F.get("lines", F.lit(0)), F.col("mark"))))
    rows = cut.select("file", "n", F.posexplode(F.transform("lines", lambda x: F.split(x, F.col("mark")))).alias("line", "cells"))
    bad = rows.where(F.size("cells") != F.col("n")).select("file").distinct()
    return rows.where("line > 0").join(bad, "file", "left_anti").select("file", "line", "cells"), bad


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """report_id, rank, term: the ranked candidates of the summary rows."""
    return read_jsonl(spark, path, CANDIDATES, strict=False).where("summary").select("report_id", F.posexplode("candidates").alias("p", "term")).select("report_id", (F.col("p") + 1).alias("rank"), "term")


def read_traversal(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, TRAVERSAL, strict=False).where("report_id is not null")


def depth_rows(traversal: DataFrame) -> DataFrame:
    """report_id, depth, n_visited, n_calls, calls_per_visit of the nested tables."""
    r = traversal.select("report_id", F.explode("depth_table").alias("t"))
    return r.select("report_id", "t.depth", "t.n_visited", F.col("t.n_slm_calls").alias("n_calls"), F.coalesce(F.try_divide(F.col("t.n_slm_calls"), F.col("t.n_visited")), F.lit(0.0)).alias("calls_per_visit"))


def context_types(spark: SparkSession, path: str) -> DataFrame:
    return read_calls(spark, path, None).select("ctx_type").where("ctx_type is not null").distinct()


def ranked_segments(calls: DataFrame) -> DataFrame:
    """report_id, hpo_id, segments: the segments of each pair in order of rank."""
    r = F.array_sort(F.collect_list(F.struct("rank", "sent_index")))
    return calls.groupBy("report_id", "hpo_id").agg(F.transform(r, lambda s: s.sent_index).alias("segments"))


def write_archive(calls: DataFrame, path: str, index: str, tau: float) -> None:
    """Calls as Parquet by index, sorted by report, so that a reader prunes to the reports it asks for; the threshold they were
    made at goes beside them."""
    rows = calls.withColumn("retrieval_index", F.lit(index)).repartition("report_id").sortWithinPartitions("report_id", "hpo_id", "rank")
    rows.write.mode("append").partitionBy("retrieval_index").parquet(f"{path}/calls")
    calls.sparkSession.range(1).select(F.lit(index).alias("retrieval_index"), F.lit(tau).alias("tau"), F.lit(calls.columns).alias("columns")).write.mode("append").parquet(f"{path}/provenance")


def read_archive(spark: SparkSession, path: str, index: str, reports: DataFrame | None = None, columns: Sequence[str] = ("report_id", "hpo_id", "rank", "margin")) -> DataFrame:
    """Some columns of one index's calls, of the listed reports(report_id) if given."""
    rows = spark.read.parquet(f"{path}/calls").where(F.col("retrieval_index") == index).select(*columns)
    return rows if reports is None else rows.join(reports.select("report_id").distinct(), "report_id", "left_semi")


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/provenance")


def read_grid(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """prompt, normaliser, model and the rows of files named detections_<model>__<normaliser>.jsonl in a folder per prompt; a
    juror's repeated rows count once."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{path}/*/detections_*.jsonl")
    at = lambda i: F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/detections_(.+)__([^/]+)\.jsonl$", i)
    names = [f.name for f in rows.schema]
    return rows.select(at(1).alias("prompt"), at(3).alias("normaliser"), at(2).alias("model"), *names).distinct()


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """report, start, stop, mention, term, score of blocks parted by blank lines: an id, a text, then lines of five cells
    parted by tabs; a block without hits keeps one row of nulls."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n[ \t]*\n")).alias("b")).where(F.trim("b") != "")
    lines = F.filter(F.split("b", "\n"), lambda x: x != "")
    hits = F.filter(F.transform(F.slice(lines, 3, 1 << 20), lambda x: F.split(x, "\t")), lambda p: F.size(p) >= 5)
    rows = blocks.select(F.trim(F.get(lines, F.lit(0))).alias("report"), F.explode_outer(hits).alias("p"))
    at = lambda i: F.get("p", F.lit(i))
    return rows.select("report", at(0).try_cast("int").alias("start"), at(1).try_cast("int").alias("stop"), at(2).alias("mention"), at(3).alias("term"), at(4).try_cast("double").alias("score"))


def block_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row: blocks, hit lines, distinct terms, and lines after the text that don't have five cells."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n[ \t]*\n")).alias("b")).where(F.trim("b") != "")
    cells = F.transform(F.slice(F.filter(F.split("b", "\n"), lambda x: x != ""), 3, 1 << 20), lambda x: F.split(x, "\t"))
    good = F.filter("cells", lambda p: F.size(p) >= 5)
    per = blocks.select(cells.alias("cells")).select(F.size(good).alias("n"), (F.size("cells") - F.size(good)).alias("bad"), F.transform(good, lambda p: p[3]).alias("terms"))
    terms = per.select(F.explode("terms").alias("t")).agg(F.count_distinct("t").alias("n_terms"))
    return per.agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("n").alias("n_hits"), F.sum("bad").alias("n_unparsed")).crossJoin(terms).select("n_blocks", "n_hits", "n_terms", "n_unparsed")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """file, fingerprint: the first twelve hex digits of each file's SHA-256."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return spark.read.format("binaryFile").load(path).select(name.alias("file"), F.substring(F.sha2("content", 256), 1, 12).alias("fingerprint"))


def newest(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path: of the files whose names match, the one last changed, of equal ones the last by name."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime").where(F.regexp_extract("path", r"([^/]+)$", 1).rlike(pattern))
    return files.agg(F.max(F.struct("modificationTime", "path")).alias("x")).where("x is not null").select("x.path")


def cohort(spark: SparkSession, name: str, readers: dict[str, tuple[Callable[[SparkSession], DataFrame], Callable[[SparkSession], DataFrame]]], only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The reports and the gold of a cohort, by the two readers that its name stands for, restricted to the reports in only."""
    if name not in readers:
        raise KeyError(f"no cohort {name}; known: {', '.join(sorted(readers))}")
    reports, gold = (f(spark) for f in readers[name])
    if only is None:
        return reports, gold
    ids = only.select("report").distinct()
    return reports.join(ids, "report", "left_semi"), gold.join(ids, "report", "left_semi")
