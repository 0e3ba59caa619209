"""Readers of the annotation formats. Each gives a long DataFrame; what a tolerant reader leaves out can be counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovemark.functions.codes import flag, parse_codes

CALLS = "report_id string, hpo_id string, ctx_type string, rank int, sent_index int, cosine_sim double, logit_yes double, logit_no double, logsumexp_all double, margin double, verdict string"
DETECTIONS = "report_id string, patient_id string, sentence_number int, hpo_id string, count long"
SUMMARY = "report_id string, summary boolean, predicted_set array<string>, gold_set array<string>"
NODES = "report_id string, hpo_id string, depth int, prune_score double, accept_score double, expanded boolean, accepted boolean, is_gold int"
LINKAGE = "report_id string, sentence_number int, line_index int, candidate_string string, normaliser string, hpo_id string, score double, source string, negated boolean"
EVENTS = "event_id string, ts string, author string, action string, patient_id string, target_key string, segment_idx int, segment_text string, hpo_code string, hpo_name string, trigger_word string, status string, labels array<string>, difficulty string, note string, text string"
TERM = "struct<Id: string, Name: array<string>, Alt_id: array<string>, Def: array<string>, Synonym: array<string>, Is_a: array<string>>"


def stem() -> Column:
    """The name of the file that a row comes from, without folder and ending."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)


def required(df: DataFrame, *columns: str) -> DataFrame:
    if absent := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns absent: {', '.join(absent)}; found: {', '.join(df.columns)}")
    return df


def read_reports(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """report (file name without ending), text: one row per .txt file, empty ones too; an error where there is none."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    # binaryFile, as whole texts can be read in UTF-8 only; paths name the file.
    name = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    out = raw.select(name.alias("report"), F.decode("content", encoding).alias("text"))
    # A scan leaves out files of no length.
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    blank = [f.getPath().getName()[:-4] for f in found if f.isFile() and f.getLen() == 0 and f.getPath().getName().endswith(".txt")]
    if blank:
        out = out.unionByName(spark.createDataFrame([(n, "") for n in blank], "report string, text string"))
    if out.isEmpty():
        raise ValueError(f"no report in {path}")
    return out


def read_context(spark: SparkSession, path: str) -> DataFrame:
    """term, idx, line: Latin-1 files named after a term (_ for :), their lines without blank ones and one leading bullet."""
    texts = read_reports(spark, path, "ISO-8859-1")
    clean = F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*[*\-•·]\s*", "")))
    return texts.select(F.replace("report", F.lit("_"), F.lit(":")).alias("term"), F.posexplode(F.filter(clean, lambda x: x != "")).alias("idx", "line"))


def read_span_annotations(spark: SparkSession, path: str, code: str = "HP:[0-9]{7}") -> DataFrame:
    """report, start, stop, term, mention of files with lines start:stop, code and mention, parted by tabs. A file without a
    valid line keeps one row of nulls; hidden and sidecar files don't count."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^([^.]*)", 1).alias("report"), F.col("_metadata.file_name").alias("f"), "value")
    lines = lines.where(~F.col("f").startswith("._") & ~F.col("f").endswith("Zone.Identifier"))
    part = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.split(x, "\t")), lambda p: (F.size(p) >= 2) & F.get(p, F.lit(1)).rlike(f"^{code}$") & F.get(p, F.lit(0)).rlike("^[0-9]+:[0-9]+$"))
    rows = lines.select("report", F.explode_outer(part).alias("p"))
    at = F.split(F.get("p", F.lit(0)), ":")
    return rows.select("report", at[0].cast("int").alias("start"), at[1].cast("int").alias("stop"), F.get("p", F.lit(1)).alias("term"), F.get("p", F.lit(2)).alias("mention"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """Strict: a malformed line fails; else it is dropped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def malformed(spark: SparkSession, path: str) -> int:
    """How many lines that are not blank a tolerant reader drops."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.where(F.try_parse_json("value").isNull()).count()


def read_calls(spark: SparkSession, path: str, ctx_type: str | None = "union", reports: DataFrame | None = None) -> DataFrame:
    """The verifier's calls of one kind of context, of the listed reports(report_id) if given; torn lines are dropped."""
    rows = read_jsonl(spark, path, CALLS, strict=False)
    rows = rows if ctx_type is None else rows.where(F.col("ctx_type") == ctx_type)
    return rows if reports is None else rows.join(reports.select("report_id").distinct(), "report_id", "left_semi")


def score_cache(calls: DataFrame) -> DataFrame:
    """report_id, hpo_id, margins in order of rank: the columnar form of the calls. Written as Parquet sorted by report it
    prunes by report and needs no index of offsets."""
    row = F.array_sort(F.collect_list(F.struct("rank", "margin")))
    return calls.groupBy("report_id", "hpo_id").agg(F.transform(row, lambda s: s["margin"]).alias("margins"))


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """report, segment, term, count: either name of the report's column, repeated rows summed, incomplete ones dropped."""
    rows = read_jsonl(spark, path, DETECTIONS, strict=False)
    report, n = F.coalesce("report_id", "patient_id"), F.coalesce("count", F.lit(1))
    rows = rows.where(report.isNotNull() & F.col("hpo_id").isNotNull() & F.col("sentence_number").isNotNull())
    return rows.groupBy(report.alias("report"), F.col("sentence_number").alias("segment"), F.col("hpo_id").alias("term")).agg(F.sum(n).alias("count"))


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """report_id, predicted_set, gold_set of the summary rows only; empty sets stay."""
    return read_jsonl(spark, path, SUMMARY, strict=False).where("summary").drop("summary")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, NODES, strict=False).where("report_id is not null")


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """term, label, alt_ids, definition, synonyms, parents from one JSON object of id and record."""
    records = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{TERM}>")).alias("term", "r"))
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    first = lambda c: F.get(F.col(c), F.lit(0))
    codes = F.transform(listed("r.Is_a"), lambda x: F.trim(F.split(x, "!")[0]))
    return records.select("term", first("r.Name").alias("label"), listed("r.Alt_id").alias("alt_ids"), first("r.Def").alias("definition"), listed("r.Synonym").alias("synonyms"), codes.alias("parents"))


def read_prediction_sets(spark: SparkSession, path: str) -> DataFrame:
    """report, term from two columns, an id and codes split at ; or ,; ids without codes keep one row with null. The
    header's names don't count."""
    rows = spark.read.csv(path, header=True)
    if len(rows.columns) != 2:
        raise ValueError(f"two columns wanted, found: {', '.join(rows.columns)}")
    return rows.toDF("report", "codes").select("report", F.explode_outer(parse_codes(F.col("codes"))).alias("term"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """patient_id, sentence_idx, sentence; an error where a column is absent."""
    rows = required(spark.read.csv(path, header=True, multiLine=True, escape='"'), "patient_id", "sentence_idx", "sentence")
    return rows.select("patient_id", F.col("sentence_idx").try_cast("int").alias("sentence_idx"), "sentence")


def read_curated(spark: SparkSession, path: str, gold_only: bool = True) -> DataFrame:
    """Located annotations, of the gold set only if asked; flags may be spelled freely."""
    rows = required(spark.read.csv(path, header=True, multiLine=True, escape='"'), "patient_id", "segment_idx", "hpo_code", "in_gold")
    rows = rows.withColumn("in_gold", flag(F.col("in_gold"))).withColumn("segment_idx", F.col("segment_idx").try_cast("int")).where("segment_idx is not null")
    return rows.where("in_gold") if gold_only else rows


def read_events(spark: SparkSession, path: str, aliases: dict[str, str] | None = None, stream: bool = False) -> DataFrame:
    """The curation log, as a batch or a stream of new files: lines without an action and torn ones go; labels by their
    present names."""
    source = spark.readStream if stream else spark.read
    rows = source.schema(EVENTS).option("mode", "DROPMALFORMED").json(path).where("action is not null")
    if not aliases:
        return rows
    now = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return rows.withColumn("labels", F.transform("labels", lambda x: F.coalesce(F.try_element_at(now, x), x)))


def read_tagger(spark: SparkSession, path: str) -> DataFrame:
    """report, start, stop, phrase, term, score, negated of a tagger's tables. A phrase may hold line ends: a record runs up
    to the next line that starts with two integers."""
    files = spark.read.text(path, wholetext=True).select(stem().alias("report"), "value")
    rows = files.select("report", F.explode(F.split("value", r"\r?\n(?=[0-9]+\t[0-9]+\t)")).alias("line")).where(F.col("line").rlike(r"^[0-9]+\t[0-9]+\t"))
    p = F.split("line", "\t")
    at = lambda i: F.get(p, F.lit(i))
    return rows.select(
        "report", at(0).cast("int").alias("start"), at(1).cast("int").alias("stop"), at(2).alias("phrase"), F.trim(at(3)).alias("term"),
        at(4).try_cast("double").alias("score"), F.coalesce(F.lower(F.trim(at(5))).startswith("neg"), F.lit(False)).alias("negated"),
    )


def read_reference_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table with lines of comment before its header."""
    return spark.read.csv(path, header=True, comment="#")


def read_log_costs(spark: SparkSession, path: str, pattern: str, names: tuple[str, ...]) -> DataFrame:
    """file and the pattern's groups as doubles under names: the last match of each file of free text."""
    files = spark.read.text(path, wholetext=True).select(stem().alias("file"), "value")
    groups = [F.try_element_at(F.regexp_extract_all("value", F.lit(pattern), F.lit(i + 1)), F.lit(-1)).try_cast("double").alias(n) for i, n in enumerate(names)]
    return files.select("file", *groups).where(F.col(names[0]).isNotNull())
