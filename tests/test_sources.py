"""Readers, sinks and streaming folds over small files, torn and odd ones included."""

import json

import pytest
from pyspark.sql import functions as F

from grovemark.operators import curation
from grovemark.sources import readers, writers
from grovemark.streaming import folds

D = "/root/testdata/sf0.001"


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_reports(spark, tmp_path):
    put(tmp_path / "r" / "b.txt", "two\nlines é")
    put(tmp_path / "r" / "a.x.txt", "")
    put(tmp_path / "r" / "c.csv", "no")
    assert got(readers.read_reports(spark, str(tmp_path / "r"))) == [("a.x", ""), ("b", "two\nlines é")]
    put(tmp_path / "l" / "HP_1.txt", "* é one\n\n - two", "latin-1")
    assert got(readers.read_context(spark, str(tmp_path / "l"))) == [("HP:1", 0, "é one"), ("HP:1", 1, "two")]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no report"):
        readers.read_reports(spark, str(tmp_path / "none"))


def test_span_annotations(spark, tmp_path):
    put(tmp_path / "a" / "12", "0:4\tHP:0000001\tone two\nbad\n5:9\tHP:1\tx\n")
    put(tmp_path / "a" / "13", "\n")
    assert got(readers.read_span_annotations(spark, str(tmp_path / "a"))) == [("12", 0, 4, "HP:0000001", "one two"), ("13", None, None, None, None)]


def test_calls_and_cache(spark, tmp_path):
    rows = [{"report_id": "r", "hpo_id": "t", "ctx_type": c, "rank": k, "margin": m} for c, k, m in (("union", 2, 0.5), ("union", 1, -1.0), ("own", 1, 9.0))]
    p = put(tmp_path / "calls.jsonl", "\n".join(map(json.dumps, rows)) + '\n{"report_id": "r", "hp')
    calls = readers.read_calls(spark, p)
    assert got(readers.score_cache(calls)) == [("r", "t", [-1.0, 0.5])]
    assert readers.read_calls(spark, p, None).count() == 3 and readers.malformed(spark, p) == 1
    assert readers.read_calls(spark, p, reports=spark.createDataFrame([("x",)], "report_id string")).count() == 0
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, p, readers.CALLS).collect()


def test_detections_and_summaries(spark, tmp_path):
    p = put(tmp_path / "d.jsonl", '{"report_id":"a","sentence_number":1,"hpo_id":"t","count":2}\n{"patient_id":"a","sentence_number":1,"hpo_id":"t"}\n{"report_id":"a"}\n')
    d = readers.read_detections(spark, p)
    assert got(d) == [("a", 1, "t", 3)]
    writers.write_detections(d, str(tmp_path / "out"))
    assert [json.loads(x.value) for x in spark.read.text(str(tmp_path / "out")).collect()] == [{"report": "a", "segment": 1, "term": "t", "count": 3}]
    p = put(tmp_path / "s.jsonl", '{"report_id":"a","summary":true,"predicted_set":[],"gold_set":["t"]}\n{"report_id":"a","hpo_id":"t"}\n')
    assert got(readers.read_summaries(spark, p)) == [("a", [], ["t"])]


def test_ontology(spark, tmp_path):
    p = put(tmp_path / "o.json", json.dumps({"A": {"Id": "A", "Name": ["root"], "Is_a": []}, "B": {"Id": "B", "Name": ["leaf"], "Alt_id": ["B2"], "Is_a": ["A ! root"], "Other": 1}}, indent=1))
    assert got(readers.read_ontology(spark, p)) == [("A", "root", [], None, [], []), ("B", "leaf", ["B2"], None, [], ["A"])]


def test_prediction_sets_round_trip(spark, tmp_path):
    rows = [("r1", "T2"), ("r1", "T1"), ("r2", None)]
    writers.write_prediction_sets(spark.createDataFrame(rows, "report string, term string"), str(tmp_path / "p"))
    assert got(readers.read_prediction_sets(spark, str(tmp_path / "p"))) == sorted(rows, key=repr)
    rows = spark.createDataFrame([("r1", "T1", "approved"), ("r1", "T2", "rejected")], "report string, term string, status string")
    writers.export_gold(rows, spark.createDataFrame([("r1",), ("r2",)], "report string"), str(tmp_path / "g"))
    assert got(readers.read_prediction_sets(spark, str(tmp_path / "g"))) == [("r1", "T1"), ("r2", None)]


def test_segments_and_curated(spark, tmp_path):
    p = put(tmp_path / "s.csv", 'patient_id,sentence_idx,sentence\np,0,"a ""b""\nc"\n')
    assert got(readers.read_segments(spark, p)) == [("p", 0, 'a "b"\nc')]
    with pytest.raises(ValueError, match="absent"):
        readers.read_segments(spark, put(tmp_path / "x.csv", "patient_id,s\np,0\n"))
    p = put(tmp_path / "c.csv", "patient_id,segment_idx,hpo_code,in_gold\np,1,T,True.\np,,T,yes\np,2,T,no\n")
    assert readers.read_curated(spark, p).count() == 1 and readers.read_curated(spark, p, gold_only=False).count() == 2


def test_tagger_and_logs(spark, tmp_path):
    p = put(tmp_path / "t" / "r.tsv", "0\t4\tone\ntwo\tT1\t0.5\t\n9\t12\tabc\tT2\t0.9\tNeg\n")
    assert got(readers.read_tagger(spark, p)) == [("r", 0, 4, "one\ntwo", "T1", 0.5, False), ("r", 9, 12, "abc", "T2", 0.9, True)]
    put(tmp_path / "logs" / "a.log", "1 reports in 2.0s\n3 reports in 4.5s\n")
    put(tmp_path / "logs" / "b.log", "nothing")
    assert got(readers.read_log_costs(spark, str(tmp_path / "logs"), r"(\d+) reports in ([\d.]+)s", ("n", "s"))) == [("a", 3.0, 4.5)]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.12345, None), ("c&d", 1.0, 2)], "x string, y double, z int").coalesce(1)
    assert writers.markdown_table(df).splitlines() == ["| x | y | z |", "| --- | --- | --- |", "| a\\|b | 0.123 |  |", "| c&d | 1.000 | 2 |"]
    assert r"c\&d & 1.000 & 2 \\" in writers.latex_table(df, "t", "l")
    writers.write_csv(spark.createDataFrame([("a\nb", ["x", "y"])], "x string, y array<string>"), str(tmp_path / "c"))
    assert got(spark.read.csv(str(tmp_path / "c"), header=True)) == [("a b", "x;y")]
    lines = spark.createDataFrame([('{"k":"1"}',), ('{"k":"1"}',), ("",), ('{"k":"2"}',)], "value string")
    assert got(writers.merge_lines(lines, "k")) == [('{"k":"1"}', "1"), ('{"k":"2"}', "2")]


def test_folds_file(spark, tmp_path):
    f = spark.createDataFrame([(0, 1, 7, "r", 2, "eval"), (0, 1, 3, "s", 2, "train")], "repetition int, outer_fold int, inner_fold int, report string, stratum int, role string")
    writers.write_folds(f, str(tmp_path / "f"))
    assert got(spark.read.csv(str(tmp_path / "f"), header=True).select("report", "inner_fold")) == [("r", "-1"), ("s", "3")]


def test_log_stream_equals_batch(spark, tmp_path):
    put(tmp_path / "e" / "1.jsonl", '{"event_id":"1","action":"label","labels":["old"],"target_key":"k"}\n{"event_id":"2"}\n')
    put(tmp_path / "e" / "2.jsonl", '{"event_id":"3","action":"reject","target_key":"k"}\n{"event_id":"4","act')
    batch = readers.read_events(spark, str(tmp_path / "e"), {"old": "new"})
    assert got(batch.select("event_id", "labels")) == [("1", ["new"]), ("3", None)]
    stream = readers.read_events(spark, str(tmp_path / "e"), stream=True).withColumnRenamed("target_key", "key")
    folds.fold_stream(stream, "fold_log", str(tmp_path / "ck")).awaitTermination(60)
    assert got(spark.table("fold_log")) == got(curation.last_event(batch.withColumnRenamed("target_key", "key")))


def test_streams_equal_batches(spark, tmp_path):
    e = spark.read.parquet(f"{D}/events.parquet")
    e.repartition(4).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "ev"))
    folds.fold_stream(stream.select(F.col("user_id").alias("key"), F.col("event_type").alias("action"), "event_id"), "fold_ev", str(tmp_path / "c1")).awaitTermination(60)
    want = curation.last_event(e.select(F.col("user_id").alias("key"), F.col("event_type").alias("action"), "event_id"))
    assert got(spark.table("fold_ev")) == got(want)
    q = folds.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert got(spark.table("win")) == got(folds.windowed_counts(e))


def test_fold_state(spark):
    log = [(1, "a", "approve", None), (2, "a", "suggest", None), (3, "a", "label", "x"), (4, "a", "withdraw", None), (5, "b", "withdraw", None), (6, "b", "edit", "v"), (7, "b", "edit", None), (8, "c", "suggest", None), (9, "c", "withdraw", None), (10, "c", "suggest", None), (11, "c", "odd", None), (12, "c", None, None)]
    out = curation.fold_state(spark.createDataFrame(log, "event_id int, key string, action string, payload string"))
    assert got(out.select("key", "removed", "status", "label", "edit", "n", "n_unknown")) == [
        ("a", True, None, None, None, 4, 0), ("b", False, None, None, None, 3, 0), ("c", False, "suggested", None, None, 5, 2),
    ]
