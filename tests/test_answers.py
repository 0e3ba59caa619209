"""Replies with letters beyond ASCII next to yes and no, with reasoning and with boxed answers, against the query's own SQL."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from grovemark.operators.text import answer
from grovemark.plans import catalog

TEXTS = ["domiue noñcobomen", "yes, ño", "Yes ... no1 no_", "éyes", "nó", "NO. yes", None, "", "nothing yesterday"]


def test_answers_agree_with_sql_beyond_ascii(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(catalog.ORACLES["parse_yes_no"]).fetchall())
    got = sorted(tuple(r) for r in catalog.QUERIES["parse_yes_no"](spark, str(tmp_path)).select("answer", "n").collect())
    assert got == want


BOX = r"\boxed{"
TOLD = [
    ("<think>no</think> Yes", "YES"), ("No.\n<THINK>or\nyes", "NO"), ("perhaps yes </think>\n\nNo", "NO"), ("Yes </think> unclear </think>", "AMBIGUOUS"),
    ("No <unused94>yes<unused95>", "NO"), ("<unused94>no</unused95>Yes", "YES"), ("No <unused94>cut off, yes", "NO"), ("<think>yes", "AMBIGUOUS"), ("n<think></think>o", "AMBIGUOUS"),
    (BOX + "Yes}, not no", "YES"), (r"\BOXED{" + "\n NO such} yes", "NO"), (BOX + "nothing} yes", "NO"), (BOX + "maybe} " + BOX + "no} or yes", "YES"), (BOX + r"\text{yes}} no", "NO"),
    (BOX + "yes or no", "NO"), (BOX + "} yes", "YES"), ("<think>" + BOX + "yes}</think>" + BOX + "no} yes", "NO"), (BOX + "unsure}", "AMBIGUOUS"), ("İno", "AMBIGUOUS"),
]


def test_answers_come_from_the_reply_without_reasoning_and_boxes_go_first(spark, tmp_path):
    con = duckdb.connect()
    spark.createDataFrame(list(enumerate(t for t, _ in TOLD)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", answer(F.col("text"))).collect())
    assert [(t, got[i]) for i, (t, _) in enumerate(TOLD)] == TOLD
    con.execute("create table documents (text varchar)")
    for t, a in TOLD:
        con.execute("delete from documents")
        con.execute("insert into documents values (?)", [t])
        assert (t, con.execute(catalog.ORACLES["parse_yes_no"]).fetchall()) == (t, [(a, 1)])
    want = Counter(a for _, a in TOLD)
    assert dict(tuple(r) for r in catalog.QUERIES["parse_yes_no"](spark, str(tmp_path)).select("answer", "n").collect()) == want
