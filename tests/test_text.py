"""Text operators that have no SQL to hold them against: plain versions of the same rules."""

import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from grovemark.functions import codes
from grovemark.operators import fuzzy, placement, text

D = "/root/testdata/sf0.001"


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c"))).first()[0]


def test_segments(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    want = []
    for doc_id, t in docs.collect():
        if t is not None:
            parts = [p.strip(" ") for p in re.split(r"\n|(?<=[.!?])[ \t]+(?=[A-Z0-9])", t)]
            want += [(doc_id, i, p) for i, p in enumerate([p for p in parts if len(p) > 3])]
    got = [tuple(r) for r in text.segments(docs, "doc_id", "text").collect()]
    assert sorted(got) == sorted(want)


def test_codes(spark):
    for cell, want in (("['A1', 'B0', 'A1']", ["A1", "B0"]), ("A1; B0 ;", ["A1", "B0"]), ("B0, A1", ["B0", "A1"]), ("", []), (None, [])):
        assert one(spark, cell, codes.parse_codes) == want
    for cell, want in ((" HP_0001 ", "HP:0001"), ("HP0001", "HP:0001"), ("HP:HP:0001", "HP:0001"), ("x", "x"), (None, None)):
        assert one(spark, cell, codes.normal_code) == want
    for cell, want in ((" TRUE.", True), ("no", False), ("maybe", None), (None, None)):
        assert one(spark, cell, codes.flag) is want
    for cell, want in (("1:02:03", 3723.0), ("2:05", 125.0), ("x", None), ("a:b", None)):
        assert one(spark, cell, codes.seconds) == want
    assert one(spark, -1000.0, codes.sigmoid, "double") == 0.0 and one(spark, 1000.0, codes.sigmoid, "double") == 1.0


def test_fuzzy(spark):
    names = ["small ring", "large ring", "red widget", "macrocytosis", "microcytosis", "ab", ""]
    asked = ["smal ring", "larg ring", "red  Widgets", "macrocitosis", "ab", "zz"]
    surfaces = spark.createDataFrame([(f"T{i}", n) for i, n in enumerate(names)], "term string, surface string")
    mentions = spark.createDataFrame(list(enumerate(asked)), "id int, mention string")
    got = sorted((r.id, r.term, round(r.score, 9)) for r in fuzzy.fuzzy(mentions, surfaces).collect())

    def crosses(a, b):
        return any((x in a) != (y in a) and (x in b) != (y in b) and (x in a) != (x in b) for x, y in fuzzy.OPPOSITES)

    want = []
    for i, m in enumerate(asked):
        a = " ".join(m.lower().split())
        for k, b in enumerate(names):
            score = SequenceMatcher(None, a, b).ratio()
            if score >= 0.82 and not crosses(a, b):
                want.append((i, f"T{k}", round(score, 9)))
    assert got == sorted(want) and (3, "T4") not in [x[:2] for x in got]


def test_placement(spark):
    docs = spark.createDataFrame([(1, "a 12\n\n345 x 6"), (2, ""), (3, None), (4, "7\n")], "doc_id int, text string")
    found = placement.matches(docs, "doc_id", "text", "[0-9]+")
    got = placement.place(placement.line_ranges(docs, "doc_id", "text"), found, "doc_id")
    assert sorted(map(tuple, got.select("doc_id", "ordinal", "start", "matched", "segment_idx").collect())) == [
        (1, 0, 2, "12", 0), (1, 1, 6, "345", 2), (1, 2, 12, "6", 2), (4, 0, 0, "7", 0),
    ]
