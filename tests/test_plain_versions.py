"""Operators that SQL does not express, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovemark.functions import replies, scalars
from grovemark.operators import alignment, calmaps, graph, merging, nested, ontology, selection, spans, staging, traversal
from grovemark.sources import resume


def plain_smooth(rows, width):
    """Kernel-smoothed residuals on a fine grid, summed over the mirror images of every row."""
    t = np.linspace(0, 1, 2001)
    total = np.zeros_like(t)
    for c, y in rows:
        for k in range(-3, 4):
            for at in (c + 2 * k, -c + 2 * k):
                total += (y - c) * np.exp(-0.5 * ((t - at) / width) ** 2)
    return np.trapezoid(np.abs(total), t) / (len(rows) * width * math.sqrt(2 * math.pi))


def test_smooth_ece(spark):
    rng = np.random.default_rng(2)
    rows = [(float(c), int(rng.random() < c**2)) for c in rng.random(400)]
    got = calmaps.smooth_ece(spark.createDataFrame(rows, "conf double, label int")).first()["smooth_ece"]
    low, high = 1e-3, 1.0
    while high - low > 1e-3:
        mid = (low + high) / 2
        low, high = (low, mid) if plain_smooth(rows, mid) < mid else (mid, high)
    assert abs(got - plain_smooth(rows, high)) < 3e-3
    even = [(0.25, 1), (0.25, 0), (0.25, 0), (0.25, 0)] * 50
    assert calmaps.smooth_ece(spark.createDataFrame(even, "conf double, label int")).first()["smooth_ece"] < 2e-3


def test_platt_falls_where_scores_mislead(spark):
    rows = [(i / 100, int(i % 3 == 0)) for i in range(100)] + [(0.9, 1), (0.1, 0)]
    fit = calmaps.platt(calmaps.atoms(spark.createDataFrame(rows, "conf double, label int"))).first()
    grad = sum((y - 1 / (1 + math.exp(-(fit["slope"] * c + fit["intercept"])))) * c for c, y in rows) - fit["slope"]
    assert abs(grad) < 1e-8


def plain_align(text, segments):
    norm = " ".join(text.split()).lower()
    out, cursor = [], 0
    for s in segments:
        n = " ".join((s or "").split()).lower()
        k = norm.find(n, cursor) if n else -1
        if n and k < 0:
            k = norm.find(n)
        out.append(k if k >= 0 else None)
        cursor = max(cursor, k + len(n)) if k >= 0 else cursor
    return out


def test_align_odd_texts(spark):
    cases = {1: ("A  b\n\nc a B", ["a b", "C", "a b", "x", None, ""]), 2: ("", ["a"]), 3: (None, ["a"]), 4: ("Äb ÄB äb", ["äb", "ÄB", "äb", "äb"]), 5: ("tail  ", ["tail", " tail "])}
    texts = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "report long, text string")
    segs = spark.createDataFrame([(k, i, s) for k, (_, ss) in cases.items() for i, s in enumerate(ss)], "report long, segment_idx int, segment string")
    got = {(r["report"], r["segment_idx"]): r for r in alignment.align(texts, segs).collect()}
    for k, (t, ss) in cases.items():
        for i, (s, at) in enumerate(zip(ss, plain_align(t or "", ss), strict=True)):
            r = got[k, i]
            assert r["at"] == at
            if at is not None:
                assert " ".join(t[r["start"] : r["end"]].split()).lower() == " ".join(s.split()).lower()
    assert alignment.align(texts.limit(0), segs.limit(0)).count() == 0


def test_find_trigger(spark):
    rows = [("delayed and Delay here", "delay", (12, 17)), ("hypotonia", "hypoton", (0, 7)), ("Serum\t Ammonia 87", "serum ammonia", (0, 14)), ("a+b (c)", "+b (c)", (1, 7)), ("x", "  ", None), ("x", "y", None)]
    df = spark.createDataFrame([(t, w) for t, w, _ in rows], "t string, w string").select("t", "w", alignment.find_trigger(F.col("t"), F.col("w")).alias("x"))
    got = {(r["t"], r["w"]): r["x"] and (r["x"]["start"], r["x"]["end"]) for r in df.collect()}
    assert got == {(t, w): want for t, w, want in rows}


def test_resolve_offset(spark):
    rows = [("abc trigger def", 4, "trigger", 4), ("abc trigger def", 0, "Trigger", 4), ("trigger" + "x" * 900, 800, "trigger", None), ("abc", 0, "zzz", None)]
    df = spark.createDataFrame([r[:3] for r in rows], "t string, o int, w string").select("t", "o", "w", alignment.resolve_offset(F.col("t"), F.col("o"), F.col("w")).alias("x"))
    assert [r["x"] for r in df.collect()] == [r[3] for r in rows]


def test_merge_identical(spark):
    schema = "report long, code string, id long, source string, span string, trigger string, segment long, context string, confirmed boolean"
    rows = [
        (1, "C", 1, "prior", None, "bad word", None, None, None), (1, "C", 2, "confirmed", "1:2", "word", 1, None, True), (1, "C", 3, "prior", "1:5", "other", 1, "ctx", None),
        (1, "C", 4, "cross_check", None, None, None, None, None), (1, "D", 5, "prior", None, None, None, None, None), (1, "D", 6, "confirmed", None, None, None, "c", False),
    ]
    got = {r["host"]: r for r in merging.merge_identical(spark.createDataFrame(rows, schema), {"confirmed": 0, "prior": 1}).collect()}
    assert set(got) == {2, 3, 4, 6}
    # The unplaced row joins the first host, the located one of the better source, whose word differs from its own.
    assert got[2]["ids"] == "2,1" and got[2]["n_claims"] == 1 and got[2]["confirmed"] is True
    assert got[3]["n_merged"] == 1 and got[4]["sources"] == "cross_check"
    assert got[6]["ids"] == "6,5" and got[6]["context"] == "c" and got[6]["confirmed"] is False


def test_spans_empty(spark):
    none = spark.createDataFrame([], "report long, id long, start long, end long")
    one = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 3, 9)], "report long, id long, start long, end long")
    got = spans.span_prf(one, none, spans.match(one, none)).first()
    assert (got["tp"], got["fp"], got["fn"], got["f1"], got["mean_jaccard"]) == (0, 0, 2, 0.0, 0.0)
    # A span that covers two is taken by the first only.
    wide = spark.createDataFrame([(1, 9, 0, 9)], "report long, id long, start long, end long")
    assert [(r["g_id"], r["p_id"]) for r in spans.match(one, wide).collect()] == [(1, 9)]


@pytest.fixture(scope="module")
def dag(spark):
    rng = np.random.default_rng(4)
    edges = {(f"n{i}", f"n{int(p)}") for i in range(3, 60) for p in rng.integers(0, i, 2)}
    return spark.createDataFrame(sorted(edges), "child string, parent string"), edges


def test_walks_agree_with_joins(spark, dag):
    frame, _ = dag
    rng = np.random.default_rng(5)
    scores = spark.createDataFrame([(r, f"n{i}", float(rng.random())) for r in range(4) for i in range(60) if rng.random() < 0.8] + [(0, "unknown", 0.5)], "report long, term string, score double")
    rows = lambda d: sorted((r["report"], r["term"], round(r["r"], 9)) for r in d.collect())
    assert rows(graph.bottleneck(frame, scores)) == rows(graph.bottleneck(frame, scores, max_edges=0))
    opened = scores.where("score > 0.4").select("report", "term")
    reports = spark.range(5).withColumnRenamed("id", "report")
    depths = graph.longest_depths(frame)
    key = lambda d: sorted((r["report"], r["term"], -1 if r["blocked"] is None else r["blocked"]) for r in d.collect())
    assert key(traversal.blocking_depths(frame, depths, opened, reports)) == key(traversal.blocking_depths(frame, depths, opened, reports, max_edges=0))


def test_verdicts_plain(spark, dag):
    frame, edges = dag
    parents = {}
    for c, p in edges:
        parents.setdefault(c, []).append(p)
    rng = np.random.default_rng(6)
    conf = {f"n{i}": float(rng.random()) for i in range(60) if rng.random() < 0.9}
    depth = {r["term"]: r["depth"] for r in graph.longest_depths(frame).collect()}
    got = {r["term"]: r["verdict"] for r in ontology.verdicts(frame, spark.createDataFrame([(1, t, s) for t, s in conf.items()], "report long, term string, score double"), (0.6,), (0.3,), 1).collect()}
    pred = {}
    for t in sorted(depth, key=lambda t: (depth[t], t)):
        if depth[t] <= 1:
            pred[t] = "skipped"
            continue
        low = lambda n: pred.get(n) == "pruned" or (pred.get(n) != "skipped" and n in conf and conf[n] < 0.3)  # noqa: B023, E731
        cut = any(pred[p] == "pruned" or (low(p) and any(low(q) for q in parents.get(p, []))) for p in parents.get(t, []))
        pred[t] = "pruned" if cut else "yes" if conf.get(t, 0) >= 0.6 else "no"
    assert got == pred and "pruned" in pred.values()


def test_backward_elimination_keeps_the_smallest_near_the_best(spark):
    rows = [(s, "report", 1, 0.5 + 0.1 * bool(s & 1) + 0.001 * s.bit_count()) for s in range(1, 8)]
    path, chosen = selection.backward_elimination(spark.createDataFrame(rows, "subset long, unit string, k int, inner_f1 double"), 3, 0.01)
    assert [r["subset"] for r in path.orderBy("step").collect()] == [7, 5, 1]
    assert chosen.first()["subset"] == 1


def test_paired_interval(spark):
    a = spark.createDataFrame([(i, 5 + i % 3, 1, 1) for i in range(60)], "report long, tp long, fp long, fn long")
    b = spark.createDataFrame([(i, 3 + i % 2, 2, 3) for i in range(60)], "report long, tp long, fp long, fn long")
    r = nested.paired_interval(a, b, 500).first()
    assert r["low"] < r["delta"] < r["high"] and r["p"] < 0.05
    same = nested.paired_interval(a, a, 200).first()
    assert same["delta"] == same["low"] == same["high"] == 0 and same["p"] == 1


def test_scalars_of_odd_cells(spark):
    df = spark.createDataFrame([("12",), ("1e3",), (" 7 ",), ("x",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(scalars.is_number(F.col("c"))).collect()] == [True, True, True, False, False, False]
    assert [r[0] for r in df.select(replies.wrote(F.col("c"))).collect()] == [True, True, True, True, False, False]


def test_find_phrases(spark):
    segments = spark.createDataFrame([(1, 0, "Severe hypotonic signs"), (1, 1, "no Hypotonia, hypotonia here"), (1, 2, "muscle-weakness seen"), (1, 3, "nothing")], "report long, segment int, text string")
    phrases = spark.createDataFrame([(1, "T1", "hypotonia"), (1, "T2", "muscle weakness"), (2, "T3", "nothing")], "report long, term string, phrase string")
    got = {(r["term"], r["segment"]): (r["tier"], r["start"]) for r in staging.find_phrases(segments, phrases).collect()}
    assert got == {("T1", 0): (1, 7), ("T1", 1): (0, 3), ("T2", 2): (1, 0)}


def test_work_that_is_cut_off(spark, tmp_path):
    units = spark.range(40).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("unit"), "id")
    log = resume.Checkpoint(spark, f"file://{tmp_path}/log")
    assert log.pending(units).count() == 40
    work = lambda part: part.select("unit", "id")
    assert resume.run(units, work, f"file://{tmp_path}/out", log, 4, resume.Stop(spark, seconds=0)) == 0
    assert resume.run(units, work, f"file://{tmp_path}/out", log, 4, most=1) == 1
    # Results of a batch that was written but never marked are replaced whole.
    work(units.where(F.pmod(F.xxhash64("unit"), F.lit(4)) == 1)).write.mode("overwrite").parquet(f"file://{tmp_path}/out/batch=1")
    resume.run(units, work, f"file://{tmp_path}/out", log, 4)
    rows = spark.read.parquet(f"file://{tmp_path}/out")
    assert rows.count() == rows.select("unit").distinct().count() == 40 and log.pending(units).isEmpty()
    (tmp_path / "stop").touch()
    assert resume.Stop(spark, flag=f"file://{tmp_path}/stop").asked()
