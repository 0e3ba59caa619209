"""Walks whose terms are counted by kind, not listed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovemark.operators import graph, nested, ontology
from grovemark.plans import nested_queries as nq

D = "/root/testdata/sf0.001"
EDGES = [("A", "R"), ("B", "R"), ("P1", "A"), ("P2", "A"), ("P2", "B"), ("P3", "B"), ("P4", "A"), ("P5", "B")]


@pytest.mark.parametrize("most", [graph.COUNTED_EDGES, 0])
def test_width_classes_count_every_term(spark, most):
    edges = spark.createDataFrame(EDGES, "child string, parent string")
    scores = spark.createDataFrame([(1, "R", 0.9), (1, "A", 0.4), (1, "B", 0.7), (2, "R", 0.5)], "report long, term string, score double")
    told = spark.createDataFrame([(1, "P1", True, 0.25), (1, "P5", False, None), (1, "P9", True, 0.5), (3, "P3", True, 0.1)], "report long, term string, y boolean, m double")
    got = {tuple(r) for r in graph.width_classes(edges, scores, told, "P%", "y", max_edges=most).collect()}
    # report, leaf, r, score, near, y, m, n: P4 has P1's parent; P2 has both, P3 and P5 only the other.
    inf = float("inf")
    one = {(1, False, inf, 0.9, False, None, None, 1), (1, False, 0.9, 0.4, True, None, None, 1), (1, False, 0.9, 0.7, True, None, None, 1),
           (1, True, 0.4, None, True, True, 0.25, 1), (1, True, 0.4, None, True, None, None, 1), (1, True, 0.7, None, True, None, None, 1),
           (1, True, 0.7, None, False, None, None, 1), (1, True, 0.7, None, False, False, None, 1), (1, True, None, None, False, True, 0.5, 1)}
    assert {r for r in got if r[0] == 1} == one
    two = {(2, False, inf, 0.5, False, None, None, 1), (2, False, 0.5, None, False, None, None, 2), (2, True, 0.0, None, False, None, None, 5)}
    assert {r for r in got if r[0] == 2} == two
    # A report without scores is walked too: one inner term and its leaves open to nothing.
    assert sum(r[-1] for r in got if r[0] == 3) == 8 and (3, True, 0.0, None, True, True, 0.1, 1) in got


def test_space_holds_every_term_in_few_rows(spark):
    sp = nq.space(spark, D)
    n = sp.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("terms")).first()
    terms = graph.nodes(nq.fx.edges(spark, D)).count()
    assert n["terms"] == 200 * 2 * terms
    assert n["rows"] < n["terms"] / 2


def test_counted_rows_stand_for_terms(spark):
    rng = np.random.default_rng(3)
    kinds = [(r, f"k{k}", float(rng.choice([0.1, 0.5, 0.9])), float(rng.random()), 1, bool(k % 3 == 0), int(rng.integers(1, 4))) for r in range(6) for k in range(8)]
    schema = "report long, term string, r double, score double, n_calls int, y boolean, n long"
    few = spark.createDataFrame(kinds, schema).withColumn("pooling", F.lit("P1"))
    many = few.withColumn("i", F.explode(F.expr("sequence(1, n)"))).withColumn("term", F.concat("term", F.lit("."), F.col("i").cast("string"))).drop("i", "n")
    fd = spark.range(6).select(F.col("id").alias("report"), (F.col("id") % 2).alias("fold"), F.lit(0).alias("inner"))
    out = []
    for sp in (few, many):
        y = sp.where("y").select("report", "term", *[c for c in sp.columns if c == "n"])
        misses, calls = nested.miss_rates(sp, y, fd, (0.3, 0.7)), nested.calls_at(sp, (0.3, 0.7))
        chosen = nested.prune_pooling(nested.tau_prune(misses, calls, fd, 0.9))
        rows = nested.candidates(sp, chosen, y, fd, F.lit(True))
        acc = nested.acceptance(rows, (0.2, 0.6))
        frames = (misses, calls, chosen, acc, nested.pooled(rows, acc), nested.operating_point(sp, chosen, y, fd))
        out.append([sorted(repr({k: round(v, 9) if isinstance(v, float) else v for k, v in sorted(r.asDict().items())}) for r in f.collect()) for f in frames])
    assert out[0] == out[1]


@pytest.mark.parametrize("rule", ["confident", "two_no"])
def test_verdict_counts_agree_with_listed_verdicts(spark, rule):
    rng = np.random.default_rng(8)
    edges = spark.createDataFrame(sorted({(f"P{i}" if i > 20 else f"n{i}", f"n{int(p)}") for i in range(2, 50) for p in rng.integers(0, min(i, 20), 2)}), "child string, parent string")
    scored = [(r, f"P{i}" if i > 20 else f"n{i}", float(rng.random())) for r in range(3) for i in range(50) if rng.random() < 0.8]
    schema = "report long, term string, score double"
    inner, leaves = (spark.createDataFrame([x for x in scored if x[1].startswith("P") == on], schema) for on in (False, True))
    told = leaves.withColumn("y", F.length("term") + F.col("report") > 3).union(spark.createDataFrame([(0, "P999", None, True), (7, "P30", 0.9, True)], schema + ", y boolean"))
    accept, prune = (0.3, 0.6), (0.2, 0.5)
    got = {tuple(r) for r in ontology.verdict_counts(edges, inner, told, "P%", accept, prune, 1, rule).collect()}
    yes = [(r["report"], r["tau_accept"], r["tau_prune"], r["term"]) for r in ontology.verdicts(edges, inner.union(told.select("report", "term", "score")), accept, prune, 1, rule).where("verdict = 'yes' and term like 'P%'").collect()]
    gold = {(r["report"], r["term"]) for r in told.where("y").collect()}
    want = set()
    for r in (0, 1, 2, 7):
        for ta in accept:
            for tp in prune:
                mine = [t for q, a, p, t in yes if (q, a, p) == (r, ta, tp)]
                want.add((r, ta, tp, len(mine), sum((r, t) in gold for t in mine), sum(q == r for q, _ in gold)))
    assert got == want


@pytest.mark.parametrize("lot", [4_000_000, 3])
def test_within_counts_agree_with_listed_terms(spark, lot):
    rng = np.random.default_rng(6)
    edges = spark.createDataFrame(sorted({(f"n{i}", f"n{int(p)}") for i in range(1, 60) for p in rng.integers(max(0, i - 9), i, 2)}), "child string, parent string")
    gold = spark.createDataFrame(sorted({(int(r), f"n{int(t)}") for r, t in zip(rng.integers(0, 7, 20), rng.integers(0, 60, 20), strict=True)}) + [(1, "unknown"), (99, "unknown")], "report long, term string")
    for most in (0, 2, 4):
        inside = gold.where("term <> 'unknown'")
        want = sorted(tuple(r) for r in ontology.within_hops(inside, edges, most).groupBy("report", "distance").count().collect())
        assert sorted(tuple(r) for r in ontology.within_counts(gold, edges, most, lot).collect()) == want
