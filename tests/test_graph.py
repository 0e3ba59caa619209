"""The ten-node graph with known closures, depths and distances."""

import pytest

from grovemark.operators import graph as g
from grovemark.operators import quality as q

EDGES = [("A", "R"), ("G", "R"), ("B", "A"), ("E", "A"), ("H", "G"), ("C", "B"), ("D", "B"), ("F", "E"), ("M", "B"), ("M", "H")]


def edges(spark):
    return spark.createDataFrame(EDGES, "child string, parent string")


def pairs(spark, rows):
    return spark.createDataFrame(rows, "report string, term string")


def test_closure_and_depths(spark):
    e = edges(spark)
    closed = g.closure(e)
    sizes = {r["descendant"]: r["count"] for r in closed.where("ancestor <> 'R'").groupBy("descendant").count().collect()}
    assert (sizes["C"], sizes["D"], sizes["M"], sizes["F"]) == (3, 3, 5, 3)
    depth = {r["term"]: r["depth"] - 1 for r in g.depths(e, closed).collect()}
    assert depth == {"R": 0, "A": 1, "G": 1, "B": 2, "E": 2, "H": 2, "C": 3, "D": 3, "F": 3, "M": 3}
    assert {r["term"]: r["depth"] - 1 for r in g.longest_depths(e).collect()} == depth


def test_distances(spark):
    near = {(r["report"], r["term"]): r["distance"] for r in g.nearest(pairs(spark, [("x", "C")]), edges(spark)).collect()}
    assert (near["x", "D"], near["x", "B"], near["x", "F"], near["x", "H"]) == (2, 1, 4, 3)


@pytest.mark.parametrize("max_edges", [1_000_000, 0])
def test_near_miss_distances(spark, max_edges):
    e = edges(spark).union(spark.createDataFrame([("Y", "Z")], "child string, parent string"))
    gold = pairs(spark, [("x", "C"), ("y", "F"), ("y", "Q"), ("z", "Q")])
    pred = pairs(spark, [("x", t) for t in "CBDFHZ"] + [("y", "C"), ("y", "H"), ("y", "U"), ("z", "C"), ("w", "C")])
    got = {(r["report"], r["term"]): r["distance"] for r in g.near_miss_distances(gold, pred, e, max_edges).collect()}
    # By C and M's two parents H is three steps from C; Z is in another component, U and Q are in none, w has no gold.
    assert got == {("x", "B"): 1, ("x", "D"): 2, ("x", "F"): 4, ("x", "H"): 3, ("x", "Z"): -1, ("y", "C"): 4, ("y", "H"): 5, ("y", "U"): -1, ("z", "C"): -1, ("w", "C"): -1}
    for cut in (lambda: g.near_miss_distances(gold, pred, e, 0, max_hops=2).count(), lambda: g.nearest(gold, e, max_hops=2).count()):
        with pytest.raises(ValueError):
            cut()


def test_most_specific(spark):
    out = g.most_specific(pairs(spark, [("x", "A"), ("x", "C"), ("x", "G")]), g.closure(edges(spark)))
    assert {r["term"] for r in out.collect()} == {"C", "G"}


def test_zero_denominators(spark):
    m = q.micro(pairs(spark, [("x", "A")]), pairs(spark, [("x", "B")])).first()
    assert (m["precision"], m["recall"], m["f1"]) == (0, 0, 0)
    units = q.with_reports(q.flat_units(pairs(spark, [("x", "A")]), pairs(spark, [("x", "A")])), spark.createDataFrame([("x",), ("y",)], "report string"))
    assert {r["f1"] for r in q.report_prf(units).collect()} == {1.0}


def test_bottleneck_is_replay(spark):
    scores = {"R": 0.9, "A": 0.4, "G": 0.8, "B": 0.7, "E": 0.1, "H": 0.6}
    s = spark.createDataFrame([("x", t, v) for t, v in scores.items()], "report string, term string, score double")
    r = {x["term"]: x["r"] for x in g.bottleneck(edges(spark), s).collect()}
    for tau in (0.05, 0.3, 0.5, 0.7):
        seen, now = {"R"}, ["R"]
        while now:
            now = [c for c, p in EDGES if p in now and scores.get(p, 0) >= tau and c not in seen]
            seen |= set(now)
        assert {t for t, v in r.items() if v >= tau} == seen
