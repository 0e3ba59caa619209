"""Nearest reference terms on graphs above the size at which every pair of terms is walked."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from grovemark.operators import distances, errors, graph
from grovemark.plans import error_queries as eq
from grovemark.plans import fixtures as fx

D = "/root/testdata/sf0.001"


def plain(edges, gold, pred, inside):
    """report, term, other, distance, kind by one breadth-first walk from each prediction."""
    near, up = defaultdict(set), defaultdict(set)
    for c, p in edges:
        near[c].add(p), near[p].add(c), up[c].add(p)

    def above(t):
        out, now = set(), up[t]
        while now - out:
            out, now = out | now, {q for p in now for q in up[p]}
        return out

    ref = {(r, t) for r, t in gold if t in inside}
    for r, t in sorted(set(pred) - ref):
        mine = {o for q, o in ref if q == r}
        seen, now, hop, hit = {t}, {t}, 0, None
        while now and t in inside and not hit:
            now, hop = {y for x in now for y in near[x]} - seen, hop + 1
            seen |= now
            hit = min(now & mine, default=None)
        kind = ("out_of_subtree" if t in near else "hallucination") if t not in inside else "no_gold" if not mine else "unrelated"
        if hit:
            kind = "ancestor" if t in above(hit) else "descendant" if hit in above(t) else "sibling" if up[t] & up[hit] else "unrelated"
        yield r, t, hit, hop if hit else None, kind


@pytest.mark.parametrize("lot", [2_000_000, 50])
@pytest.mark.parametrize("kind", ["layers", "mixed", "path", "star"])
@pytest.mark.parametrize("hubs", [0, 2, 32])
def test_landmarks_agree_with_plain_walks(spark, monkeypatch, hubs, kind, lot):
    monkeypatch.setattr(distances, "LOT", lot)
    monkeypatch.setattr(distances, "LISTED", 3)
    monkeypatch.setattr(distances, "WIDE", 20)
    rng = np.random.default_rng(4)
    n, parent = 70, {"layers": lambda i: (i - 10) // 10 * 10 + rng.integers(0, 10, 2), "mixed": lambda i: rng.integers(max(0, i - 15), i, 2), "path": lambda i: [i - 1], "star": lambda i: rng.integers(0, 3, 2)}[kind]
    edges = sorted({(f"n{i}", f"n{int(p)}") for i in range(10 if kind == "layers" else 3, n) for p in parent(i)} | {("z1", "z0"), ("z2", "z1")})
    terms = sorted({t for e in edges for t in e})
    inside = {t for t in terms if t not in ("n0", "n1")} | {"apart"}
    some = [*terms, "apart", "unknown"]
    draw = lambda k: sorted({(int(r), str(rng.choice(some))) for r in rng.integers(0, 9, k)})
    gold, pred = draw(25), draw(150) + [(77, "n9"), (77, "unknown")]
    ef = spark.createDataFrame(edges, "child string, parent string")
    g = distances.Graph(ef, spark.createDataFrame([(t,) for t in inside], "term string"), hubs).ready()
    rows = sorted([(r, t, True) for r, t in gold] + [(r, t, False) for r, t in pred])
    table = pa.table({"report": [r for r, _, _ in rows], "term": [t for _, t, _ in rows], "g": [x for _, _, x in rows]})
    got = g.judged(table, True).to_pylist()
    assert sorted(tuple(r.values()) for r in got) == list(plain(edges, gold, pred, inside))


@pytest.mark.parametrize("rows", [200_000, 50])
def test_both_forms_agree_on_the_test_tables(spark, rows):
    edges = fx.edges(spark, D)
    gold, pred, scorable = eq._gold(spark, D), eq._pred(spark, D), eq._scorable(edges)
    near = errors.nearest_gold(gold, pred, edges, scorable)
    want = sorted(map(repr, errors.classified(near, gold, edges, fx.closed(spark, D), scorable).collect()))
    assert sorted(map(repr, distances.nearest_reference(gold, pred, edges, scorable, True, rows).collect())) == want


def test_large_graphs_are_not_refused(spark):
    edges = spark.createDataFrame([("A", "R"), ("B", "R"), ("P1", "A"), ("P2", "A"), ("P3", "B"), ("P4", "B"), ("Q", "U")], "child string, parent string")
    gold = spark.createDataFrame([(1, "P1"), (1, "P4"), (2, "P3")], "report long, term string")
    pred = spark.createDataFrame([(1, "P2"), (1, "B"), (1, "Q"), (1, "A"), (2, "P1"), (3, "P1")], "report long, term string")
    want = [(1, "A", "P1", 1), (1, "B", "P4", 1), (1, "P2", "P1", 2), (1, "Q", None, None), (2, "P1", "P3", 4), (3, "P1", None, None)]
    # Landmarks up to four times the bound, spheres above it.
    for most in (100, 2, 0):
        assert sorted(map(tuple, errors.nearest_gold(gold, pred, edges, graph.nodes(edges), most).collect())) == want
        miss = sorted(tuple(r) for r in graph.near_miss_distances(gold, pred, edges, most).collect())
        assert miss == [(r, t, -1 if d is None else d) for r, t, _, d in want]
        kinds = {(r["report"], r["term"]): r["kind"] for r in errors.nearest_kinds(gold, pred, edges, lambda: graph.closure(edges), graph.nodes(edges), most).collect()}
        assert kinds == {(1, "A"): "ancestor", (1, "B"): "ancestor", (1, "P2"): "sibling", (1, "Q"): "unrelated", (2, "P1"): "unrelated", (3, "P1"): "no_gold"}


def test_far_pairs_are_not_walked_over_the_whole_graph(monkeypatch):
    g = object.__new__(distances.Graph)
    # A path of 30 nodes, a ring of 9, two nodes apart.
    edges = [(i, i + 1) for i in range(29)] + [(30 + i, 30 + (i + 1) % 9) for i in range(9)] + [(39, 40)]
    g.names, g.inside, g.hubs, g.far = pa.array([f"n{i:02}" for i in range(41)]), np.ones(41, bool), np.array([], int), []
    g.child, g.parent = (np.array(x, np.int32) for x in zip(*edges, strict=True))
    a, b = np.divmod(np.arange(41 * 41), 41)
    a, b = a[a != b], b[a != b]
    want = g.ready().walked(a, b)
    monkeypatch.setattr(distances.Graph, "walked", None)
    for lot in (500_000, 40):
        monkeypatch.setattr(distances, "LOT", lot)
        assert g.between(a, b).tolist() == want.tolist() and want.max() == 29 and want.min() == -1


def test_names_are_found_by_their_hashes(monkeypatch):
    names = pa.array(["", "a", "bé", "x" * 300, "P1", "P10"])
    asked = pa.array(["z", *["P10", "", None, "bé", "P1", "a", "x" * 299, "x" * 300, "P2"]]).slice(1)
    want = [5, 0, -1, 2, 4, 1, -1, 3, -1]
    assert distances._Numbers(names).of(asked).tolist() == want
    assert distances._hashes(asked, 2).tolist() == distances._hashes(asked).tolist()
    monkeypatch.setattr(distances, "_hashes", lambda terms: np.zeros(len(terms), np.uint64))
    assert distances._Numbers(names).of(asked).tolist() == want and distances._Numbers(names.slice(0, 0)).of(asked).tolist() == [-1] * 9
