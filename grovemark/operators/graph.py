"""Operators over a term DAG given as edges(child, parent): closures, depths, distances, hierarchy-aware quality.

Loops run once per level of the graph, each level one join; their intermediate tables are written out, so the plan of a
level does not carry those before it. Self-joins use the closure, whose size is terms times ancestors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemark.operators.quality import counted, prf, ratio
from grovemark.plans.scratch import settled


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("term")).union(edges.select("parent")).distinct()


def closure(edges: DataFrame, max_levels: int = 64) -> DataFrame:
    """descendant, ancestor, hops (fewest); reflexive. Semi-naive: each level extends the pairs that are new."""
    done = settled(nodes(edges).select(F.col("term").alias("descendant"), F.col("term").alias("ancestor"), F.lit(0).alias("hops")))
    new = done
    for level in range(1, max_levels + 1):
        step = new.join(edges, new.ancestor == edges.child).select("descendant", F.col("parent").alias("ancestor"), F.lit(level).alias("hops")).distinct()
        new = settled(step.join(done, ["descendant", "ancestor"], "left_anti").select("descendant", "ancestor", "hops"))
        if new.isEmpty():
            return done
        done = done.unionByName(new)
    raise ValueError("the graph has a cycle or more levels than max_levels")


def roots(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("term")).distinct().join(edges.select(F.col("child").alias("term")), "term", "left_anti")


def depths(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """Fewest steps from a root plus 1."""
    return closed.join(roots(edges), closed.ancestor == F.col("term")).groupBy("descendant").agg((F.min("hops") + 1).alias("depth")).withColumnRenamed("descendant", "term")


def longest_depths(edges: DataFrame, max_levels: int = 64) -> DataFrame:
    """Most steps from a root plus 1: the last level at which a term is reached."""
    at = roots(edges).select("term", F.lit(1).alias("depth"))
    done = at
    for level in range(2, max_levels + 1):
        at = settled(at.join(edges, at.term == edges.parent).select(F.col("child").alias("term")).distinct().withColumn("depth", F.lit(level)))
        if at.isEmpty():
            return done.groupBy("term").agg(F.max("depth").alias("depth"))
        done = done.unionByName(at)
    raise ValueError("the graph has a cycle or more levels than max_levels")


def layer1(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """Each term's top branches: the smallest one and how many."""
    return closed.join(roots(edges), closed.ancestor == F.col("term")).groupBy("descendant").agg(F.min("ancestor").alias("layer1"), F.count(F.lit(1)).alias("n_layer1")).withColumnRenamed("descendant", "term")


def ancestors_of(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """(report, term) pairs extended to all ancestors, distinct."""
    return pairs.join(closed, pairs.term == closed.descendant).select("report", F.col("ancestor").alias("term")).distinct()


def sides(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """report, term, g, p: the distinct pairs of both, one below the other, each marked with its side."""
    own = lambda d, g, p: d.select("report", "term").distinct().select("report", "term", F.lit(g).alias("g"), F.lit(p).alias("p"))
    return own(gold, 1, 0).unionByName(own(pred, 0, 1))


def h_counts(gold: DataFrame, pred: DataFrame, closed: DataFrame) -> DataFrame:
    """Per report the sizes tp, fp, fn of the two closures: one join with the closure and one grouping for both sides."""
    up = sides(gold, pred).join(closed, F.col("term") == F.col("descendant")).groupBy("report", "ancestor").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    return counted(up, "report")


def cophe_counts(gold: DataFrame, pred: DataFrame, closed: DataFrame) -> DataFrame:
    """Per report tp, fp, fn over nodes, each weighed by how many of the report's terms lie under it."""
    both = sides(gold, pred).join(closed, F.col("term") == F.col("descendant")).groupBy("report", "ancestor").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    zero = F.lit(0)
    return both.groupBy("report").agg(F.sum(F.least("g", "p")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("g"), zero)).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("p"), zero)).alias("fn"))


def cohort(units: DataFrame) -> DataFrame:
    """Micro (pooled counts) and macro (mean of reports) of per-report counts, in one pass."""
    per = units.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))
    pooled = per.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    return pooled.select("tp", "fp", "fn", *[c.alias(f"micro_{n}") for c, n in zip(prf(F.col("tp"), F.col("fp"), F.col("fn")), ("precision", "recall", "f1"), strict=True)], "macro_precision", "macro_recall", "macro_f1")


def most_specific(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """Pairs whose term is no strict ancestor of another term of the report."""
    own = pairs.select("report", "term").distinct()
    above = own.join(closed.where("hops > 0"), own.term == closed.descendant).select("report", F.col("ancestor").alias("term")).distinct()
    return own.join(above, ["report", "term"], "left_anti")


def pairwise(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """report, a (predicted), b (gold): the pairs within each report; a join on the report, as large as the product of a
    report's two sets."""
    g, p = gold.select("report", F.col("term").alias("b")).distinct(), pred.select("report", F.col("term").alias("a")).distinct()
    return p.join(g, "report")


def wu_palmer(pairs: DataFrame, closed: DataFrame, depth: DataFrame) -> DataFrame:
    """pairs with sim = 2 d(lcs) / (d(a) + d(b)) on longest depths; lcs is the deepest common ancestor, else sim is 0.
    Distinct term pairs are computed once."""
    anc = closed.select("descendant", "ancestor").join(depth, F.col("ancestor") == F.col("term")).select("descendant", "ancestor", "depth")
    terms = pairs.select("a", "b").distinct()
    left, right = anc.withColumnsRenamed({"descendant": "a", "depth": "d"}), anc.select(F.col("descendant").alias("b"), "ancestor")
    common = terms.join(left, "a").join(right, ["b", "ancestor"]).groupBy("a", "b").agg(F.max("d").alias("lcs"))
    own = lambda n, as_: depth.select(F.col("term").alias(n), F.col("depth").alias(as_))
    sims = terms.join(common, ["a", "b"], "left").join(own("a", "da"), "a").join(own("b", "db"), "b")
    sims = sims.select("a", "b", ratio(2 * F.col("lcs"), F.col("da") + F.col("db")).alias("sim"))
    return pairs.join(sims, ["a", "b"])


def soft_prf(gold: DataFrame, pred: DataFrame, closed: DataFrame, depth: DataFrame) -> DataFrame:
    """Per report: mean best similarity of predictions (precision) and of gold terms (recall); a side without pairs is 0."""
    sims = wu_palmer(pairwise(gold, pred), closed, depth)
    best = lambda side, n: sims.groupBy("report", side).agg(F.max("sim").alias("s")).groupBy("report").agg(F.avg("s").alias(n))
    both = gold.select("report").union(pred.select("report")).distinct().join(best("a", "precision"), "report", "left").join(best("b", "recall"), "report", "left").na.fill(0.0)
    p, r = F.col("precision"), F.col("recall")
    return both.select("report", "precision", "recall", ratio(2 * p * r, p + r).alias("f1"))


def nearest(gold: DataFrame, edges: DataFrame, max_hops: int = 64) -> DataFrame:
    """report, term, distance, source: each term's nearest gold term of the report along edges in either direction, ties to
    the smallest. One frontier step per hop for all reports together."""
    both = edges.select(F.col("child").alias("x"), F.col("parent").alias("y")).union(edges.select("parent", "child")).distinct()
    done = settled(gold.select("report", "term").distinct().select("report", "term", F.lit(0).alias("distance"), F.col("term").alias("source")))
    new = done
    for hop in range(1, max_hops + 1):
        step = new.join(both, new.term == both.x).groupBy("report", F.col("y").alias("term")).agg(F.min("source").alias("source"))
        new = settled(step.join(done, ["report", "term"], "left_anti").select("report", "term", F.lit(hop).alias("distance"), "source"))
        if new.isEmpty():
            return done
        done = done.unionByName(new)
    raise ValueError("some distances are above max_hops")


def near_misses(gold: DataFrame, pred: DataFrame, edges: DataFrame) -> DataFrame:
    """report, term, distance of each false positive: 1 or 2 steps to a gold term of the report, else -1, be it farther or
    without any; near_miss_distances() has the full distances. Both sides step once to their neighbours and meet there, so
    a term's neighbourhood is never expanded twice."""
    both = edges.select(F.col("child").alias("term"), F.col("parent").alias("next")).union(edges.select("parent", "child")).distinct()
    g = gold.select("report", "term").distinct()
    wrong = pred.select("report", "term").distinct().join(g, ["report", "term"], "left_anti")
    step = wrong.join(both, "term")
    one = step.join(g.withColumnRenamed("term", "next"), ["report", "next"], "left_semi").select("report", "term", F.lit(1).alias("distance"))
    two = step.join(g.join(both, "term").select("report", "next").distinct(), ["report", "next"], "left_semi").select("report", "term", F.lit(2).alias("distance"))
    best = one.union(two).groupBy("report", "term").agg(F.min("distance").alias("distance"))
    return wrong.join(best, ["report", "term"], "left").na.fill(-1, ["distance"])


def pair_distances(pairs: DataFrame, both: DataFrame) -> DataFrame:
    """term, other, distance of distinct pairs of nodes along both(x, y), which holds every edge in both directions; pairs
    that no path joins are left out. 64 terms walk at once, a bit each, and every hop is one pass over the edges, which
    travel to the tasks: 16 bytes an edge."""
    ends = both.select("x", "y").toPandas()
    names, at = np.unique(ends["y"].to_numpy(dtype=str), return_inverse=True)
    order = np.argsort(at, kind="stable")
    source, starts = np.searchsorted(names, ends["x"].to_numpy(dtype=str))[order], np.searchsorted(at[order], np.arange(len(names)))
    graph = pairs.sparkSession.sparkContext.broadcast((names, source, starts))

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, source, starts = graph.value
        for b in batches:
            terms, row = np.unique(b["term"].to_numpy(dtype=str), return_inverse=True)
            node, other = np.searchsorted(names, terms), np.searchsorted(names, b["other"].to_numpy(dtype=str))
            hops = np.full(len(b), -1)
            for lo in range(0, len(terms), 64):
                mine = np.nonzero(row // 64 == lo // 64)[0]
                bit, seen, hop = (row[mine] - lo).astype(np.uint64), np.zeros(len(names), np.uint64), 0
                seen[node[lo : lo + 64]] = np.uint64(1) << np.arange(len(terms[lo : lo + 64]), dtype=np.uint64)
                while True:
                    hit = (seen[other[mine]] >> bit & np.uint64(1)) == 1
                    hops[mine[hit]] = hop
                    mine, bit = mine[~hit], bit[~hit]
                    if not len(mine):
                        break
                    wider = seen | np.bitwise_or.reduceat(seen[source], starts)
                    if (wider == seen).all():
                        break
                    seen, hop = wider, hop + 1
            yield b.assign(distance=hops.astype(np.int32))[hops >= 0]

    dealt = pairs.select("term", "other").distinct().repartition("term").sortWithinPartitions("term")
    return dealt.mapInPandas(walked, "term string, other string, distance int")


def near_miss_distances(gold: DataFrame, pred: DataFrame, edges: DataFrame, max_edges: int = 1_000_000, max_hops: int = 64) -> DataFrame:
    """report, term, distance of each false positive: fewest steps along edges in either direction to a gold term of the
    report, however many; -1 only where no path leads to one. Gold terms outside the graph don't count. Up to max_edges
    distances are measured once per distinct pair of terms, up to four times as many by landmarks, each on a copy of the
    graph, above that by growing spheres."""
    from grovemark.operators.distances import nearest_reference

    edges = settled(edges)
    size = edges.count()
    if max_edges < size <= 4 * max_edges:
        return nearest_reference(gold, pred, edges).select("report", "term", F.coalesce("distance", F.lit(-1)).alias("distance"))
    both = settled(edges.select(F.col("child").alias("x"), F.col("parent").alias("y")).union(edges.select("parent", "child")).distinct())
    known = both.select(F.col("x").alias("term")).distinct()
    g = gold.select("report", "term").distinct().join(known, "term", "left_semi").select("report", "term")
    wrong = settled(pred.select("report", "term").distinct().join(g, ["report", "term"], "left_anti").select("report", "term"))
    asked = settled(wrong.join(known, "term", "left_semi").join(g.withColumnRenamed("term", "other"), "report").select("report", "term", "other"))
    if size <= max_edges:
        best = asked.join(pair_distances(asked, both), ["term", "other"]).groupBy("report", "term").agg(F.min("distance").alias("distance"))
    else:
        best = sphere_distances(asked, both, max_hops).select("report", "term", "distance")
    return wrong.join(best, ["report", "term"], "left").na.fill(-1, ["distance"])


def sphere_distances(left: DataFrame, both: DataFrame, max_hops: int) -> DataFrame:
    """report, term, other, distance: the nearest of the others of left(report, term, other), where there is a path, ties to
    the smallest.

    Both ends grow spheres, one table per radius over distinct terms, and meet: distance 2i - 1 is a node on sphere i of the
    one and i - 1 of the other, 2i on sphere i of both. Terms grow only while a row of left needs them."""
    before, last, found = None, settled(left.select("term").union(left.select("other")).distinct().select("term", F.col("term").alias("node"))), []
    for i in range(1, max_hops // 2 + 1):
        need = left.select("term").union(left.select("other")).distinct()
        grown = last.join(need, "term", "left_semi").join(both, F.col("node") == F.col("x")).select("term", F.col("y").alias("node")).distinct()
        for inner in (last, before) if before is not None else (last,):
            grown = grown.join(inner, ["term", "node"], "left_anti")
        before, last = last, settled(grown.select("term", "node"))
        for d, far in ((2 * i - 1, before), (2 * i, last)):
            asked = left.select("term", "other").distinct().join(last, "term")
            met = asked.join(far.select(F.col("term").alias("other"), "node"), ["other", "node"], "left_semi").select("term", "other").distinct()
            hits = left.join(met, ["term", "other"], "left_semi").groupBy("report", "term").agg(F.min("other").alias("other"))
            hits = settled(hits.withColumn("distance", F.lit(d)))
            found.append(hits)
            left = settled(left.join(hits, ["report", "term"], "left_anti").select("report", "term", "other"))
        # A sphere without nodes ends a term's component: what it has not met, it never meets.
        left = settled(left.join(last.select("term").distinct(), "term", "left_semi").select("report", "term", "other"))
        if left.isEmpty():
            best = found[0]
            for hits in found[1:]:
                best = best.unionByName(hits)
            return best
    raise ValueError("some distances are above max_hops")


class Levels:
    """A term graph as numbers, level by level of the longest depths: for each level its nodes and the edges that enter it,
    sorted by child. It travels to the tasks, about 10 bytes an edge and the terms' names, and is built only below a bound
    that the caller checks."""

    def __init__(self, edges: DataFrame, max_levels: int) -> None:
        depth = longest_depths(edges, max_levels).toArrow().sort_by("term")
        self.names = depth["term"].combine_chunks()
        self.depth = depth["depth"].to_numpy()
        pairs = edges.select("child", "parent").distinct().toArrow()
        child, parent = (pc.index_in(pairs[c], value_set=self.names).to_numpy() for c in ("child", "parent"))
        self.steps = []
        for level in range(2, (int(self.depth.max()) if len(depth) else 1) + 1):
            at = np.nonzero(self.depth[child] == level)[0]
            at = at[np.argsort(child[at], kind="stable")]
            node, first = np.unique(child[at], return_index=True)
            self.steps.append((node, parent[at], first))

    @property
    def terms(self) -> np.ndarray:
        return self.names.to_numpy(zero_copy_only=False)

    def numbers(self, terms: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """The terms' numbers; -1 for what is no node."""
        return pc.fill_null(pc.index_in(terms, value_set=self.names), -1).to_numpy(zero_copy_only=False)

    def places(self, terms: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms are nodes, and their numbers."""
        at = self.numbers(pa.array(terms, self.names.type, from_pandas=True))
        return at >= 0, at[at >= 0]


#: Edges of a graph that may travel to every task where a walk lists its terms; a larger one is walked level by level in joins.
MAX_EDGES = 1_000_000
#: The same where a walk counts its terms, so that the graph is all a task holds besides a report (40 MB and the names).
COUNTED_EDGES = 4_000_000


def bottleneck(edges: DataFrame, scores: DataFrame, max_levels: int = 64, max_edges: int = MAX_EDGES) -> DataFrame:
    """report, term, r: the widest path to a term, max over parents of min(r(parent), score(parent)); roots have +infinity.
    A term is visited at threshold t exactly if r >= t, so one pass serves every threshold. Terms without score count 0.

    The scores of a report, at most one per term, meet in one row group; all its levels are then a few array steps."""
    if edges.count() > max_edges:
        return bottleneck_joins(edges, scores, max_levels)
    graph = scores.sparkSession.sparkContext.broadcast(Levels(edges, max_levels))

    def walked(part: pd.DataFrame) -> pd.DataFrame:
        g = graph.value
        known, at = g.places(part["term"])
        score = np.zeros(len(g.terms))
        np.maximum.at(score, at, part["score"].fillna(0).to_numpy(dtype=float)[known])
        r = np.where(g.depth == 1, np.inf, 0.0)
        for node, parent, first in g.steps:
            r[node] = np.maximum.reduceat(np.minimum(r[parent], score[parent]), first)
        return pd.DataFrame({"report": part["report"].iloc[0], "term": g.terms, "r": r})

    kind = scores.schema["report"].dataType.simpleString()
    return scores.select("report", "term", "score").groupBy("report").applyInPandas(walked, f"report {kind}, term string, r double")


def bottleneck_joins(edges: DataFrame, scores: DataFrame, max_levels: int = 64) -> DataFrame:
    """bottleneck() for a graph of any size: one join per level for all reports together."""
    reports = scores.select("report").distinct()
    levels = longest_depths(edges)
    top = reports.crossJoin(F.broadcast(levels.where("depth = 1").select("term"))).withColumn("r", F.lit(float("inf")))
    last = levels.agg(F.max("depth")).first()[0] or 1
    linked = edges.join(levels, edges.child == levels.term).select("child", "parent", "depth")
    done = settled(top)
    for depth in range(2, min(last, max_levels) + 1):
        part = linked.where(F.col("depth") == depth).select(F.col("child").alias("node"), F.col("parent").alias("term"))
        wide = done.join(part, "term").join(scores.select("report", "term", "score"), ["report", "term"], "left")
        step = wide.groupBy("report", "node").agg(F.max(F.least("r", F.coalesce("score", F.lit(0.0)))).alias("r"))
        done = done.unionByName(settled(step.select("report", F.col("node").alias("term"), "r")))
    return done


def width_classes(edges: DataFrame, scores: DataFrame, told: DataFrame, leaf: str, seed: str, max_levels: int = 64, max_edges: int = COUNTED_EDGES) -> DataFrame:
    """bottleneck() counted: report, leaf, r, score, near, told's further columns, n. The n terms of a report that agree in
    all of these are one row, so the result does not grow with reports times terms.

    scores(report, term, score): what the walk goes by. told(report, term, ...): what else is known of some terms, each once;
    null for the others. leaf: is the term like this pattern. near: is a parent of the term a strict ancestor of one whose
    column seed holds. Of told's terms outside the graph r is null."""
    more = [f for f in told.schema if f.name not in ("report", "term")]
    names = [f.name for f in more]
    keys = ["leaf", "r", "score", "near", *names]
    if edges.count() > max_edges:
        return _width_classes_joins(edges, scores, told, leaf, seed, keys, max_levels)
    levels = Levels(edges, max_levels)
    graph = scores.sparkSession.sparkContext.broadcast((levels, pc.match_like(levels.names, leaf)))

    def walked(own: pa.Table, known: pa.Table) -> pa.Table:
        g, leaves = graph.value
        size = len(g.names)
        score = np.full(size, np.nan)
        at = g.numbers(own["term"])
        np.fmax.at(score, at[at >= 0], own["score"].to_numpy()[at >= 0])
        at = g.numbers(known["term"])
        held = pc.fill_null(known[seed], False).to_numpy().astype(bool) & (at >= 0)
        r, floor, below, above, near = np.where(g.depth == 1, np.inf, 0.0), np.nan_to_num(score), np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, bool)
        below[at[held]] = True
        for node, parent, first in g.steps:
            r[node] = np.maximum.reduceat(np.minimum(r, floor)[parent], first)
        for node, parent, first in reversed(g.steps):
            up = np.repeat((below | above)[node], np.diff(first, append=len(parent)))
            above[parent[up]] = True
        for node, parent, first in g.steps:
            near[node] = np.logical_or.reduceat(above[parent], first)
        inside = at >= 0
        rest = np.ones(size, bool)
        rest[at[inside]] = False
        some = {"leaf": pc.if_else(inside, leaves.take(pa.array(np.maximum(at, 0))), pc.match_like(known["term"].combine_chunks(), leaf)) if size else pc.match_like(known["term"].combine_chunks(), leaf)}
        some |= {"r": pa.array(r[at], mask=~inside), "score": pa.array(score[at], mask=~inside | np.isnan(score[at])), "near": pa.array(near[at] & inside)} if size else {"r": pa.nulls(len(at), pa.float64()), "score": pa.nulls(len(at), pa.float64()), "near": pa.array(np.zeros(len(at), bool))}
        some |= {c: known[c] for c in names}
        others = {"leaf": leaves.filter(pa.array(rest)), "r": r[rest], "score": pa.array(score[rest], mask=np.isnan(score[rest])), "near": near[rest]}
        out = []
        for columns, by in ((some, keys), (others, keys[:4])):
            out.append(pa.table(columns).group_by(by).aggregate([([], "count_all")]).rename_columns([*by, "n"]))
        table = pa.concat_tables(out, promote_options="default")
        report = (own if own.num_rows else known)["report"][0]
        return table.add_column(0, "report", pa.repeat(report, len(table))).select(["report", *keys, "n"])

    report = scores.schema["report"].dataType.simpleString()
    schema = f"report {report}, leaf boolean, r double, score double, near boolean, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in more)}, n long"
    left = scores.select("report", "term", "score")
    return left.groupBy("report").cogroup(told.select("report", "term", *names).groupBy("report")).applyInArrow(walked, schema)


def _width_classes_joins(edges: DataFrame, scores: DataFrame, told: DataFrame, leaf: str, seed: str, keys: list[str], max_levels: int) -> DataFrame:
    """width_classes() for a graph of any size."""
    own = scores.select("report", "term", "score")
    silent = told.select("report").distinct().select("report", F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("score"))
    wide = bottleneck_joins(edges, own.unionByName(silent), max_levels)
    up = done = settled(told.where(seed).select("report", "term").join(edges, F.col("term") == F.col("child")).select("report", F.col("parent").alias("term")).distinct())
    for _ in range(max_levels):
        up = settled(up.join(edges, F.col("term") == F.col("child")).select("report", F.col("parent").alias("term")).distinct().join(done, ["report", "term"], "left_anti"))
        if up.isEmpty():
            break
        done = settled(done.unionByName(up))
    near = done.join(edges, F.col("term") == F.col("parent")).select("report", F.col("child").alias("term")).distinct().withColumn("near", F.lit(True))
    met = wide.join(own, ["report", "term"], "left").join(near, ["report", "term"], "left").withColumn("inside", F.lit(True))
    met = met.join(told, ["report", "term"], "full").withColumn("leaf", F.col("term").like(leaf)).na.fill(False, ["near"])
    return met.groupBy("report", *keys).agg(F.count(F.lit(1)).alias("n"))


def components(links: DataFrame, most: int = 100) -> DataFrame:
    """node, root: the smallest node that each node of links(a, b) is connected to. Every round takes the least root among
    neighbours and then the root's own root, so long chains halve; one shuffle per join, nothing on the driver but a count."""
    both = settled(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    now = settled(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    for _ in range(most):
        near = both.join(now, both.b == now.node).groupBy("a").agg(F.min("root").alias("low"))
        step = now.join(near, now.node == near.a, "left").select("node", "root", F.least("root", "low").alias("next"))
        up = now.select(F.col("node").alias("next"), F.col("root").alias("above"))
        then = settled(step.join(up, "next", "left").select("node", F.least("next", "above").alias("root"), (F.least("next", "above") < F.col("root")).alias("moved")))
        now = then.select("node", "root")
        if then.where("moved").isEmpty():
            return now
    raise RuntimeError(f"the components have not settled after {most} rounds")
