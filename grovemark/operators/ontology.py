"""Ids of an ontology: resolving, labels, neighbourhoods, layers, weights, targets and verdict-based pruning."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovemark.operators.graph import COUNTED_EDGES, MAX_EDGES, Levels, longest_depths, nodes
from grovemark.plans.scratch import settled


def resolved(codes: DataFrame, alternates: DataFrame, known: DataFrame, scorable: DataFrame) -> DataFrame:
    """codes(*, code) with primary (the id that a trimmed code or alternate id stands for, null if unknown), term (that id if
    it is scorable) and class: scorable, out_of_subtree or nonexistent. alternates(alt, term)."""
    a = alternates.groupBy("alt").agg(F.min("term").alias("__a"))
    met = codes.withColumn("__c", F.trim("code")).join(a, F.col("__c") == F.col("alt"), "left").withColumn("__p", F.coalesce("__a", "__c")).drop("alt", "__a", "__c")
    k = known.select(F.col("term").alias("__p")).distinct().withColumn("__k", F.lit(True))
    s = scorable.select(F.col("term").alias("__p")).distinct().withColumn("__s", F.lit(True))
    met = met.join(k, "__p", "left").join(s, "__p", "left")
    kind = F.when(F.col("__s"), "scorable").when(F.col("__k"), "out_of_subtree").otherwise("nonexistent")
    return met.withColumns({"primary": F.when(F.col("__k"), F.col("__p")), "term": F.when(F.col("__s"), F.col("__p")), "class": kind}).drop("__p", "__k", "__s")


def resolved_sets(rows: DataFrame) -> DataFrame:
    """report, kept (distinct scorable terms), dropped (distinct codes that stand for none): of resolved(report, code)."""
    return rows.groupBy("report").agg(F.array_sort(F.collect_set("term")).alias("kept"), F.array_sort(F.collect_set(F.when(F.col("term").isNull(), F.col("code")))).alias("dropped"))


def labelled(codes: DataFrame, labels: DataFrame) -> DataFrame:
    """codes(code) with label: the term's first label, else the code itself."""
    first = labels.groupBy(F.col("term").alias("code")).agg(F.min("label").alias("label"))
    return codes.join(first, "code", "left").withColumn("label", F.coalesce("label", "code"))


def restricted(pairs: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs of the listed reports, and the listed reports that have none."""
    return pairs.join(listed.select("report").distinct(), "report", "left_semi"), listed.select("report").distinct().join(pairs, "report", "left_anti")


def verified(entries: DataFrame, accepted: Sequence[str]) -> DataFrame:
    """report, n_rows, n_kept, no_id: entries(report, code, verdict) whose verdict is accepted; no_id counts kept ones without
    a code."""
    keep = F.col("verdict").isin(*accepted)
    return entries.groupBy("report").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(keep & F.col("code").isNotNull()).alias("n_kept"), F.count_if(keep & F.col("code").isNull()).alias("no_id"))


def neighbours(edges: DataFrame) -> DataFrame:
    """term, other: parents and children of every term."""
    return edges.select(F.col("child").alias("term"), F.col("parent").alias("other")).union(edges.select("parent", "child")).distinct()


def ordered(edges: DataFrame) -> DataFrame:
    """term, layer, place: parents before children; within a layer by id. The ontology's terms are ranked in one window."""
    layers = longest_depths(edges)
    return layers.select("term", F.col("depth").alias("layer"), (F.row_number().over(Window.orderBy("depth", "term")) - 1).alias("place"))


def within_hops(gold: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """report, term, distance of the terms at most so many steps from a gold term, along edges in either direction."""
    both = neighbours(edges)
    done = settled(gold.select("report", "term").distinct().withColumn("distance", F.lit(0)))
    new = done
    for hop in range(1, most + 1):
        step = new.select("report", "term").join(both, "term").select("report", F.col("other").alias("term")).distinct()
        new = settled(step.join(done, ["report", "term"], "left_anti").select("report", "term", F.lit(hop).alias("distance")))
        done = done.unionByName(new)
    return done


class Links:
    """An undirected graph as numbers: each node's neighbours in one array. It travels to the tasks like Levels. lot: steps
    taken at once; places that take more are walked in smaller groups."""

    def __init__(self, edges: DataFrame, lot: int) -> None:
        self.lot = lot
        both = neighbours(edges).toArrow()
        self.names = pc.unique(both["term"]).sort()
        x, y = (pc.index_in(both[c], value_set=self.names).to_numpy() for c in ("term", "other"))
        self.other = y[np.argsort(x, kind="stable")]
        self.degree = np.bincount(x, minlength=len(self.names))
        self.start = np.cumsum(self.degree) - self.degree

    def step(self, keys: np.ndarray) -> np.ndarray | None:
        """The neighbours of keys (place times nodes plus node), distinct and sorted; None if they are too many at once."""
        place, node = np.divmod(keys, len(self.names))
        n = self.degree[node]
        if n.sum() > self.lot and len(keys) and place[0] != place[-1]:
            return None
        at = np.repeat(self.start[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return _distinct(np.repeat(place * len(self.names), n) + self.other[at])

    def counts(self, keys: np.ndarray, most: int, out: np.ndarray) -> None:
        """Adds to out[hops, place] how many nodes lie that many steps from the sorted keys of a place."""
        rings = [keys]
        for _ in range(most):
            step = self.step(rings[-1])
            if step is None:
                place = keys // len(self.names)
                cut = np.searchsorted(place, (place[0] + place[-1] + 1) // 2)
                self.counts(keys[:cut], most, out)
                self.counts(keys[cut:], most, out)
                return
            # A neighbour of the last ring lies in it, in the one before or in the next.
            for ring in rings[-2:]:
                step = step[~_held(step, ring)]
            rings.append(step)
        for hops, ring in enumerate(rings):
            np.add.at(out[hops], ring // len(self.names), 1)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys, sorted: np.unique hashes them, which takes ten times as long here."""
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=-1) > 0]


def _held(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of the keys are among the sorted others."""
    if not len(of):
        return np.zeros(len(keys), bool)
    return of[np.minimum(np.searchsorted(of, keys), len(of) - 1)] == keys


def within_counts(gold: DataFrame, edges: DataFrame, most: int, lot: int = 4_000_000) -> DataFrame:
    """report, distance, n: within_hops() counted where a report's gold lies, so that the terms are never listed. Gold outside
    the graph does not count. Above the graph's bound the terms are listed and then counted."""
    if edges.count() > COUNTED_EDGES:
        inside = gold.join(nodes(edges), "term", "left_semi").select("report", "term")
        return within_hops(inside, edges, most).groupBy("report", "distance").agg(F.count(F.lit(1)).alias("n"))
    graph = gold.sparkSession.sparkContext.broadcast(Links(edges, lot))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph.value
        for b in batches:
            at = pc.fill_null(pc.index_in(b["terms"].flatten(), value_set=g.names), -1).to_numpy(zero_copy_only=False)
            place = np.repeat(np.arange(len(b)), pc.list_value_length(b["terms"]).to_numpy(zero_copy_only=False))
            out = np.zeros((most + 1, len(b)), np.int64)
            if (at >= 0).any():
                g.counts(_distinct(place[at >= 0] * len(g.names) + at[at >= 0]), most, out)
            hops, row = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([b["report"].take(pa.array(row)), pa.array(hops, pa.int32()), pa.array(out[hops, row])], names=["report", "distance", "n"])

    each = gold.groupBy("report").agg(F.collect_set("term").alias("terms"))
    return each.mapInArrow(counted, f"report {gold.schema['report'].dataType.simpleString()}, distance int, n long")


def reachable(edges: DataFrame, expanded: DataFrame, roots: DataFrame, most: int = 64) -> DataFrame:
    """report, term: what can be reached from the roots through terms that the report expanded(report, term)."""
    seen = settled(expanded.select("report").distinct().crossJoin(F.broadcast(roots.select("term").distinct())))
    new = seen
    for _ in range(most):
        step = new.join(expanded, ["report", "term"], "left_semi").join(edges, F.col("term") == F.col("parent")).select("report", F.col("child").alias("term")).distinct()
        new = settled(step.join(seen, ["report", "term"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
    raise ValueError("the graph has a cycle or more levels than allowed")


def induced(pairs: DataFrame, closed: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """report, n_nodes, n_edges, thinned: the graph of a report's terms and all their ancestors, cut to the most nodes that
    lie under the fewest steps."""
    up = pairs.join(closed, pairs.term == closed.descendant).groupBy("report", F.col("ancestor").alias("term")).agg(F.min("hops").alias("hops"))
    place = F.row_number().over(Window.partitionBy("report").orderBy("hops", "term"))
    kept = up.withColumn("place", place).where(F.col("place") <= most).select("report", "term")
    inner = kept.join(edges, kept.term == edges.child).select("report", F.col("parent").alias("term")).join(kept, ["report", "term"], "left_semi")
    sizes = up.groupBy("report").agg(F.count(F.lit(1)).alias("all"))
    n = kept.groupBy("report").agg(F.count(F.lit(1)).alias("n_nodes")).join(inner.groupBy("report").agg(F.count(F.lit(1)).alias("n_edges")), "report", "left").join(sizes, "report")
    return n.select("report", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), (F.col("all") > F.col("n_nodes")).alias("thinned"))


def ancestor_weights(edges: DataFrame, most: int = 64) -> DataFrame:
    """descendant, ancestor, weight: 1 for the term itself; a term hands its weight to its parents in equal parts, and what
    arrives by several ways adds up."""
    share = edges.groupBy("child").agg((1.0 / F.count(F.lit(1))).alias("part")).join(edges, "child")
    done = settled(nodes(edges).select(F.col("term").alias("descendant"), F.col("term").alias("ancestor"), F.lit(1.0).alias("weight")))
    new = done
    for _ in range(most):
        new = settled(new.join(share, new.ancestor == share.child).select("descendant", F.col("parent").alias("ancestor"), (F.col("weight") * F.col("part")).alias("weight")))
        if new.isEmpty():
            return done.groupBy("descendant", "ancestor").agg(F.sum("weight").alias("weight"))
        done = done.unionByName(new)
    raise ValueError("the graph has a cycle or more levels than allowed")


def branch_index(closed: DataFrame, roots: DataFrame) -> DataFrame:
    """root, term, idx: the terms below each root numbered from 0 by id."""
    below = closed.join(F.broadcast(roots.select(F.col("term").alias("ancestor")).distinct()), "ancestor").select(F.col("ancestor").alias("root"), F.col("descendant").alias("term"))
    return below.withColumn("idx", F.row_number().over(Window.partitionBy("root").orderBy("term")) - 1)


def target_sets(targets: DataFrame, closed: DataFrame) -> DataFrame:
    """target, term: each target with all that lies below it; unknown targets drop out."""
    return targets.select("target").distinct().join(closed, F.col("target") == F.col("ancestor")).select("target", F.col("descendant").alias("term"))


def projected(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """report, term: the targets that a report's terms fall under."""
    return pairs.join(sets, "term").select("report", F.col("target").alias("term")).distinct()


def expanded_targets(gold: DataFrame, closed: DataFrame, more: DataFrame) -> DataFrame:
    """term: every gold term's ancestors, itself included, and the further terms given."""
    return gold.select("term").distinct().join(closed, F.col("term") == F.col("descendant")).select(F.col("ancestor").alias("term")).union(more.select("term")).distinct()


def _cut(g: Levels, skipped: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """Which terms are pruned if these are weak."""
    low = weak & ~skipped
    pruned, above = np.zeros(len(low), bool), np.zeros(len(low), bool)  # above: is any parent low
    for node, parent, first in g.steps:
        cut = np.logical_or.reduceat((pruned | low & above)[parent], first) & ~skipped[node]
        above[node] = np.logical_or.reduceat(low[parent], first)
        pruned[node] = cut
        low[node] |= cut
    return pruned


def verdicts(edges: DataFrame, scores: DataFrame, accept: Sequence[float], prune: Sequence[float], skip_depth: int = 0, rule: str = "confident", max_levels: int = 64) -> DataFrame:
    """report, tau_accept, tau_prune, term, verdict: yes, no, pruned or skipped, for every pair of thresholds.

    In order of depth a term is pruned if a parent is, or if a parent and one of that parent's parents are low. Low means
    pruned or, by the rule confident, scored below tau_prune; by the rule two_no, answered no. Terms of depth up to
    skip_depth are skipped and never low. The scores of a report, one a term, meet in one group and all threshold pairs
    are walked there; the graph travels to the tasks, and its size is checked."""
    if edges.count() > MAX_EDGES:
        raise ValueError(f"the graph has over {MAX_EDGES} edges, too many to travel to every task")
    graph = scores.sparkSession.sparkContext.broadcast(Levels(edges, max_levels))

    def walked(part: pd.DataFrame) -> pd.DataFrame:
        g, out = graph.value, []
        known, at = g.places(part["term"])
        conf = np.full(len(g.terms), np.nan)
        conf[at] = part["score"].to_numpy(dtype=float)[known]
        skipped = g.depth <= skip_depth
        for ta in accept:
            yes = np.nan_to_num(conf, nan=0.0) >= ta
            for tp in prune:
                pruned = _cut(g, skipped, ~yes if rule == "two_no" else conf < tp)
                name = np.where(skipped, "skipped", np.where(pruned, "pruned", np.where(yes, "yes", "no")))
                out.append(pd.DataFrame({"report": part["report"].iloc[0], "tau_accept": ta, "tau_prune": tp, "term": g.terms, "verdict": name}))
        return pd.concat(out, ignore_index=True)

    kind = scores.schema["report"].dataType.simpleString()
    return scores.select("report", "term", "score").groupBy("report").applyInPandas(walked, f"report {kind}, tau_accept double, tau_prune double, term string, verdict string")


def verdict_counts(edges: DataFrame, scores: DataFrame, told: DataFrame, leaf: str, accept: Sequence[float], prune: Sequence[float], skip_depth: int = 0, rule: str = "confident", max_levels: int = 64) -> DataFrame:
    """report, tau_accept, tau_prune, np, tr, g: of verdicts(), counted where a report is walked: terms like the pattern leaf
    with the verdict yes, those of them that are gold, and the report's gold. scores(report, term, score) and
    told(report, term, score, y) each hold a term once and none in common; y: is it gold."""
    if edges.count() > COUNTED_EDGES:
        raise ValueError(f"the graph has over {COUNTED_EDGES} edges, too many to travel to every task")
    levels = Levels(edges, max_levels)
    graph = scores.sparkSession.sparkContext.broadcast((levels, pc.match_like(levels.names, leaf).to_numpy(zero_copy_only=False)))

    def walked(own: pa.Table, known: pa.Table) -> pa.Table:
        g, leaves = graph.value
        conf, gold = np.full(len(g.names), np.nan), np.zeros(len(g.names), bool)
        held = pc.fill_null(known["y"], False).to_numpy()
        for part in (own, known):
            at = g.numbers(part["term"])
            conf[at[at >= 0]] = part["score"].to_numpy()[at >= 0]
        gold[at[(at >= 0) & held]] = True
        skipped, pruned, rows = g.depth <= skip_depth, {}, []
        for ta in accept:
            yes = np.nan_to_num(conf, nan=0.0) >= ta
            for tp in prune:
                key = ta if rule == "two_no" else tp
                if key not in pruned:
                    pruned[key] = _cut(g, skipped, ~yes if rule == "two_no" else conf < tp)
                said = yes & ~skipped & ~pruned[key] & leaves
                rows.append((ta, tp, int(said.sum()), int((said & gold).sum()), int(held.sum())))
        columns = [pa.repeat((own if own.num_rows else known)["report"][0], len(rows)), *map(pa.array, zip(*rows, strict=True))]
        return pa.table(columns, names=["report", "tau_accept", "tau_prune", "np", "tr", "g"])

    left, right = scores.select("report", "term", "score"), told.select("report", "term", "score", "y")
    kind = scores.schema["report"].dataType.simpleString()
    return left.groupBy("report").cogroup(right.groupBy("report")).applyInArrow(walked, f"report {kind}, tau_accept double, tau_prune double, np long, tr long, g long")


def sweep_summary(rows: DataFrame, floor: float) -> DataFrame:
    """which, tau_accept, tau_prune, precision, recall, f1 of rows: the best f1, and the best recall at a precision of at
    least floor; ties to the smaller thresholds."""
    cols = ("tau_accept", "tau_prune", "precision", "recall", "f1")
    best = lambda d, c, n: d.agg(F.min(F.struct((-F.round(c, 9)).alias("o"), *cols)).alias("x")).where("x is not null").select(F.lit(n).alias("which"), "x.*").drop("o")
    return best(rows, "f1", "best_f1").unionByName(best(rows.where(F.col("precision") >= floor), "recall", "best_recall_at_floor"))


