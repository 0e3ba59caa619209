"""The nearest reference term of each prediction on graphs too large to be walked once per term.

The graph travels to the tasks, about 10 bytes an edge, 32 bytes a node and the names. Distances from the nodes of most
edges (hubs) are known to all nodes; a path that meets a hub is no shorter than by way of it. What avoids them is looked for
by its length: up to four steps by lookups of edges and of two-step paths, beyond that by spheres that grow from both ends,
and where these are large by a walk of the whole graph, so the distances are exact on every graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hubs; the degree up to which a node's pairs of neighbours are listed; rows that a task looks at together; pairs or steps
#: that are expanded together; the expansion of one pair above which it is walked instead.
HUBS, LISTED, ROWS, LOT, WIDE = 32, 8, 100_000, 500_000, 65_536


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), then the same of each further range."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def _lots(size: np.ndarray, lot: int) -> Iterator[slice]:
    """Slices of rows whose sizes add up to lot at most, or of one row."""
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + lot, "right")))
        yield slice(lo, hi)
        lo = hi


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct numbers in order, by sorting keys in place; np.unique hashes them one by one."""
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new]


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among known, which are sorted?"""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _hashes(terms: pa.Array, lot: int = 250_000) -> np.ndarray:
    """A number of 64 bits for each string, equal for equal strings."""
    out = np.zeros(len(terms), np.uint64)
    for lo in range(0, len(terms), lot):
        some = pc.fill_null(terms.slice(lo, lot), "")
        starts = np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + len(some) + 1].astype(np.int64)
        size = np.diff(starts)
        if not size.any():
            continue
        data = np.frombuffer(some.buffers()[2], np.uint8)[starts[0] : starts[-1]]
        power = np.cumprod(np.full(int(size.max()), 0xD1342543DE82EF95, np.uint64))
        each = (data.astype(np.uint64) + np.uint64(1)) * power[_ranges(np.zeros(len(size), np.int64), size)]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each)))
        out[lo : lo + lot] = sums[starts[1:] - starts[0]] - sums[starts[:-1] - starts[0]]
    return out


class _Numbers:
    """The places of strings among names, which are distinct. The hash table of a lookup in Arrow is built anew by each call."""

    def __init__(self, names: pa.Array) -> None:
        own = _hashes(names)
        self.names, self.order = names, np.argsort(own).astype(np.int32)
        self.hashes = own[self.order]

    def of(self, terms: pa.Array) -> np.ndarray:
        """-1 for what is no name."""
        own = _hashes(terms)
        out, at = np.full(len(terms), -1, np.int64), np.searchsorted(self.hashes, own)
        left = np.flatnonzero(pc.is_valid(terms).to_numpy(zero_copy_only=False))
        while len(left):
            left = left[at[left] < len(self.hashes)]
            left = left[self.hashes[at[left]] == own[left]]
            place = self.order[at[left]]
            same = pc.equal(self.names.take(pa.array(place)), terms.take(pa.array(left))).to_numpy(zero_copy_only=False).astype(bool)
            out[left[same]] = place[same]
            # Another name may have the same hash.
            left = left[~same]
            at[left] += 1
        return out


class _Keys:
    """A set of numbers; most of what is not in it is told by a table of bits of their products."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = _distinct(keys)
        self.shift = np.uint64(64 - max(4, int(8 * len(self.keys)).bit_length()))
        table = np.zeros(1 << (64 - int(self.shift)), bool)
        table[self._at(self.keys)] = True
        self.table = np.packbits(table, bitorder="little")

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self._at(keys)
        out = (self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        some = np.flatnonzero(out)
        if len(some):
            at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
            out[some] = self.keys[at] == keys[some]
        return out


class _Links:
    """Neighbours of each node: ends[starts[i] : starts[i + 1]] of node i."""

    def __init__(self, n: int, x: np.ndarray, y: np.ndarray) -> None:
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(x, minlength=n))))
        self.ends = y[np.argsort(x, kind="stable")].astype(np.int32)

    def size(self, at: np.ndarray) -> np.ndarray:
        return self.starts[at + 1] - self.starts[at]

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of at, each as often as it has neighbours, and these."""
        size = self.size(at)
        return np.repeat(np.arange(len(at)), size), self.ends[_ranges(self.starts[at], size)]


class Graph:
    """Terms of edges(child, parent) and of inside(term) as numbers in the order of their names. Built on the driver."""

    def __init__(self, edges: DataFrame, inside: DataFrame | None, hubs: int = HUBS) -> None:
        pairs = edges.select("child", "parent").where("child is not null and parent is not null").distinct().toArrow()
        own = None if inside is None else inside.select("term").where("term is not null").distinct().toArrow()["term"]
        m, known = len(pairs), [] if own is None else own.chunks
        met = pa.chunked_array([*pairs["child"].chunks, *pairs["parent"].chunks, *known, pa.array([], pa.string())], pa.string())
        del pairs, own, known
        met = met.dictionary_encode()  # all chunks have one dictionary
        at, names = np.concatenate([c.indices.to_numpy() for c in met.chunks]), met.chunk(met.num_chunks - 1).dictionary.cast(pa.string())
        order = pc.sort_indices(names)
        self.names, n = names.take(order), len(names)
        place = np.empty(n, np.int32)
        place[order.to_numpy()] = np.arange(n, dtype=np.int32)
        at = place[at]
        self.child, self.parent = at[:m].copy(), at[m : 2 * m].copy()
        self.inside = np.zeros(n, bool)
        self.inside[at if inside is None else at[2 * m :]] = True
        top = np.argsort(-np.bincount(at[: 2 * m], minlength=n), kind="stable")[:hubs]
        del met, at, names, order, place
        both, far = self.links(), []
        for h in top:
            d = self.spread(np.array([h]), both)[0]
            # The greatest value stands for: no path.
            kind = np.uint8 if d.max() < 255 else np.int32
            far.append(np.where(d < 0, np.iinfo(kind).max, d).astype(kind))
        self.hubs, self.far = top, far

    def links(self) -> _Links:
        """Every edge in both directions, once."""
        n = len(self.names)
        a, b = self.child.astype(np.int64), self.parent.astype(np.int64)
        key = _distinct(np.concatenate(((a * n + b)[a != b], (b * n + a)[a != b])))
        del a, b
        return _Links(n, key // max(n, 1), key % max(n, 1))

    @staticmethod
    def spread(seeds: np.ndarray, both: _Links) -> tuple[np.ndarray, np.ndarray]:
        """Of every node the steps to the nearest seed, -1 without a path, and the smallest such seed."""
        n = len(both.starts) - 1
        hops, source, hop = np.full(n, -1, np.int32), np.full(n, n, np.int32), 0
        hops[seeds], source[seeds] = 0, seeds
        front = seeds
        while len(front):
            hop += 1
            row, node = both.of(front)
            new = hops[node] < 0
            row, node = row[new], node[new]
            if len(seeds) > 1:
                np.minimum.at(source, node, source[front][row])
            else:
                source[node] = seeds[0]
            hops[node] = hop
            front = np.flatnonzero(hops == hop) if len(node) else node
        return hops, source

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("names", "child", "parent", "inside", "hubs", "far")}

    def ready(self) -> Graph:
        """Adds the lookups, once in each worker."""
        if not hasattr(self, "both"):
            n = len(self.names)
            self.places = _Numbers(self.names)
            self.up = _Links(n, self.child, self.parent)
            self.inner = np.zeros(n, bool)
            self.inner[self.parent] = True
            self.known = self.inner.copy()
            self.known[self.child] = True
            self.both = self.links()
            x, y = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.both.starts)), self.both.ends
            self.edge = _Keys(x.astype(np.int64) * n + y)
            # Are all paths between two nodes that a hub reaches of equal parity?
            first = np.full(n, -1, np.int8)
            for d in self.far[::-1]:
                known = d != np.iinfo(d.dtype).max
                first[known] = d[known] & 1
            self.even = bool((first[x] != first[y])[(first[x] >= 0) & (first[y] >= 0)].all())
            plain = np.ones(n, bool)
            plain[self.hubs] = False
            keep = plain[x] & plain[y]
            x, y = x[keep], y[keep]
            del keep, first
            self.light = _Links(n, x, y)
            size = np.diff(self.light.starts)
            self.big = _Links(n, x[size[y] > LISTED], y[size[y] > LISTED])
            through = np.flatnonzero((size >= 2) & (size <= LISTED))
            row, s = self.light.of(through)
            again, t = self.light.of(through[row])
            s = s[again]
            other = s != t
            self.path = _Keys(s[other].astype(np.int64) * n + t[other])
        return self

    def two(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Do s and t, which differ, have a common neighbour that is no hub?"""
        n = len(self.names)
        out = self.path.has(s * n + t)
        some = np.flatnonzero(~out & (self.big.size(s) > 0) & (self.big.size(t) > 0))
        for lot in _lots(self.big.size(s[some]), LOT):
            row, x = self.big.of(s[some[lot]])
            out[some[lot][row[self.edge.has(x.astype(np.int64) * n + t[some[lot]][row])]]] = True
        return out

    def steps(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Is there a path of k steps (k from 1 to 4) without hubs, where there is none of fewer?"""
        if k == 1:
            return self.edge.has(a * len(self.names) + b)
        if k == 2:
            return self.two(a, b)
        out = np.zeros(len(a), bool)
        if k == 3:
            turn = self.light.size(a) > self.light.size(b)
            a, b = np.where(turn, b, a), np.where(turn, a, b)
        for lot in _lots(self.light.size(a) * (self.light.size(b) if k == 4 else 1), LOT):
            row, s = self.light.of(a[lot])
            t = b[lot][row]
            if k == 4:
                again, t = self.light.of(t)
                row, s = row[again], s[again]
            s, t = s.astype(np.int64), t.astype(np.int64)
            hit = s == t
            hit[~hit] = self.two(s[~hit], t[~hit])
            out[np.arange(lot.start, lot.stop)[row[hit]]] = True
        return out

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Steps between nodes a and b, which differ; -1 without a path."""
        none = np.iinfo(np.int32).max
        most, least, apart, met = np.full(len(a), none, np.int32), np.zeros(len(a), np.int32), np.zeros(len(a), bool), np.zeros(len(a), bool)
        for d in self.far:
            x, y = d[a].astype(np.int32), d[b].astype(np.int32)
            end = np.iinfo(d.dtype).max
            on, off = (x < end) & (y < end), (x < end) != (y < end)
            apart |= off
            met |= on
            np.minimum(most, np.where(on, x + y, none), out=most)
            np.maximum(least, np.where(on, np.abs(x - y), 0), out=least)
        apart |= (self.both.size(a) == 0) | (self.both.size(b) == 0)
        out = np.where(apart, -1, most)
        left = np.flatnonzero(~apart & (least < most))
        wide = np.zeros(len(a), bool)
        for k in range(1, 5):
            may = (least[left] <= k) & (k < most[left])
            if self.even:
                may &= ~met[left] | ((most[left] ^ k) & 1 == 0)
            if k > 2:
                cost = self.light.size(a[left]) * self.light.size(b[left]) if k == 4 else np.minimum(self.light.size(a[left]), self.light.size(b[left]))
                wide[left[may & (cost > WIDE)]] = True
                may &= cost <= WIDE
            at = left[may]
            hit = at[self.steps(k, a[at], b[at])]
            # A pair left for the walk keeps its place there, for a shorter path may have been passed over.
            out[hit[~wide[hit]]] = k
            found = np.zeros(len(a), bool)
            found[hit[~wide[hit]]] = True
            left = left[~found[left]]
        next_ = np.maximum(np.where(self.even & met[left], 5 + ((most[left] ^ 5) & 1), 5), least[left])
        left = left[wide[left] | (most[left] > next_)]
        if len(left):
            out[left], large = self.spheres(a[left], b[left], most[left])
            left = left[large]
        if len(left):
            out[left] = self.walked(a[left], b[left])
        return out

    def spheres(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Steps of the shortest path without hubs between a and b where these are below most, else most, or -1 for the
        greatest number; and which pairs are left undecided, for their spheres are large.

        Spheres around both ends grow by turns, the cheaper one first, and meet at the shortest path."""
        n, out, large, none = len(self.names), most.copy(), np.zeros(len(a), bool), np.zeros(0, np.int64)
        todo = [(0, at, (at * n + a[at], at * n + b[at]), (none, none)) for at in (np.arange(lot.start, lot.stop) for lot in _lots(np.ones(len(a), np.int64), ROWS))]
        while todo:
            k, row, last, before = todo.pop()
            cost = [np.bincount(np.searchsorted(row, s // n), self.light.size(s % n), len(row)) for s in last]
            least = np.minimum(*cost)
            # A sphere that cannot grow has met all it can meet.
            go = (k + 1 < most[row]) & (least > 0)
            large[row[go & (least > WIDE)]] = True
            go &= least <= WIDE
            row, least, turn = row[go], least[go], (cost[1] < cost[0])[go]
            last, before = (tuple(s[_among(s // n, row)] for s in side) for side in (last, before))
            if not len(row):
                continue
            if least.sum() > LOT and len(row) > 1:
                cut = row[len(row) // 2] * n
                todo += [(k, r, tuple(s[f(s)] for s in last), tuple(s[f(s)] for s in before)) for r, f in ((row[: len(row) // 2], lambda s: s < cut), (row[len(row) // 2 :], lambda s: s >= cut))]  # noqa: B023
                continue
            now, past = [], []
            for i in (0, 1):
                grows, grew = (turn[np.searchsorted(row, s // n)] == i for s in (last[i], before[i]))
                own = last[i][grows]
                at, node = self.light.of(own % n)
                new = _distinct((own // n)[at] * n + node)
                new = new[~_among(new, own) & ~_among(new, before[i])]
                now.append(np.sort(np.concatenate((last[i][~grows], new))))
                past.append(np.sort(np.concatenate((before[i][~grew], own))))
            met = now[0][_among(now[0], now[1])] // n
            out[met] = k + 1
            row = row[~_among(row, met)]
            todo.append((k + 1, row, *(tuple(s[_among(s // n, row)] for s in side) for side in (now, past))))
        return np.where(out == np.iinfo(np.int32).max, -1, out), large

    def walked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """between() by walking the graph, 64 nodes at a time, a bit each."""
        nodes, row = np.unique(a, return_inverse=True)
        some = np.flatnonzero(np.diff(self.both.starts))
        starts, hops = self.both.starts[some], np.full(len(a), -1, np.int32)
        order = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[order], np.arange(0, len(nodes) + 64, 64))
        for lo, hi, k in zip(cuts, cuts[1:], range(0, len(nodes), 64), strict=False):
            mine = order[lo:hi]
            bit, seen, hop = (row[mine] - k).astype(np.uint64), np.zeros(len(self.names), np.uint64), 0
            seen[nodes[k : k + 64]] = np.uint64(1) << np.arange(len(nodes[k : k + 64]), dtype=np.uint64)
            while len(mine):
                hit = (seen[b[mine]] >> bit & np.uint64(1)) == 1
                hops[mine[hit]] = hop
                mine, bit = mine[~hit], bit[~hit]
                wider = seen.copy()
                wider[some] |= np.bitwise_or.reduceat(seen[self.both.ends], starts)
                if (wider == seen).all():
                    break
                seen, hop = wider, hop + 1
        return hops

    def above(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Is a, which differs from b, a strict ancestor of b?"""
        out, n = np.zeros(len(a), bool), len(self.names)
        row = np.flatnonzero(self.inner[a])
        node = b[row]
        for lot in _lots(np.ones(len(row), np.int64), ROWS):
            at, front = row[lot], node[lot].astype(np.int64)
            seen = np.zeros(0, np.int64)
            while len(at):
                i, up = self.up.of(front)
                key = np.unique(at[i] * n + up)
                key = key[~np.isin(key, seen)]
                seen = np.concatenate((seen, key))
                at, front = key // n, key % n
                out[at[front == a[at]]] = True
                go = ~out[at]
                at, front = at[go], front[go]
        return out

    def siblings(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Have a and b a parent in common?"""
        out, n = np.zeros(len(a), bool), len(self.names)
        if not hasattr(self, "climb"):
            self.climb = _Keys(self.child.astype(np.int64) * n + self.parent)
        for lot in _lots(self.up.size(a), LOT):
            row, p = self.up.of(a[lot])
            out[np.arange(lot.start, lot.stop)[row[self.climb.has(b[lot][row] * n + p)]]] = True
        return out

    def nearest(self, group: np.ndarray, at: np.ndarray, starts: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each node at[i] the steps to the nearest of gold[starts[group[i]] : starts[group[i] + 1]], sorted and without
        at[i], and the smallest such; -1 where no path leads to one. Groups ascend."""
        hops, other = np.full(len(at), -1, np.int64), np.full(len(at), -1, np.int64)
        size = starts[group + 1] - starts[group]
        # A group of more pairs than the graph has edges is served by one walk from all its gold.
        pairs = np.bincount(group, size, len(starts) - 1)
        for k in np.flatnonzero(pairs > max(LOT, len(self.both.ends))):
            mine = group == k
            d, s = self.spread(gold[starts[k] : starts[k + 1]], self.both)
            hops[mine], other[mine] = d[at[mine]], np.where(d[at[mine]] < 0, -1, s[at[mine]])
            size = np.where(mine, 0, size)
        rows = np.flatnonzero(size > 0)
        for lot in _lots(size[rows], LOT):
            r, n = rows[lot], size[rows[lot]]
            b = gold[_ranges(starts[group[r]], n)]
            d = self.between(np.repeat(at[r], n), b).astype(np.int64)
            best = np.minimum.reduceat(np.where(d < 0, np.iinfo(np.int64).max, d * len(self.names) + b), np.cumsum(n) - n)
            some = best < np.iinfo(np.int64).max
            hops[r[some]], other[r[some]] = best[some] // len(self.names), best[some] % len(self.names)
        return hops, other

    def judged(self, rows: pa.Table, kinds: bool) -> pa.Table:
        """report, term, other, distance, kind of the predictions (not g) among rows(report, term, g), whose reports are
        whole and adjoin."""
        report, n = rows["report"], len(self.names)
        new = np.ones(len(rows), bool)
        new[1:] = pc.fill_null(pc.not_equal(report.slice(1), report.slice(0, len(rows) - 1)), True).to_numpy()
        group, at, g = np.cumsum(new) - 1, self.places.of(rows["term"].combine_chunks()), rows["g"].to_numpy()
        ok = at >= 0
        ok[ok] = self.inside[at[ok]]
        ok_gold = g & ok
        key = np.unique(group[ok_gold] * n + at[ok_gold])
        starts, gold = np.searchsorted(key, np.arange(group[-1] + 2) * n), key % max(n, 1)
        wrong = ~g
        wrong[wrong & ok] = ~np.isin(group[wrong & ok] * n + at[wrong & ok], key)
        wrong = np.flatnonzero(wrong)
        asked = ok[wrong]
        hops, other = np.full(len(wrong), -1, np.int64), np.full(len(wrong), -1, np.int64)
        hops[asked], other[asked] = self.nearest(group[wrong[asked]], at[wrong[asked]], starts, gold)
        found = hops >= 0
        names = self.names.take(pa.array(other, mask=~found))
        out = {"report": report.take(pa.array(wrong)), "term": rows["term"].take(pa.array(wrong)), "other": names, "distance": pa.array(hops.astype(np.int32), mask=~found)}
        if kinds:
            kind = np.where(starts[group[wrong] + 1] > starts[group[wrong]], "unrelated", "no_gold").astype(object)
            a, b = at[wrong[found]], other[found]
            kind[found] = np.select([self.above(a, b), self.above(b, a), self.siblings(a, b)], ["ancestor", "descendant", "sibling"], "unrelated")
            kind[~asked] = np.where((at[wrong] >= 0) & np.append(self.known, False)[at[wrong]], "out_of_subtree", "hallucination")[~asked]
            out["kind"] = pa.array(kind, pa.string())
        return pa.table(out)


def nearest_reference(gold: DataFrame, pred: DataFrame, edges: DataFrame, inside: DataFrame | None = None, kinds: bool = False, rows: int = ROWS, hubs: int = HUBS) -> DataFrame:
    """report, term, other, distance of each of pred(report, term) that is no reference term: the nearest reference term of
    its report along edges in either direction, of equally near ones the smallest; null where there is none. Reference terms
    are gold(report, term) in inside, by default the terms of the graph; a prediction outside has none. With kinds, also
    kind: as errors.classified() has it.

    Both sides meet by one shuffle on the report; a task goes through its reports some rows at a time."""
    graph = gold.sparkSession.sparkContext.broadcast(Graph(edges, inside, hubs))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, held, size = graph.value.ready(), [], 0

        def told(table: pa.Table) -> Iterator[pa.RecordBatch]:
            return iter(g.judged(table.combine_chunks(), kinds).to_batches(max_chunksize=10_000) if len(table) else ())

        for b in batches:
            held.append(b)
            size += len(b)
            if size >= rows:
                table = pa.Table.from_batches(held)
                same = pc.fill_null(pc.not_equal(table["report"], table["report"][-1]), True).to_numpy()
                # A null is no report that others belong to; the last report waits for the rest of its rows.
                cut = int(np.flatnonzero(same)[-1]) + 1 if same.any() else 0
                yield from told(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = 0
        if held:
            yield from told(pa.Table.from_batches(held))

    own = lambda d, g: d.select("report", "term").distinct().withColumn("g", F.lit(g))
    both = own(gold, True).unionByName(own(pred, False)).repartition("report").sortWithinPartitions("report")
    kind = both.schema["report"].dataType.simpleString()
    return both.mapInArrow(walked, f"report {kind}, term string, other string, distance int" + (", kind string" if kinds else ""))
