"""Slopes of the lines through all pairs of points, selected without forming the pairs.

A pair's slope is at most t where the second point (by x) doesn't lie above the first in the order of y - t x. So how many of
the n (n - 1) / 2 slopes lie below t is a number of inversions, and slopes are narrowed by thresholds as ranks.py narrows
values. Points are dealt by ranges of x into sorted blocks and written once. For a threshold each block sorts its points by
y - t x, counts its own inversions, and deals the sorted values to ranges of y - t x. Pairs of other blocks that lie in one
range are inversions of the blocks' numbers there, and pairs of other blocks and other ranges follow from the number of
points of each block in each range. Work is in proportion to n log n for a threshold, memory to a block or a range. Only when
few pairs are left between two thresholds are their slopes computed, by the pairs whose order differs between the two.

Thresholds are chosen by the slopes of some pairs of a sample and by interpolation; they tell only how fast a slope is found.
Pairs with equal x have no slope and are left out, as under addition and removal of rows. Slopes that differ by less than
NEAR of their size, and are more than LEAF_PAIRS, are not told apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.operators.ranks import Asking, Cell
from hushframe.plans.shared import written

#: Points of a block: no more than MOST, no fewer than LEAST, else so that there are about BLOCKS. Ranges of heights are as many, or of 4 MOST points: a threshold deals blocks times ranges rows.
LEAST, BLOCKS, MOST = 1024, 24, 131_072
#: Thresholds of a round at most and at least, values of y - t x that one round deals (about), and pairs between thresholds up to which their slopes are returned (as distinct values).
THRESHOLDS, FEWEST, DEALT, LEAF_PAIRS = 32, 16, 1 << 27, 50_000
#: Points of the driver's sample, pairs of them whose slopes it keeps, and how far from a sought rank (as a share of a cell) thresholds are put.
SAMPLE, SEEN, ASIDE = 65_536, 1 << 21, (0.2, 0.05, 0.01, 2e-3, 4e-4)
#: Slopes are told apart up to this number over the largest |x|, and if they differ by this share; the bits of a double's size.
LARGEST, NEAR, MASK = 1e200, 1e-13, 2**63 - 1
#: Numbers up to which all their pairs are compared at once.
DENSE = 32


def _heights(x: np.ndarray, y: np.ndarray, t: float) -> np.ndarray:
    return -x * math.copysign(1, t) if math.isinf(t) else y - t * x


def _order(x: np.ndarray, z: np.ndarray, t: float) -> np.ndarray:
    """The order of points (sorted by x, y) by heights at t. Points of equal height have the slope t, which is at most t; from below zero it is taken to be above t, where |t| may be too small to move y."""
    return _settled(z.argsort(), z, (lambda at: (at, z[at])) if np.signbit(t) else (lambda at: (at, -x[at], z[at])))


def _settled(o: np.ndarray, z: np.ndarray, keys: Callable[[np.ndarray], tuple]) -> np.ndarray:
    """An order by z in which those of equal z are sorted by keys (of places; the last counts first)."""
    s = z[o]
    same = s[1:] == s[:-1]
    if same.any():
        at = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
        tied = o[at]
        o[at] = tied[np.lexsort(keys(tied))]
    return o


def inversions(v: np.ndarray, w: np.ndarray | None = None) -> int:
    """Pairs of numbers (from 0) of which the first is larger; with weights, the sum of their weights' products."""
    if w is not None and w.sum() <= 4 * len(v):
        v, w = np.repeat(v, w), None
    size = DENSE
    while size < len(v):
        size *= 2
    a = np.full(size, (int(v.max()) if len(v) else 0) + 1, np.int64 if len(v) and v.max() >= 2**29 else np.int32)
    a[: len(v)] = v
    a, total = a.reshape(-1, DENSE), 0
    if w is not None:
        full = np.zeros(size, np.int64)
        full[: len(w)] = w
        full = full.reshape(-1, DENSE)
    for s in range(1, DENSE):
        above = a[:, :-s] > a[:, s:]
        total += int(np.count_nonzero(above)) if w is None else int((full[:, :-s] * full[:, s:])[above].sum())
    if w is None:
        a = np.sort(a, axis=1)
    else:
        o = a.argsort(axis=1, kind="stable")
        a, full = np.take_along_axis(a, o, 1), np.take_along_axis(full, o, 1)
    half = DENSE
    while half < size:
        a = a.reshape(-1, 2 * half)
        if w is None:  # the place of a number of the second half, without those before it there, is that of the first half's that are no larger
            a = a << 1
            a[:, half:] |= 1
            a.sort(axis=1)
            places = (a & 1) @ np.arange(2 * half, dtype=np.int64)
            total += int(len(a) * half * half - (places.sum() - len(a) * (half * (half - 1) // 2)))
            a >>= 1
        else:
            full = full.reshape(-1, 2 * half)
            o = a.argsort(axis=1, kind="stable")
            a, full = np.take_along_axis(a, o, 1), np.take_along_axis(full, o, 1)
            first = np.where(o < half, full, 0)
            after = first.sum(axis=1, keepdims=True) - first.cumsum(axis=1)
            total += int((np.where(o < half, 0, full) * after).sum())
        half *= 2
    return total


def _out_of_order(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all pairs of numbers of which the first is larger."""
    moved = np.zeros(len(v), bool)
    moved[1:] |= v[1:] < np.maximum.accumulate(v)[:-1]
    moved[:-1] |= v[:-1] > np.minimum.accumulate(v[::-1])[::-1][1:]
    at = np.flatnonzero(moved)
    out = []

    def split(at: np.ndarray) -> np.ndarray:
        """Places sorted by their numbers."""
        if len(at) <= DENSE:
            i, j = np.nonzero(np.triu(v[at][:, None] > v[at][None, :], 1))
            out.append((at[i], at[j]))
            return at[v[at].argsort()]
        one, two = split(at[: len(at) // 2]), split(at[len(at) // 2 :])
        first = np.searchsorted(v[one], v[two], "right")  # the first half's from there on are larger
        n = len(one) - first
        if n.any():
            j = np.repeat(np.arange(len(two)), n)
            out.append((one[first[j] + np.arange(len(j)) - np.repeat(n.cumsum() - n, n)], two[j]))
        at = np.concatenate([one, two])
        return at[v[at].argsort()]

    if len(at):
        split(at)
    return (np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])) if out else (at, at)


def crossing(x: np.ndarray, y: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of points (by place) whose slopes lie between two thresholds."""
    base = np.lexsort((y, x))
    x, y = x[base], y[base]
    before = _order(x, _heights(x, y, low), low)
    rank = np.empty(len(x), np.int64)
    rank[_order(x, _heights(x, y, high), high)] = np.arange(len(x))
    i, j = _out_of_order(rank[before])
    i, j = before[i], before[j]
    good = x[i] < x[j]
    return base[i[good]], base[j[good]]


def _place(x: float) -> int:
    """A number's place in the order of all doubles."""
    i = int(np.float64(x).view(np.int64))
    return i if i >= 0 else -(i & MASK)


def _at(place: int) -> float:
    """The double at a place."""
    return float(np.int64(place).view(np.float64)) if place >= 0 else -float(np.int64(-place).view(np.float64))


def thresholds(low: float, high: float, pieces: int) -> np.ndarray:
    """Cuts between two numbers that halve the doubles there, not the distance, so that slopes of any size are told apart in a few rounds."""
    a, b = _place(low), _place(high)
    cuts = np.unique([_at(a + (b - a) * k // pieces) for k in range(1, pieces)])
    return cuts[(cuts > low) & (cuts < high)]


class Slopes:
    """The slopes of all pairs of points of two columns."""

    def __init__(self, df: DataFrame, x: Column, y: Column):
        points = df.select((x.cast("double") + F.lit(0.0)).alias("x"), (y.cast("double") + F.lit(0.0)).alias("y")).where(~F.isnan("x") & ~F.isnan("y") & F.col("x").isNotNull() & F.col("y").isNotNull())
        n = points.count()
        size = min(MOST, max(LEAST, -(-n // BLOCKS)))
        step = max(1, -(-n // SAMPLE))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []

            def made(xy: np.ndarray) -> pa.RecordBatch:
                xy = np.ascontiguousarray(xy)
                seen = np.ascontiguousarray(xy[:, step // 2 :: step])
                return pa.RecordBatch.from_arrays([*[pa.array([float(v)]) for v in (xy[0, 0], xy[1, 0], xy[0, -1], xy[1, -1])], *[pa.array([v.tobytes()], pa.binary()) for v in (seen, xy[0], xy[1])]], ["low", "first", "high", "last", "seen", "xs", "ys"])

            for b in batches:
                held.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))
                if sum(h.shape[1] for h in held) >= 2 * size:
                    every = np.concatenate(held, axis=1)
                    ends = range(size, every.shape[1] - size + 1, size)
                    yield from (made(every[:, e - size : e]) for e in ends)
                    held = [every[:, ends[-1] :]]
            if held and sum(h.shape[1] for h in held):
                every = np.concatenate(held, axis=1)
                for part in np.array_split(every, -(-every.shape[1] // size), axis=1):
                    yield made(part)

        dealt = points.repartitionByRange(max(1, -(-n // (4 * size))), "x", "y", F.rand()).sortWithinPartitions("x", "y")
        marked = written(dealt.mapInArrow(cut, "low double, first double, high double, last double, seen binary, xs binary, ys binary").withColumn("mark", F.monotonically_increasing_id()), "points")
        # equal points may lie in several blocks, between those of lower and of higher ones
        order = sorted((r["low"], r["first"], r["high"], r["last"], r["mark"], r["seen"]) for r in marked.drop("xs", "ys").collect())  # a row a block
        numbers = df.sparkSession.createDataFrame([(i, o[4]) for i, o in enumerate(order)], "block long, mark long")
        self.count, self.n, self.spark = len(order), n, df.sparkSession
        self.ranges = max(1, min(BLOCKS, n // LEAST), n // (4 * MOST))
        tasks = max(self.spark.sparkContext.defaultParallelism * 2, -(-self.count // 4))
        self.tasks, self.blocks = tasks, marked.join(F.broadcast(numbers), "mark").select("block", "xs", "ys").repartition(tasks, "block")
        self.top = LARGEST / max([1.0, *(abs(v) for o in order for v in (o[0], o[2]))])
        self.sample = np.concatenate([np.frombuffer(o[5], np.float64).reshape(2, -1) for o in order], axis=1) if order else np.empty((2, 0))
        # runs of equal x that lie in several blocks, by the block in which they begin
        self.head, self.tail = np.full(self.count, np.nan), np.full(self.count, np.nan)
        for i in range(1, self.count):
            if order[i][0] == order[i - 1][2]:
                self.tail[i - 1] = self.head[i - 1] if order[i - 1][0] == order[i - 1][2] and self.head[i - 1] == self.head[i - 1] else i - 0.5
                self.head[i] = self.tail[i - 1]
        self.seen = self._sampled()
        self.total = int(self._counted([math.inf])[0])

    def _sampled(self) -> np.ndarray:
        """Sorted slopes of pairs of the sample."""
        (x, y), r = self.sample, np.random.default_rng(0)
        m = len(x)
        i, j = np.triu_indices(m, 1) if m * (m - 1) // 2 <= SEEN else r.integers(0, m, (2, SEEN))
        with np.errstate(all="ignore"):
            slopes = (y[j] - y[i]) / (x[j] - x[i])
        return np.sort(slopes[np.isfinite(slopes)]) + 0.0

    def _ranges(self, t: float) -> np.ndarray:
        """Heights that cut the points into ranges of about as many each, or fewer ranges."""
        z = np.sort(_heights(*self.sample, t))
        return np.unique(z[[len(z) * k // self.ranges for k in range(1, self.ranges)]]) if len(z) and self.ranges > 1 else np.empty(0)

    def _counted(self, thresholds: Sequence[float]) -> np.ndarray:
        """How many slopes are at most each threshold."""
        if not self.count:
            return np.zeros(len(thresholds), np.int64)
        at, head, tail = [float(t) for t in thresholds], self.head, self.tail
        ends = [self._ranges(t) for t in at]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, *parts in zip(*[batch.column(c) for c in range(3)]):
                    block, (x, y) = block.as_py(), (np.frombuffer(p.as_buffer(), np.float64) for p in parts)
                    spans = (x == x[0]) * (head[block] == head[block]) + 2 * ((x == x[-1]) & (tail[block] == tail[block]) & ~((x == x[0]) & (head[block] == head[block])))
                    for k, t in enumerate(at):
                        z = _heights(x, y, t)
                        o = _order(x, z, t)
                        z, c = z[o], spans[o].astype(np.uint8)
                        new = np.flatnonzero(np.concatenate([[True], (z[1:] != z[:-1]) | (c[1:] != c[:-1])]))
                        n = np.diff(new, append=len(z))
                        cut = np.searchsorted(z[new], ends[k])
                        lows, highs = [0, *cut], [*cut, len(new)]
                        running = np.concatenate([[0], n.cumsum()])
                        rows = [(r, z[new[a:b]].tobytes(), n[a:b].tobytes() if b - a < running[b] - running[a] else b"", c[new[a:b]].tobytes() if c[new[a:b]].any() else b"") for r, (a, b) in enumerate(zip(lows, highs)) if a < b]
                        rows.append((-1, (running[highs] - running[lows]).tobytes(), np.int64(inversions(o)).tobytes(), b""))
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows), pa.int32()), pa.array([r for r, *_ in rows], pa.int32()), pa.array([block] * len(rows), pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)]], ["k", "r", "b", "z", "w", "c"])

        def own(rows: Iterator[tuple]) -> int:
            """Inversions of blocks, and pairs of other blocks and other ranges."""
            total, earlier = 0, 0
            for _, _, _, n, within, _ in rows:
                n = np.frombuffer(n, np.int64)
                earlier = earlier + np.zeros(len(n), np.int64)
                total += int(np.frombuffer(within, np.int64)[0]) + int((n * (earlier.sum() - earlier.cumsum())).sum())
                earlier = earlier + n
            return total

        def shared(rows: Iterator[tuple], t: float) -> int:
            """Pairs of other blocks in one range."""
            z, w, b, g = [], [], [], []
            for _, _, block, zs, ws, cs in rows:
                z.append(np.frombuffer(zs, np.float64))
                w.append(np.frombuffer(ws, np.int64) if ws else np.ones(len(z[-1]), np.int64))
                b.append(np.full(len(z[-1]), block, np.int32))
                g.append(np.array([block, head[block], tail[block]])[np.frombuffer(cs, np.uint8)] if cs else np.full(len(z[-1]), float(block)))
            z, w, b, g = (np.concatenate(v) for v in (z, w, b, g))
            # as _order(): of equal height, larger x first, but equal x by block
            o = _settled(z.argsort(), z, (lambda at: (b[at], z[at])) if np.signbit(t) else (lambda at: (b[at], -g[at], z[at])))
            return inversions(b[o] - b.min(), w[o])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (r for batch in batches for r in zip(*[batch.column(c).to_pylist() for c in range(6)]))
            for (k, r), of in groupby(rows, lambda row: row[:2]):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([own(of) if r < 0 else shared(of, at[k])])], ["k", "n"])

        dealt = self.blocks.mapInArrow(deal, "k int, r int, b int, z binary, w binary, c binary").repartition(self.tasks, "k", "r").sortWithinPartitions("k", "r", "b")
        found = {r["k"]: r["n"] for r in dealt.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
        return np.array([found[k] for k in range(len(at))], np.int64)

    def _listed(self, cells: list[Cell]) -> list[list[Cell]]:
        """The distinct slopes within cells.

        Points are dealt by their height at the lower threshold; most lie in the same range at the upper one. Those that
        don't also go to the ranges that they come through, and pairs of two such points are found on the driver: each has
        a slope near or within the cell, so they are few.
        """
        bounds = [(c.low, c.high) for c in cells]
        ends = [(self._ranges(a), self._ranges(b)) for a, b in bounds]

        def sides(x: np.ndarray, y: np.ndarray, k: int) -> list[np.ndarray]:
            return [np.searchsorted(e, _heights(x, y, t), "right") for e, t in zip(ends[k], bounds[k])]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for parts in zip(*[batch.column(c) for c in (1, 2)]):
                    x, y = (np.frombuffer(p.as_buffer(), np.float64) for p in parts)
                    for k in range(len(bounds)):
                        p, q = sides(x, y, k)
                        o = p.argsort(kind="stable")
                        rs, begins = np.unique(p[o], return_index=True)
                        rows = [(int(r), False, at) for r, at in zip(rs, np.split(o, begins[1:]))]
                        off = np.flatnonzero(p != q)
                        rows += [(r, True, np.array([i])) for i in off for r in range(min(p[i], q[i]), max(p[i], q[i]) + 1) if r != p[i]]
                        rows += [(-1, False, off)] * bool(len(off))
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows), pa.int32()), pa.array([r for r, *_ in rows], pa.int32()), pa.array([e for _, e, _ in rows]), *[pa.array([v[at].tobytes() for *_, at in rows], pa.binary()) for v in (x, y)]], ["k", "r", "extra", "xs", "ys"])

        def pairs(k: int, extra: np.ndarray, x: np.ndarray, y: np.ndarray, driver: bool = False) -> tuple[np.ndarray, np.ndarray]:
            i, j = crossing(x, y, *bounds[k])
            p, q = sides(x, y, k)
            here = (p[i] != p[j]) if driver else ~extra[i] & ~extra[j] | (extra[i] & ~extra[j] & (p[j] == q[j])) | (extra[j] & ~extra[i] & (p[i] == q[i]))
            i, j = i[here], j[here]
            return np.unique((y[j] - y[i]) / (x[j] - x[i]) + 0.0, return_counts=True)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (r for batch in batches for r in zip(*[batch.column(c).to_pylist() for c in range(5)]))
            for (k, r), of in groupby(rows, lambda row: row[:2]):
                extra, x, y = zip(*[(np.full(len(xs) // 8, e), np.frombuffer(xs, np.float64), np.frombuffer(ys, np.float64)) for _, _, e, xs, ys in of])
                extra, x, y = (np.concatenate(v) for v in (extra, x, y))
                slope, n = pairs(k, extra, x, y, r < 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slope), k)), pa.array(slope), pa.array(n)], ["k", "slope", "n"])

        dealt = self.blocks.mapInArrow(deal, "k int, r int, extra boolean, xs binary, ys binary").repartition(self.tasks, "k", "r").sortWithinPartitions("k", "r")
        found = dealt.mapInArrow(work, "k long, slope double, n long").groupBy("k", "slope").agg(F.sum("n").alias("n")).collect()  # LEAF_PAIRS rows at most
        out: list[list[Cell]] = [[] for _ in cells]
        before = [c.before for c in cells]
        for r in sorted(found, key=lambda r: (r["k"], r["slope"])):
            out[r["k"]].append(Cell(r["slope"], r["slope"], r["n"], before[r["k"]]))
            before[r["k"]] += r["n"]
        return out

    def _within(self, c: Cell) -> np.ndarray:
        return self.seen[np.searchsorted(self.seen, c.low, "right") : np.searchsorted(self.seen, c.high, "right")]

    def _cuts(self, c: Cell, most: int) -> list[float]:
        """Thresholds within a cell: about the ranks that are sought there, on both sides of values that many seen slopes have, and so that the doubles between are halved in any case."""
        here, cuts = self._within(c), []
        shares = [(p - c.before + 0.5) / c.count for p in sorted(c.sought)]
        shares = [s for i, s in enumerate(shares) if not i or s - shares[i - 1] > ASIDE[-1]]
        for s in shares[: max(1, most // 4)]:
            for f in (s, *(s + d * sign for d in ASIDE[: max(1, most // (4 * len(shares)))] for sign in (1, -1))):
                f = min(max(f, 0.0), 1.0)
                cuts.append(here[min(int(f * len(here)), len(here) - 1)] if 50 * len(here) > len(self.seen) else c.low + (c.high - c.low) * f)
            if len(here):
                v = here[min(int(s * len(here)), len(here) - 1)]
                if np.searchsorted(here, v, "right") - np.searchsorted(here, v) >= 3:
                    cuts += [v - 0.4 * NEAR * abs(v), v + 0.4 * NEAR * abs(v)]
        cuts += thresholds(c.low, c.high, max(2, most - len(cuts))).tolist()
        cuts = sorted({float(t) for t in cuts if c.low < t < c.high and t})
        return sorted([*cuts, *([-0.0, 0.0] if c.low < 0 < c.high else [])], key=lambda t: (t, math.copysign(1, t)))

    def narrowed(self, asked: list[Cell]) -> list[list[Cell]]:
        """The cells within each asked one: cut at thresholds, or single slopes where few pairs are left or none can be told apart."""
        most = max(FEWEST, min(THRESHOLDS, DEALT // max(self.n, 1)))
        inner = [self._cuts(c, max(2, most // len(asked))) for c in asked]
        single = [c.high - c.low <= NEAR * max(abs(c.low), abs(c.high)) or not t for c, t in zip(asked, inner)]
        few = sum(c.count for c in asked) <= LEAF_PAIRS
        out: list[list[Cell]] = [[] for _ in asked]
        leaf = [i for i, c in enumerate(asked) if few or single[i] and c.count <= LEAF_PAIRS]
        if leaf:
            for i, cells in zip(leaf, self._listed([asked[i] for i in leaf])):
                out[i] = cells
        for i, c in enumerate(asked):
            if single[i] and i not in leaf:
                here = self._within(c)
                v = float(here[len(here) // 2]) if len(here) else c.high
                out[i] = [Cell(v, v, c.count, c.before)]
        cut = [i for i in range(len(asked)) if i not in leaf and not single[i]]
        counts = iter(self._counted([t for i in cut for t in inner[i]]).tolist() if cut else [])
        for i in cut:
            c = asked[i]
            ends, reached = [c.low, *inner[i], c.high], [c.before, *[next(counts) for _ in inner[i]], c.before + c.count]
            out[i] = [Cell(0.0, 0.0, n - m, m) if a == b else Cell(a, b, n - m, m, True) for a, b, m, n in zip(ends, ends[1:], reached, reached[1:]) if a < b or n > m]
        return out

    def whole(self, bounds: tuple[float, float] | None = None) -> Cell:
        """A cell of all slopes, or of those between bounds."""
        if bounds is None:
            return Cell(-self.top, self.top, self.total, 0, True)
        low, high = self._counted(bounds)
        return Cell(*map(float, bounds), int(high - low), int(low), True)

    def ask(self, order: Callable[[list[Cell]], Asking], bounds: tuple[float, float] | None = None) -> object:
        """What a generator of cells returns (see ranks)."""
        whole = self.whole(bounds)
        asking, send = order([whole] if whole.count or bounds else []), None
        while True:
            try:
                cells = asking.send(send)
            except StopIteration as e:
                return e.value
            send = self.narrowed(cells)

