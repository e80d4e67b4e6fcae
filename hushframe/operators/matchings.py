"""Lines through the pairs of random matchings, made anew from blocks of points wherever they are read.

Points are dealt at random into blocks, which are written once; a round pairs the points of each block, so it is a random
perfect matching of all points, and no join or table of pairs is needed: n points are on the disk, not k n / 2 lines. The
pairs of b points of a block fall into b - 1 (b, if b is odd) perfect matchings: points i and j meet in the round i + j modulo
that number. k different rounds are drawn, so no pair occurs twice. All blocks but the last one have the same even number of
points, so of an odd number of points one is left out in each round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.operators import ranks as R
from hushframe.operators.noise import Secure
from hushframe.plans.shared import written

#: Points of a block, of a task that deals them (about), and lines that are made at once (about).
BLOCK, TASK, AT_ONCE = 4096, 1 << 20, 1 << 14


def sample(n: int, k: int, rng: Secure) -> list[int]:
    """k different numbers below n, each set of them equally likely (Floyd's method)."""
    seen: set[int] = set()
    for top in range(n - k, n):
        x = rng.integer(0, top)
        seen.add(top if x in seen else x)
    return sorted(seen)


def _rounds(points: int, k: int, rng: Secure) -> list[int]:
    """k rounds of a block; different ones, if there are as many."""
    rounds = points - 1 + points % 2
    return sample(rounds, k, rng) if 0 < k <= rounds else [rng.integer(0, max(rounds, 1) - 1) for _ in range(k)]


def _partners(points: int, rounds: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the first and second points of all pairs, some rounds at a time."""
    modulus = points - 1 + points % 2
    i = np.arange(modulus, dtype=np.int32)
    step = max(1, AT_ONCE // max(points // 2, 1))
    for at in range(0, len(rounds), step):
        one, two = [], []
        for s in rounds[at : at + step]:
            met = (s - i) % max(modulus, 1)
            if points % 2 == 0:
                met = np.where(met == i, points - 1, met)  # the point that meets itself plays the last one
            one.append(i[i < met])
            two.append(met[i < met])
        yield np.concatenate(one), np.concatenate(two)


def _dealt(rows: DataFrame, n: int, size: int, seed: int) -> DataFrame:
    """Points (x, y) in random order, in blocks of size, and one of size or more (of all, if they are fewer)."""

    def cut(last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if last:
                parts = [np.stack([np.frombuffer(c, np.float64) for c in row]) for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            else:
                parts = [np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)]) for b in batches]
            if not parts or not sum(p.shape[1] for p in parts):
                return
            xy = np.concatenate(parts, axis=1)
            del parts
            xy = xy[:, np.random.default_rng([seed, last, TaskContext.get().partitionId()]).permutation(xy.shape[1])]
            full = max(0, xy.shape[1] // size - 1)  # what is left holds a block at least
            for at in range(full + 1):
                x, y = xy[:, at * size : (at + 1) * size if at < full else None]
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, y)] + [pa.array([len(x)]), pa.array([last or at < full])], ["xs", "ys", "n", "done"])

        return work

    schema, some = "xs binary, ys binary, n long, done boolean", rows.sparkSession.sparkContext.defaultParallelism * 2
    tasks = max(-(-n // TASK), min(some, n // (32 * size)), 1)
    first = written(rows.repartition(tasks, F.rand(seed)).mapInArrow(cut(False), schema), "dealt")
    rest = written(first.where(~F.col("done")).select("xs", "ys").coalesce(1).mapInArrow(cut(True), schema), "rest")
    return first.where("done").unionByName(rest).select("xs", "ys", "n")


class _Lines(R._Values):
    """Slopes and intercepts as the values that are narrowed: counted where they are made, so that no line leaves its task."""

    def __init__(self, blocks: DataFrame, lines: Callable[[bytes, bytes], Iterator[tuple[np.ndarray, np.ndarray]]], columns: Sequence[tuple[str, R.Bounds]]):
        self.keys, self.blocks, self.lines, self.columns = ["__c"], blocks, lines, list(columns)

    def _values(self) -> Callable[[pa.RecordBatch], Iterator[list[np.ndarray]]]:
        lines, columns = self.lines, [("slope", "intercept").index(c) for c, _ in self.columns]
        bounds = [b or (-R.LARGEST, R.LARGEST) for _, b in self.columns]

        def values(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
            for xs, ys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for line in lines(xs, ys):
                    yield [np.clip(v[~np.isnan(v)], *b) + 0.0 for v, b in ((line[c], b) for c, b in zip(columns, bounds))]

        return values

    def first(self, which) -> dict[tuple, R.Cell]:
        values, which = self._values(), list(which)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for v in values(batch):
                    some = [(j, v[j].min(), v[j].max(), len(v[j])) for j in which if len(v[j])]
                    yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in some], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.float64(), pa.int64()))], ["j", "low", "high", "n"])

        found = self.blocks.mapInArrow(work, "j int, low double, high double, n long").groupBy("j").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect()
        return {(r["j"],): R.Cell(r["low"], r["high"], r["n"], 0) for r in found}

    def _found(self, asked: list[tuple[tuple, R.Cell]], leaf: bool, pieces: int) -> list[tuple[int, float, float, int]]:
        values = self._values()
        of: dict[int, list[tuple]] = {}
        for i, ((j,), c) in enumerate(asked):
            of.setdefault(j, []).append((i, c.low, c.high, *R._width(c.low, c.high)))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = len(asked) * pieces
            count, least, most = np.zeros(size, np.int64), np.full(size, np.inf), np.full(size, -np.inf)
            singles: list[tuple[int, np.ndarray, np.ndarray]] = []
            for batch in batches:
                for made in values(batch):
                    for j, cells in of.items():
                        v = made[j]
                        v = np.sort(v[(v >= min(c[1] for c in cells)) & (v <= max(c[2] for c in cells))])
                        for i, low, high, half, width in cells:
                            x = v[np.searchsorted(v, low) : np.searchsorted(v, high, "right")]
                            if not len(x):
                                continue
                            if leaf:
                                singles.append((i, *np.unique(x, return_counts=True)))
                                continue
                            part = np.minimum((x * half - low * half) / width * pieces, pieces - 1).astype(np.int64) if width > 0 else np.zeros(len(x), np.int64)
                            begins = np.flatnonzero(np.insert(part[1:] != part[:-1], 0, True))
                            at, ends = i * pieces + part[begins], np.append(begins[1:], len(x))
                            count[at] += ends - begins
                            least[at] = np.minimum(least[at], x[begins])
                            most[at] = np.maximum(most[at], x[ends - 1])
            at = np.flatnonzero(count)
            out = [(at, least[at], most[at], count[at])] + [(np.full(len(x), i * pieces), x, x, n) for i, x, n in singles]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(4)], ["at", "low", "high", "n"])

        counted = self.blocks.mapInArrow(work, "at long, low double, high double, n long")
        found = counted.groupBy("at", *["low"] * leaf).agg(*[F.min("low").alias("least")] * (not leaf), F.max("high").alias("most"), F.sum("n").alias("n")).collect()
        return [(r["at"] // pieces, r["low" if leaf else "least"], r["most"], r["n"]) for r in found]


def lines(rows: DataFrame, n: int, k: int, rng: Secure, finite: bool) -> DataFrame:
    """Slope and intercept of the lines through the pairs of k random matchings of points (x, y); n: how many they are. finite: lines without a slope are left out."""
    size = max(BLOCK, 2 * (k + 1))
    blocks = _dealt(rows, n, size, rng.bits(62))
    largest = blocks.agg(F.max("n")).first()[0] or 0
    rounds = {p: _rounds(p, k, rng) for p in {size, largest}}

    def made(xs: bytes, ys: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x, y = np.frombuffer(xs, np.float64), np.frombuffer(ys, np.float64)
        if len(x) not in places:
            places[len(x)] = list(_partners(len(x), rounds[len(x)]))
        for i, j in places[len(x)]:
            x1, x2, y1, y2 = x[i], x[j], y[i], y[j]
            with np.errstate(all="ignore"):
                slope = (y2 - y1) / (x2 - x1)
                intercept = (y1 + y2) / 2 - slope * (x1 + x2) / 2
            if finite and not (good := np.isfinite(slope)).all():
                slope, intercept = slope[good], intercept[good]
            yield slope, intercept

    places: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}  # filled by each worker

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for xs, ys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for line in made(xs, ys):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in line], ["slope", "intercept"])

    points = blocks.select("xs", "ys")
    out = points.mapInArrow(table, "slope double, intercept double")
    R.SOURCES[out] = lambda columns: _Lines(points, made, columns)
    return out
