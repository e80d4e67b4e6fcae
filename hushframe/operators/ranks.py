"""Order statistics without a sort of all rows: ranges of values are counted, and only the ranges that matter are narrowed.

A cell is a range of values: its least and greatest value, its rows, and the rows before it. One aggregation cuts cells into
equal widths and returns the counts and extremes of what is in them, so ties never fill a task (they are one counted
value) and the driver sees a bounded number of cells. A few rounds reach any rank.

Whoever asks is a generator that gets the cells of a column's values, hands out cells to be narrowed, and returns. All that
ask of one row set (several columns, keys, ranks and mechanisms) go on in the same rounds, so their number doesn't grow with
the number of statistics; where a column's bounds are known, its first round already cuts between them.
"""

from __future__ import annotations

import math
import weakref
from collections.abc import Callable, Generator, Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.operators.noise import Secure

#: Cells that one round returns at most, and those of one cell that is cut; rows of cells up to which their values are returned instead.
ROUND_CELLS, KEY_CELLS, LEAF_ROWS = 65_536, 4096, 20_000
#: Asked cells up to which they are literals of the plan; more are a broadcast table (of ROUND_CELLS rows at most).
LITERALS = 64
LARGEST = math.nextafter(math.inf, 0)
Bounds = tuple[float, float] | None


@dataclass(frozen=True)
class Cell:
    """Values low .. high: rows of them, and rows below them. Both ends occur, unless edges says that they are where the cell was cut. sought: places that the one who asks looks for."""

    low: float
    high: float
    count: int
    before: int
    edges: bool = False
    sought: tuple[int, ...] = field(default=(), compare=False)


Asking = Generator[list[Cell], list[list[Cell]], object]


def _finite(x: Column, bounds: Bounds) -> Column:
    low, high = bounds or (-LARGEST, LARGEST)
    return F.when(~F.isnan(x), F.least(F.greatest(x.cast("double"), F.lit(float(low))), F.lit(float(high))))


def _width(low: float, high: float) -> tuple[float, float]:
    """A factor that keeps the difference finite, and the difference."""
    half = 0.5 if math.isinf(high - low) else 1.0
    return half, high * half - low * half


class _Values:
    """Values of columns as rows (keys, number of the column, value), without missing ones."""

    def __init__(self, df: DataFrame, columns: Sequence[tuple[Column, Bounds]], keys: Sequence[str]):
        self.keys = [*keys, "__c"]
        pairs = [F.struct(F.lit(j).alias("__c"), _finite(x, b).alias("__x")) for j, (x, b) in enumerate(columns)]
        one = df.select(*[F.col(f"`{k}`") for k in keys], (F.explode(F.array(*pairs)) if len(pairs) > 1 else pairs[0]).alias("__v"))
        self.df = one.select(*[F.col(f"`{k}`") for k in keys], "__v.__c", "__v.__x").where(F.col("__x").isNotNull())

    def first(self, which: Iterable[int]) -> dict[tuple, Cell]:
        """A cell of all values of some columns, for each key that has one."""
        some = self.df.where(F.col("__c").isin(list(which))).groupBy(*self.keys).agg(F.min("__x").alias("low"), F.max("__x").alias("high"), F.count(F.lit(1)).alias("n")).collect()
        return {tuple(r[k] for k in self.keys): Cell(r["low"], r["high"], r["n"], 0) for r in some}

    def narrowed(self, asked: list[tuple[tuple, Cell]]) -> list[list[Cell]]:
        """The cells within each asked one, in order; single values where few rows are asked for. Cells of one key are disjoint."""
        most = ROUND_CELLS // 4
        return [c for at in range(0, len(asked), most) for c in self._narrowed(asked[at : at + most])]

    def _narrowed(self, asked: list[tuple[tuple, Cell]]) -> list[list[Cell]]:
        leaf = sum(c.count for _, c in asked) <= LEAF_ROWS
        pieces = max(2, min(KEY_CELLS, ROUND_CELLS // len(asked)))
        out: list[list[Cell]] = [[] for _ in asked]
        before = [c.before for _, c in asked]
        for i, low, high, n in sorted(self._found(asked, leaf, pieces), key=lambda r: (r[0], r[1])):
            out[i].append(Cell(low, high, n, before[i]))
            before[i] += n
        return out

    def _found(self, asked: list[tuple[tuple, Cell]], leaf: bool, pieces: int) -> list[tuple[int, float, float, int]]:
        """Number of the asked cell, least and greatest value, and rows, of each piece of it that has any (leaf: of each value)."""
        names, x = ("__i", "__low", "__half", "__width", "__high"), F.col("__x")
        rows = [(i, c.low, *_width(c.low, c.high), c.high) for i, (_, c) in enumerate(asked)]
        if len(asked) <= LITERALS:
            same = lambda key: reduce(and_, [F.col(f"`{k}`") == F.lit(v) for k, v in zip(self.keys, key)])
            which = F.coalesce(*[F.when(same(key) & x.between(r[1], r[4]), F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)])) for r, (key, _) in zip(rows, asked)])
            seen = self.df.select("__x", which.alias("c")).where(F.col("c").isNotNull()).select("__x", "c.*")
        else:
            types = dict(self.df.dtypes)
            schema = "__i int, __low double, __half double, __width double, __high double, " + ", ".join(f"`{k}` {types[k]}" for k in self.keys)
            table = self.df.sparkSession.createDataFrame([(*r, *key) for r, (key, _) in zip(rows, asked)], schema)
            seen = self.df.join(F.broadcast(table), self.keys).where(x.between(F.col("__low"), F.col("__high")))
        part = F.when(F.col("__width") > 0, F.least(F.floor((x * F.col("__half") - F.col("__low") * F.col("__half")) / F.col("__width") * pieces), F.lit(pieces - 1))).otherwise(0)
        found = seen.groupBy("__i", (x if leaf else part).alias("__part")).agg(F.min("__x").alias("low"), F.max("__x").alias("high"), F.count(F.lit(1)).alias("n")).collect()
        return [(r["__i"], r["low"], r["high"], r["n"]) for r in found]


#: For tables whose values are counted where they are made: a function of columns that returns what _Values does.
SOURCES: weakref.WeakKeyDictionary[DataFrame, Callable[[Sequence[tuple[str, Bounds]]], _Values]] = weakref.WeakKeyDictionary()


def ask(df: DataFrame, columns: Sequence[tuple[Column | str, Bounds]], keys: Sequence[str], every: Sequence[tuple], orders: Sequence[tuple[int, Callable[[list[Cell]], Asking]]]) -> list[dict[tuple, object]]:
    """What each order (number of a column, generator) returns for each key of every; all in the same rounds."""
    named = not keys and all(isinstance(x, str) for x, _ in columns)
    values = SOURCES[df](columns) if named and df in SOURCES else _Values(df, [(F.col(f"`{x}`") if isinstance(x, str) else x, b) for x, b in columns], keys)
    free = [j for j, (_, b) in enumerate(columns) if b is None]
    known = values.first(free) if free else {}
    whole = {(*key, j): Cell(*map(float, b), LEAF_ROWS + 1, 0) if b else known.get((*key, j)) for key in every for j, (_, b) in enumerate(columns)}
    begin = {at: c for at, c in whole.items() if c is not None}
    first = dict(zip(begin, values.narrowed(list(begin.items())))) if begin else {}
    out: list[dict[tuple, object]] = [{} for _ in orders]
    running: dict[tuple[int, tuple], Asking] = {}
    asked: dict[tuple[int, tuple], list[Cell]] = {}

    def step(at: tuple[int, tuple], send: list[list[Cell]] | None) -> None:
        try:
            asked[at] = running[at].send(send)
        except StopIteration as e:
            out[at[0]][at[1]] = e.value

    for i, (j, order) in enumerate(orders):
        for key in every:
            running[i, key] = order(first.get((*key, j), []))
            step((i, key), None)
    while asked:
        now, asked = asked, {}
        cells = list(dict.fromkeys(((*key, orders[i][0]), c) for (i, key), cs in now.items() for c in cs))
        answer = dict(zip(cells, values.narrowed(cells)))
        for (i, key), cs in now.items():
            step((i, key), [answer[(*key, orders[i][0]), c] for c in cs])
    return out


def at_places(first: list[Cell], places: Callable[[int], list[int]]) -> Asking:
    """The values at some places (from 0; a function of the number of values), by place."""
    found: dict[int, float] = {}

    def look(cells: list[Cell], wanted: list[int]) -> list[tuple[Cell, list[int]]]:
        left = []
        for c in cells:
            here = [p for p in wanted if c.before <= p < c.before + c.count]
            if here and c.low == c.high:
                found.update(dict.fromkeys(here, math.copysign(math.inf, c.low) if abs(c.low) == LARGEST else c.low))
            elif here:
                left.append((c, here))
        return left

    n = sum(c.count for c in first)
    todo = look(first, sorted(set(places(n)))) if n else []
    while todo:
        parts = yield [replace(c, sought=tuple(here)) for c, here in todo]
        todo = [x for (_, wanted), cells in zip(todo, parts) for x in look(cells, wanted)]
    return n, found


# ---------------------------------------------------------------- the exponential mechanism over gaps

#: Cells that a draw narrows at once, and how much less likely (as a logarithm) than the picked one the others may be.
AT_ONCE, LIKELY = 32, 12.0


@dataclass
class _Gap:
    low: float
    high: float
    weight: float  # logarithm


@dataclass
class _Open:
    cell: Cell
    weight: float  # a bound on the logarithm of the sum of its gaps' weights


class _Node:
    """A narrowed cell: what is in it."""

    def __init__(self, entries: list):
        self.entries = entries

    @property
    def weight(self) -> float:
        top = max(e.weight for e in self.entries)
        return top + math.log(math.fsum(math.exp(e.weight - top) for e in self.entries))


def _pick(entries: list, rng: Secure) -> tuple[int, float]:
    """One of the entries by weight, and the logarithm of all their weights."""
    weights = [e.weight for e in entries]
    top = max(weights)
    shares = [math.exp(w - top) for w in weights]
    total = math.fsum(shares)
    u, reached = rng.uniform() * total, 0.0
    for i, s in enumerate(shares):
        reached += s
        if u < reached:
            return i, top + math.log(total)
    return max(i for i, s in enumerate(shares) if s), top + math.log(total)


def drawn_gap(first: list[Cell], lower: float, upper: float, epsilon: float, rng: Secure, n: int | None = None, at_once: int = AT_ONCE) -> Asking:
    """A gap between sorted values, with probability in proportion to its length times exp(-epsilon / 2 * |rank distance|).

    Cells stand for all their gaps by a bound on their weight. A cell that is picked is narrowed (the generator asks for
    it), and the draw goes on within it with the probability that the better bound leaves, or begins again; a gap is
    returned with exactly its own share of the weights, and what is narrowed stays so. All randomness is the driver's.
    """
    n = sum(c.count for c in first) if n is None else n
    m = n + 2

    def weight(length: float, i_low: int, i_high: int) -> float:
        middle = m / 2
        far = 0.0 if i_low <= middle <= i_high and m % 2 == 0 else min(abs(i_low - middle), abs(i_high - middle)) if not i_low <= middle <= i_high else 0.5
        return math.log(length) - epsilon / 2 * math.ceil(far) if length > 0 else -math.inf

    def entries(cells: list[Cell], previous: float, last: bool) -> list:
        out: list = []
        for c in cells:
            if c.edges:  # gaps are cut at the edges, which leaves the density as it is
                single = c.count == 0
                out.append(_Gap(c.low, c.high, weight(c.high - c.low, c.before + 1, c.before + 1)) if single else _Open(c, weight(c.high - c.low, c.before + 1, c.before + c.count + 1)))
                previous = c.high
                continue
            if c.low > previous:
                out.append(_Gap(previous, c.low, weight(c.low - previous, c.before + 1, c.before + 1)))
            if c.low < c.high:
                out.append(_Open(c, weight(c.high - c.low, c.before + 2, c.before + c.count)))
            previous = c.high
        if last and upper > previous:
            out.append(_Gap(previous, upper, weight(upper - previous, n + 1, n + 1)))
        return out

    def inside(cell: Cell, parts: list[Cell]) -> list:
        if not cell.edges or parts[0].edges:
            return entries(parts, parts[0].low, False)
        out = entries(parts, cell.low, False)  # values within a cell that was cut: the gaps to its edges are its own
        end = parts[-1].high
        return out + [_Gap(end, cell.high, weight(cell.high - end, cell.before + cell.count + 1, cell.before + cell.count + 1))] * (cell.high > end)

    tree = entries(first, lower, True)
    while True:
        level, bound = tree, None
        while True:
            i, total = _pick(level, rng)
            if bound is not None and math.log(rng.uniform()) > total - bound:
                break  # begins again, with the better bounds
            if isinstance(level[i], _Gap):
                return level[i].low, level[i].high
            bound = None
            if isinstance(level[i], _Open):
                bound = level[i].weight
                others = sorted((j for j, e in enumerate(level) if isinstance(e, _Open) and j != i and e.weight > bound - LIKELY), key=lambda j: -level[j].weight)
                picked = [i, *others[: at_once - 1]]  # what may be picked next is narrowed in the same round; draws don't depend on it
                for j, parts in zip(picked, (yield [level[j].cell for j in picked])):
                    level[j] = _Node(inside(level[j].cell, parts))
            level = level[i].entries


#: Steps of the grid on which values are taken in constant time, and steps of rank from the median beyond which all gaps weigh alike there, at most.
GRID, REACH = 1 << 52, 8192


def constant_rounds(epsilon: float, everyone: int) -> tuple[int, int]:
    """Steps of rank that matter, and the rounds after the first: by what is public only."""
    reach = min(REACH, math.ceil(128 / epsilon))
    pieces = max(2, min(KEY_CELLS, ROUND_CELLS // min(ROUND_CELLS // 4, (2 * reach + 2) * everyone)))
    return reach, math.ceil((math.log2(GRID) - math.log2(KEY_CELLS if everyone * KEY_CELLS <= ROUND_CELLS else max(2, ROUND_CELLS // everyone))) / math.log2(pieces)) + 1


def constant_gap(first: list[Cell], lower: float, upper: float, epsilon: float, rng: Secure, everyone: int) -> Asking:
    """A gap as drawn_gap() draws it, but by a fixed number of rounds, cells and random bits, whatever the values are.

    Values are whole steps of a grid of GRID steps between the bounds. The rank distance counts up to a public number of
    ranks only (where a gap weighs e^-64 of the best one, if epsilon isn't tiny), so the gaps beyond need no narrowing: they
    weigh alike. The values at the ranks within are narrowed as often as the grid may need, also where they are found already.
    """
    reach, rounds = constant_rounds(epsilon, everyone)
    cells, n = list(first), sum(c.count for c in first)
    middle = (n + 2) / 2
    low_rank, high_rank = math.floor(middle) - reach, math.ceil(middle) + reach  # ranks of values, from 1
    for _ in range(rounds):
        wanted = [c for c in cells if c.low < c.high and c.before + c.count >= low_rank and c.before + 1 <= high_rank]
        parts = yield [*wanted, *[Cell(-2.0 - i, -1.5 - i, 0, 0) for i in range(2 * reach + 2 - len(wanted))]]
        found = dict(zip(wanted, parts))
        cells = [p for c in cells for p in found.get(c, [c])]
    step, regions, previous = (upper - lower) / GRID, [], 0.0
    for at in [*cells, Cell(float(GRID), float(GRID), 0, n)]:
        far = min(reach, math.ceil(abs(at.before + 1 - middle)))
        if at.low > previous:
            regions.append((previous, at.low, far))
        if at.high > at.low:  # beyond the reach, where ranks don't matter
            regions.append((at.low, at.high, reach))
        previous = at.high
    entries = [_Gap(a, b, math.log(b - a) - epsilon / 2 * far) for a, b, far in regions]
    chosen = entries[_pick(entries, rng)[0]]
    return lower + chosen.low * step, lower + chosen.high * step


def on_grid(x: Column, lower: float, upper: float) -> Column:
    """The step of constant_gap()'s grid that x is on."""
    inside = F.least(F.greatest(x.cast("double"), F.lit(float(lower))), F.lit(float(upper)))
    return F.when(~F.isnan(x), F.floor((inside - F.lit(float(lower))) / F.lit(float(upper - lower)) * F.lit(float(GRID))).cast("double"))
