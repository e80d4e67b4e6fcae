"""Exact aggregates with their sensitivities. They are lazy: nothing runs, and nothing may leave, before a mechanism."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions import columns as C
from hushframe.operators import matchings
from hushframe.operators import noise as N
from hushframe.operators import preprocess as P
from hushframe.operators import ranks as R
from hushframe.operators import sensitivity as S
from hushframe.operators.slopes import Slopes
from hushframe.operators.structure import union_rows
from hushframe.plans.frame import Aggregate, Order, PrivateFrame, Props
from hushframe.plans.shared import written
from hushframe.privacy import PrivacyError, Usage, common, composed

#: Rows of a block of which all pairs are formed (fewer than a merge join keeps as objects), and tasks for pairs of blocks at most.
PAIR_ROWS, PAIR_TASKS = 3_500, 2_000
#: Categories or candidates up to which each is a column of the fused aggregation; more are counted as groups.
WIDE = 64


#: From a column's name to the column.
Named = Callable[[str], Column]


def _numbers(values: list) -> list:
    return [float("nan") if v is None else v for v in values]


def _aggregate(frame: PrivateFrame, name: str, exprs: Callable[[Named], list[Column]], sensitivities, columns: Sequence[str] = (), **more) -> Aggregate:
    """exprs: of a function from a column's name to the column, as the planner may have named it anew."""
    return Aggregate(frame, name, exprs, more.pop("finish", _numbers), sensitivities, columns=tuple(columns), **more)


def _none(_: Named) -> list[Column]:
    return []


def count(frame: PrivateFrame, columns=None, distinct: bool = False) -> Aggregate:
    """Rows, or distinct values of each column."""
    nb, n = frame.definition.neighboring, frame.n
    if not distinct:
        return _aggregate(frame, "count", lambda c: [F.count(F.lit(1))], lambda _: [S.count(n, nb)], kind="int", finish=lambda v: [v[0] or 0], lower=[n or 0], upper=[n])
    names = P._names(frame, columns)
    return _aggregate(frame, "count", lambda c: [F.count_distinct(c(n)) for n in names], lambda _: [S.count(n, nb, True)] * len(names), names, kind="int", finish=lambda v: [x or 0 for x in v], lower=[0] * len(names), upper=[n] * len(names))


def sum_(frame: PrivateFrame, columns=None) -> Aggregate:
    names = P._names(frame, columns)
    props = frame.numeric(names, "sum")
    kind = "int" if all(p.kind == "int" for p in props) else "float"
    scale = lambda e: [None if frame.n is None or p.lower is None or p.upper is None else frame.n * getattr(p, e) for p in props]
    wide = kind == "int" and frame.definition.protect_overflow
    return _aggregate(frame, "sum", lambda c: [F.coalesce(F.sum(c(n).cast("decimal(38,0)") if wide else c(n)), F.lit(0)) for n in names], lambda _: [S.total(p.bounds, frame.definition.neighboring) for p in props], names, kind=kind, lower=scale("lower"), upper=scale("upper"), finish=lambda v: [int(x or 0) if wide else x or 0 for x in v])


def mean(frame: PrivateFrame, columns=None) -> Aggregate:
    names = P._names(frame, columns)
    props = frame.numeric(names, "mean", empty=False)
    if any(p.kind != "float" for p in props):
        raise PrivacyError("mean takes floats")
    return _aggregate(frame, "mean", lambda c: [F.avg(c(n)) for n in names], lambda _: [S.mean(p.bounds, frame.n, frame.definition.neighboring) for p in props], names, lower=[p.lower for p in props], upper=[p.upper for p in props])


def variance(frame: PrivateFrame, columns=None, finite_sample_correction: bool = True) -> Aggregate:
    names, ddof = P._names(frame, columns), int(finite_sample_correction)
    props = frame.numeric(names, "variance", empty=False)
    f = F.var_samp if ddof else F.var_pop
    top = lambda p: None if p.lower is None or p.upper is None else (p.upper - p.lower) ** 2 / 4 * (frame.n / (frame.n - ddof) if frame.n and frame.n > ddof else 1)
    return _aggregate(frame, "variance", lambda c: [f(c(n)) for n in names], lambda _: [S.variance(p.bounds, frame.n, frame.definition.neighboring, ddof) for p in props], names, lower=[0.0] * len(names), upper=[top(p) for p in props])


def covariance(frame: PrivateFrame, columns=None, left=None, right=None, finite_sample_correction: bool = True) -> Aggregate:
    """The upper triangle of a covariance matrix, row by row, or all pairs of left and right columns."""
    if left is not None and right is not None:
        pairs = [(a, b) for a in P._names(frame, left) for b in P._names(frame, right)]
    else:
        pairs = list(combinations_with_replacement(P._names(frame, columns), 2))
    frame.numeric(sorted({c for p in pairs for c in p}), "covariance", empty=False)
    ddof = int(finite_sample_correction)
    f = F.covar_samp if ddof else F.covar_pop
    bounds = lambda c: frame.of(c).bounds
    return _aggregate(frame, "covariance", lambda c: [f(c(a), c(b)) for a, b in pairs], lambda _: [S.covariance(bounds(a), bounds(b), frame.n, frame.definition.neighboring, ddof) for a, b in pairs], [f"{a},{b}" for a, b in pairs])


def raw_moment(frame: PrivateFrame, columns=None, order: int = 1) -> Aggregate:
    names = P._names(frame, columns)
    props = frame.numeric(names, "raw_moment", empty=False)
    if order < 1:
        raise PrivacyError("the order is 1 or more")
    return _aggregate(frame, "raw_moment", lambda c: [F.avg(F.pow(c(n).cast("double"), F.lit(order))) for n in names], lambda _: [S.raw_moment(p.bounds, order, frame.n, frame.definition.neighboring) for p in props], names)


# ---------------------------------------------------------------- order statistics


def ranks(n: int, alpha: float, interpolation: str) -> list[tuple[int, float]]:
    """(place from 0, weight) of the values that an alpha-quantile of n values mixes."""
    at = (n - 1) * alpha
    low, high = math.floor(at), math.ceil(at)
    if interpolation == "lower":
        return [(low, 1.0)]
    if interpolation == "upper":
        return [(high, 1.0)]
    if interpolation == "nearest":
        return [(math.floor(at + 0.5), 1.0)]
    if interpolation == "midpoint":
        return [(low, 0.5), (high, 0.5)]
    if interpolation == "linear":
        return [(low, 1 - (at - low)), (high, at - low)]
    raise PrivacyError(f"unknown interpolation {interpolation}")


def _bounds(p: Props) -> tuple[float, float] | None:
    return None if p.lower is None or p.upper is None else (float(p.lower), float(p.upper))


def _quantile_of(alpha: float, interpolation: str):
    """Asks for the values that an alpha-quantile mixes; returns it, or NaN without values."""

    def look(first: list[R.Cell]) -> R.Asking:
        n, found = yield from R.at_places(first, lambda n: [p for p, _ in ranks(n, alpha, interpolation)])
        return math.fsum(found[p] * q for p, q in ranks(n, alpha, interpolation) if q) if n else float("nan")

    return look


def quantile(frame: PrivateFrame, columns=None, alpha: float = 0.5, interpolation: str = "midpoint", candidates: Sequence | None = None, missing: str = "refuse") -> Aggregate:
    """The alpha-quantile of each column, exactly; or, with candidates (one list for all columns, or one for each), the utility of each of them, column by column.

    missing, for utilities: "refuse" columns that may have missing values, or take them as an "interval" of rows of unknown place.
    """
    names = P._names(frame, columns)
    if not 0 <= alpha <= 1:
        raise PrivacyError("alpha lies between 0 and 1")
    if missing not in ("refuse", "interval"):
        raise PrivacyError(f"unknown treatment of missing values: {missing}")
    if candidates is not None:
        each = [list(c) for c in candidates] if candidates and isinstance(candidates[0], (list, tuple)) else [list(candidates)] * len(names)
        if len(each) != len(names) or not all(each):
            raise PrivacyError(f"{len(names)} columns need one list of candidates or {len(names)}")
        return quantile_utilities(frame, names, each, alpha, missing == "interval")
    if missing != "refuse":
        raise PrivacyError("only utilities of candidates can be told of missing values")
    props = frame.numeric(names, "quantile", empty=False)
    ranks(1, alpha, interpolation)
    orders = tuple(Order(n, _bounds(p), _quantile_of(alpha, interpolation)) for n, p in zip(names, props))
    return _aggregate(frame, "quantile", _none, lambda _: [S.quantile(p.bounds) for p in props], names, finish=list, orders=orders, lower=[p.lower for p in props], upper=[p.upper for p in props])


def quantile_utilities(frame: PrivateFrame, names: list[str], candidates: list[list[float]], alpha: float, robust: bool = False) -> Aggregate:
    """n * max(a, 1 - a) - |(1 - a) * below - a * above| for each candidate of each column, one column after the other.

    robust: rows without a value may lie anywhere, so the distance is the largest that any place of them makes; one more row,
    wherever it is, moves that as little as without missing rows. A few candidates are conditional sums in the fused
    aggregation; of many, rows are counted by their place among the sorted candidates, and running sums on the driver give
    what is below and above each.
    """
    frame.numeric(names, "quantile", null=robust)

    def worst(n: int, missing: int, below: int, above: int) -> float:
        far = lambda left, right: abs((1 - alpha) * left - alpha * right)
        return n * max(alpha, 1 - alpha) - max(far(below + missing, above), far(below, above + missing))

    def exprs(c: Named) -> list[Column]:
        out = [F.count(F.lit(1))]
        for name, own in zip(names, candidates):
            x = c(name)
            out.append(F.count(F.when(x.isNotNull() & ~F.isnan(x.cast("double")), F.lit(1))))  # NaN is greater than any number for Spark
            out += [e for v in own for e in (F.sum((x < F.lit(v)).cast("long")), F.sum(((x > F.lit(v)) & ~F.isnan(x.cast("double"))).cast("long")))]
        return out

    def finish(v: list) -> list[float]:
        v, out = [x or 0 for x in v], []
        at = 1
        for own in candidates:
            some, at = v[at], at + 1
            out += [worst(v[0], v[0] - some, v[at + 2 * i], v[at + 2 * i + 1]) for i in range(len(own))]
            at += 2 * len(own)
        return out

    def finish_counts(found: list[dict]) -> list[float]:
        out = []
        for own, counts in zip(candidates, found):
            edges, before = sorted(set(own)), [0]
            for i in range(2 * len(edges) + 1):  # 2 j: between edges j - 1 and j; 2 j + 1: on edge j
                before.append(before[-1] + counts.get(str(i), 0))
            missing = counts.get(None, 0)
            at = {e: (before[2 * j + 1], before[-1] - before[2 * j + 2]) for j, e in enumerate(edges)}
            out += [worst(before[-1] + missing, missing, *at[x]) for x in own]
        return out

    many = sum(map(len, candidates)) > WIDE
    place = lambda name, own: lambda c: C.place_among(c(name), sorted(set(own)))
    more = {"grouped": tuple(place(n, own) for n, own in zip(names, candidates)), "finish": finish_counts} if many else {"finish": finish}
    sensitivity = S.quantile_utility(alpha, frame.definition.neighboring)
    return _aggregate(frame, "quantile_utilities", _none if many else exprs, lambda _: [sensitivity] * len(names), names, candidates=tuple(map(tuple, candidates)), **more)


def minimum(frame: PrivateFrame, columns=None, candidates=None) -> Aggregate:
    return _extreme(frame, columns, F.min, 0.0, candidates, "minimum")


def maximum(frame: PrivateFrame, columns=None, candidates=None) -> Aggregate:
    return _extreme(frame, columns, F.max, 1.0, candidates, "maximum")


def _extreme(frame: PrivateFrame, columns, f, alpha: float, candidates, name: str) -> Aggregate:
    if candidates is not None:
        return quantile(frame, columns, alpha, candidates=candidates)
    names = P._names(frame, columns)
    props = frame.numeric(names, name, empty=False)
    return _aggregate(frame, name, lambda c: [f(c(n)) for n in names], lambda _: [S.quantile(p.bounds) for p in props], names, lower=[p.lower for p in props], upper=[p.upper for p in props])


def median(frame: PrivateFrame, columns=None, candidates=None) -> Aggregate:
    return quantile(frame, columns, 0.5, "midpoint", candidates)


def histogram(frame: PrivateFrame, column: str, edges=None, categories=None, null_value=None, inclusive_left: bool = True) -> Aggregate:
    """Counts of each category, in their order, empty ones too: a conditional count a category in the fused aggregation, or a group each if they are many."""
    if edges is not None:
        frame = P.digitize(frame, column, edges, -1 if null_value is None else null_value, inclusive_left)
    elif categories is not None:
        frame = P.clamp(frame, column, categories=categories, null_value=null_value)
    cats = frame.of(column).categories
    if cats is None:
        raise PrivacyError("a histogram needs edges or categories")
    many = len(cats) > WIDE
    if many:
        text = {str(c).lower() if isinstance(c, bool) else str(c): c for c in cats}  # as Spark writes them
        more = {"grouped": (lambda c: c(column),), "finish": lambda v: [{text.get(k): n for k, n in v[0].items()}.get(x, 0) for x in cats]}
    else:
        more = {"finish": lambda v: [x or 0 for x in v]}
    exprs = _none if many else lambda c: [F.count(F.when(c(column) == F.lit(x), F.lit(1))) for x in cats]
    return _aggregate(frame, "histogram", exprs, lambda norm: [S.histogram(len(cats), frame.n, frame.definition.neighboring, norm)] * len(cats), [column], kind="int", lower=[0] * len(cats), upper=[frame.n] * len(cats), candidates=cats, joint=True, **more)


def union(*some: Aggregate | PrivateFrame, flatten: bool = True) -> Aggregate | PrivateFrame | dict:
    """Rows of frames; or aggregates of several row sets as one, its values one after the other, for one mechanism over all.

    Sensitivities are stacked. An individual may move the aggregates of the same part, of what holds it and of unrelated rows,
    but of the parts of one partition only one: how many at most is the factor by which mechanisms divide their budget.
    """
    if not any(isinstance(x, Aggregate) for x in some):
        return union_rows(*some, flatten=flatten)
    if not all(isinstance(x, Aggregate) for x in some) or any(a.frame.keys for a in some):
        raise PrivacyError("a union takes frames, or aggregates without keys")
    if not flatten:
        return dict(enumerate(some))
    if any(a.candidates is not None and not a.joint for a in some) or len({a.kind for a in some}) > 1 or len({a.frame.definition for a in some}) > 1:
        raise PrivacyError("aggregates to be united are of one kind and definition, and no utilities")
    first = some[0].frame
    frame = first.new_rows(first.df, n=None, keys=(), path=common(a.frame.reach for a in some), public=all(a.frame.public for a in some))
    stacked = lambda ends: None if any(e is None for e in ends) else [x for e in ends for x in e]
    return Aggregate(
        frame, "union", _none, list, lambda norm: [s for a in some for s in a.sensitivity(norm)], kind=some[0].kind, lower=stacked([a.lower for a in some]), upper=stacked([a.upper for a in some]),
        columns=tuple(f"{a.name}{i}" for i, a in enumerate(some) for _ in range(a.width)), parts=tuple(some),
    )


def met(parts: Sequence[Aggregate]) -> int:
    """How many of some aggregates' row sets hold rows of one individual, at most."""
    return round(composed((a.frame.reach, Usage(1.0)) for a in parts).epsilon)


# ---------------------------------------------------------------- Theil-Sen


def _line(pairs: DataFrame) -> DataFrame:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    slope = C.divide(dy, dx)
    return pairs.select(slope.alias("slope"), ((F.col("y1") + F.col("y2")) / 2 - slope * (F.col("x1") + F.col("x2")) / 2).alias("intercept"))


def _all_pairs(rows: DataFrame, n: int) -> DataFrame:
    """Each pair of n rows once: rows are dealt to blocks of about PAIR_ROWS, and a pair of blocks is a key of a join, which no task needs more of at once."""
    blocks = max(1, -(-n // PAIR_ROWS))
    tasks = min(blocks * (blocks + 1) // 2, PAIR_TASKS)
    numbered = written(rows.withColumn("i", F.monotonically_increasing_id()), "numbered").withColumn("b", F.pmod(F.xxhash64("i"), F.lit(blocks)))
    last = F.lit(blocks - 1).cast("long")
    one = numbered.select(*[F.col(c).alias(f"{c}1") for c in ("x", "y", "i")], F.col("b").alias("p"), F.explode(F.sequence(F.col("b"), last)).alias("q"))
    two = numbered.select(*[F.col(c).alias(f"{c}2") for c in ("x", "y", "i")], F.col("b").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("b"))).alias("p"))
    return one.repartition(tasks, "p", "q").join(two.repartition(tasks, "p", "q"), ["p", "q"]).where((F.col("p") < F.col("q")) | (F.col("i1") < F.col("i2")))


def theil_sen(frame: PrivateFrame, data_x: str, data_y: str, implementation: str = "theil-sen-k-match", k: int = 0, rng: N.Secure | None = None) -> PrivateFrame:
    """Slopes and intercepts of lines through pairs of rows: all pairs, or k rounds in which each row has one partner.

    Every round is a random matching, and no pair occurs twice (see matchings); of an odd number of rows, one is left out in
    each round. Needs at most as many rounds as a block has; over that, rounds are drawn again. The lines are made anew
    wherever the frame is read.
    """
    frame.numeric([data_x, data_y], "theil_sen")
    rows = frame.df.select(F.col(data_x).cast("double").alias("x"), F.col(data_y).cast("double").alias("y"))
    if implementation == "theil-sen":
        if frame.n is None:
            raise PrivacyError("all pairs need a known number of records; use theil-sen-k-match")
        lines, factor = _line(_all_pairs(rows, frame.n)), frame.n - 1
        if frame.definition.neighboring == "add_remove":
            lines = lines.where(~F.isnan("slope") & (F.abs("slope") != float("inf")))
    elif implementation in ("theil-sen-k-match", "theil-sen-match"):
        k, rng = 1 if implementation == "theil-sen-match" else k or 100, rng or N.Secure()
        lines, factor = matchings.lines(rows, rows.count(), k, rng, frame.definition.neighboring == "add_remove"), k
    else:
        raise PrivacyError(f"unknown implementation {implementation}")
    return frame.new_rows(lines, props={"slope": Props("float", False), "intercept": Props("float", False)}, n=None, stability=frame.stability * factor)


def theil_sen_slope(frame: PrivateFrame, data_x: str, data_y: str, alpha: float = 0.5, interpolation: str = "midpoint") -> Aggregate:
    """A quantile of the slopes of the lines through all pairs of rows, without forming the pairs (see slopes). It has no bounded sensitivity; dp_linear_regression draws slopes privately."""
    frame.numeric([data_x, data_y], "theil_sen_slope")
    ranks(1, alpha, interpolation)

    def direct() -> dict:
        if frame.keys:
            raise PrivacyError("theil_sen_slope takes rows that are not parted")
        return {(): [Slopes(frame.df, F.col(data_x), F.col(data_y)).ask(_quantile_of(alpha, interpolation))]}

    def unbounded(_: int) -> list[float]:
        raise PrivacyError("the median slope has no bounded sensitivity")

    return _aggregate(frame, "theil_sen_slope", _none, unbounded, [data_x, data_y], direct=direct, lower=[None], upper=[None])
