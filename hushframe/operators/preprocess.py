"""Row-wise preparation of private frames: casts, bounds, imputation, bins, arithmetic, and a forced number of rows."""

from __future__ import annotations

import math
import secrets
from collections.abc import Sequence
from dataclasses import replace
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions import columns as C
from hushframe.functions import intervals as I
from hushframe.operators import ranks as R
from hushframe.operators.noise import Secure, binomial
from hushframe.plans.frame import PrivateFrame, Props
from hushframe.plans.shared import written
from hushframe.privacy import SUBSTITUTE, Definition, PrivacyError

#: Edges of a digitized column.
MAX_EDGES = 10_000


def _names(frame: PrivateFrame, columns: Sequence[str] | str | None) -> list[str]:
    return list(frame.props) if columns is None else [columns] if isinstance(columns, str) else list(columns)


def _each(value, k: int) -> list:
    """One value for every column, or one for each."""
    if isinstance(value, (list, tuple)):
        if len(value) != k:
            raise PrivacyError(f"{k} columns need one value or {k}")
        return list(value)
    return [value] * k


def _set(frame: PrivateFrame, exprs: dict[str, Column], props: dict[str, Props]) -> PrivateFrame:
    return frame.derive(exprs, frame.props | props)


def _distinct(categories: Sequence) -> tuple:
    out = tuple(dict.fromkeys(categories))
    if any(isinstance(c, float) for c in out):
        raise PrivacyError("categories are never floats")
    return out


def clamp(frame: PrivateFrame, columns=None, lower=None, upper=None, categories=None, null_value=None) -> PrivateFrame:
    """Numbers within bounds (missing ones stay), or values among categories (others become null_value, which joins them). Tighter bounds that are known already are kept."""
    names, exprs, props = _names(frame, columns), {}, {}
    if categories is not None:
        cats = _distinct(categories)
        if null_value is None:
            raise PrivacyError("categories need a null_value")
        for n in names:
            exprs[n] = C.clamp_categories(F.col(n), cats, null_value)
            props[n] = replace(frame.of(n), categories=_distinct((*cats, null_value)), lower=None, upper=None, nullable=False)
        return _set(frame, exprs, props)
    for n, low, high in zip(names, _each(lower, len(names)), _each(upper, len(names))):
        p = frame.of(n)
        low = p.lower if low is None else low if p.lower is None else max(low, p.lower)
        high = p.upper if high is None else high if p.upper is None else min(high, p.upper)
        if p.kind not in ("float", "int") or low is None or high is None:
            raise PrivacyError(f"clamp: {n} needs to be numeric, and both bounds")
        low, high = (int(low), int(high)) if p.kind == "int" else (float(low), float(high))
        if not low < high:
            raise PrivacyError("lower must be below upper")
        exprs[n] = C.clamp(F.col(n), low, high)
        props[n] = replace(p, lower=low, upper=high)
    return _set(frame, exprs, props)


def _truncated(seed: int, low: float, high: float, shift: float, scale: float) -> Column:
    """Draws of a Gaussian between bounds, by inverse distribution function, in Column functions."""
    normal = NormalDist(shift, scale)
    a, b = normal.cdf(low), normal.cdf(high)
    u = F.lit(a) + F.lit(b - a) * F.rand(seed)
    z = C.inverse_normal(F.greatest(F.least(u, F.lit(1 - 1e-16)), F.lit(1e-300)))
    return F.least(F.greatest(F.lit(shift) + F.lit(scale) * z, F.lit(float(low))), F.lit(float(high)))


def impute(frame: PrivateFrame, columns=None, lower=None, upper=None, categories=None, null_values=None, weights=None, distribution: str = "uniform", shift=None, scale=None, seed: int | None = None) -> PrivateFrame:
    """Missing numbers become draws between the bounds, given or known (uniform, or Gaussian with shift and scale; whole numbers stay whole); members of null_values become a weighted draw of the categories. Bounds widen to those of the draws."""
    names, exprs, props = _names(frame, columns), {}, {}
    for i, n in enumerate(names):
        p, own = frame.of(n), secrets.randbits(62) if seed is None else seed + i
        if categories is not None:
            cats, x = _distinct(categories), F.col(n)
            exprs[n] = F.when(x.isin(list(null_values or [])) | x.isNull(), weighted(cats, weights, F.rand(own))).otherwise(x)
            kept = tuple(c for c in (p.categories or ()) if c not in (null_values or ()))
            props[n] = replace(p, categories=_distinct((*kept, *cats)) if p.categories else None, nullable=False)
            continue
        low = _each(lower, len(names))[i]
        high = _each(upper, len(names))[i]
        low, high = (p.lower if low is None else low), (p.upper if high is None else high)
        if p.kind not in _NUMBERS or low is None or high is None or not low < high:
            raise PrivacyError(f"impute: {n} needs to be numeric, and bounds in order")
        if p.kind == "int" and (low != int(low) or high != int(high)):
            raise PrivacyError(f"impute: {n} holds whole numbers, and so must its bounds be")
        if distribution == "gaussian":
            if shift is None or scale is None or scale <= 0:
                raise PrivacyError("a Gaussian needs shift and scale")
            draw = _truncated(own, low, high, shift, scale)
        elif distribution == "uniform":
            draw = F.lit(float(low)) + F.lit(float(high - low)) * F.rand(own)
        else:
            raise PrivacyError(f"unknown distribution {distribution}")
        x = F.col(n)
        if p.kind == "int":
            draw = F.least(F.floor(draw + 0.5) if distribution == "gaussian" else F.floor(F.lit(float(low)) + F.lit(float(high - low + 1)) * F.rand(own)), F.lit(int(high))).cast("long")
            exprs[n] = F.coalesce(x, draw)
        else:
            exprs[n] = F.when(F.isnan(x) | x.isNull(), draw).otherwise(x)
        props[n] = replace(p, nullable=False, lower=None if p.lower is None else min(low, p.lower), upper=None if p.upper is None else max(high, p.upper))
    return _set(frame, exprs, props)


def weighted(categories: Sequence, weights: Sequence[float] | None, u: Column) -> Column:
    """The category whose share of [0, 1) holds u; an array of bounds, so u is drawn once."""
    p = list(weights) if weights else [1.0] * len(categories)
    if len(p) != len(categories) or any(w < 0 for w in p) or not sum(p):
        raise PrivacyError("there must be a weight for each category")
    reached, ends = 0.0, []
    for w in p:
        reached += w / math.fsum(p)
        ends.append(reached)
    values = F.array(*[F.struct(F.lit(float(e) if i < len(ends) - 1 else 2.0).alias("e"), F.lit(c).alias("c")) for i, (e, c) in enumerate(zip(ends, categories))])
    return F.element_at(F.transform(F.array(u), lambda x: F.element_at(F.filter(values, lambda v: x < v["e"]), 1)["c"]), 1)


def digitize(frame: PrivateFrame, column: str, edges: Sequence[float], null_value: int = -1, inclusive_left: bool = True, out: str | None = None) -> PrivateFrame:
    edges = sorted(edges)
    if len(set(edges)) != len(edges) or len(edges) < 2 or len(edges) > MAX_EDGES:
        raise PrivacyError("edges are two or more different numbers")
    frame.numeric([column], "digitize", null=True)
    props = Props("int", False, categories=tuple(dict.fromkeys((*range(len(edges) - 1), null_value))))
    return _set(frame, {out or column: C.digitize(F.col(column), edges, null_value, inclusive_left)}, {out or column: props})


def bin_value(frame: PrivateFrame, column: str, edges: Sequence[float], null_value: float = -1, side: str = "midpoint", inclusive_left: bool = True, out: str | None = None) -> PrivateFrame:
    frame.numeric([column], "bin", null=True)
    return _set(frame, {out or column: C.bin_value(F.col(column), edges, null_value, side, inclusive_left)}, {out or column: Props("float", False, min(*edges, null_value), max(*edges, null_value))})


def cast(frame: PrivateFrame, columns, atomic_type: str, true_label=None, lower=None, upper=None, seed: int | None = None) -> PrivateFrame:
    """bool: equal to true_label; float: parsed, or NaN; int: parsed or rounded, or a draw between the bounds; string."""
    exprs, props = {}, {}
    types = dict(frame.df.dtypes)
    for i, n in enumerate(_names(frame, columns)):
        x, p = F.col(n), frame.of(n)
        if atomic_type == "bool":
            if true_label is None:
                raise PrivacyError("a cast to bool needs a true_label")
            exprs[n], props[n] = C.to_bool(x, true_label), Props("bool", False, categories=(True, False))
        elif atomic_type == "float":
            exprs[n], props[n] = C.to_float(x, types[n]), Props("float", p.kind == "str" or p.nullable, p.lower, p.upper)
        elif atomic_type == "int":
            if lower is None or upper is None or not lower <= upper:
                raise PrivacyError("a cast to int needs lower and upper")
            draw = (F.floor(F.rand(secrets.randbits(62) if seed is None else seed + i) * (upper - lower + 1)) + lower).cast("long")
            exprs[n], props[n] = C.to_int(x, types[n], draw), Props("int", False)
        elif atomic_type in ("string", "str"):
            exprs[n], props[n] = C.to_string(x, types[n]), Props("str", p.nullable)
        else:
            raise PrivacyError(f"unknown type {atomic_type}")
    return _set(frame, exprs, props)


def to_bool(frame: PrivateFrame, columns, true_label) -> PrivateFrame:
    return cast(frame, columns, "bool", true_label=true_label)


def to_float(frame: PrivateFrame, columns) -> PrivateFrame:
    return cast(frame, columns, "float")


def to_int(frame: PrivateFrame, columns, lower: int, upper: int, seed: int | None = None) -> PrivateFrame:
    return cast(frame, columns, "int", lower=lower, upper=upper, seed=seed)


def to_string(frame: PrivateFrame, columns) -> PrivateFrame:
    return cast(frame, columns, "string")


# ---------------------------------------------------------------- element-wise arithmetic


def _side(frame: PrivateFrame, x) -> tuple[Column, Props]:
    if isinstance(x, str):
        return F.col(x), frame.of(x)
    kind = "bool" if isinstance(x, bool) else "int" if isinstance(x, int) else "float"
    bound = None if kind == "bool" else x
    return F.lit(x), Props(kind, False, bound, bound)


def _range(p: Props) -> I.Range:
    return p.lower, p.upper


_NUMBERS = ("int", "float")


UNARY = ("abs", "negative", "negate", "log")


def transform(frame: PrivateFrame, out: Sequence[str] | str, op: str, left, right=None, base: float = C.LOG_BASE) -> PrivateFrame:
    """Adds column out = op(left, right); operands are columns (by name) or numbers. Bounds and missing values are carried.

    Operands may be lists, of which a row of numbers is one: k with k go pair by pair, k with one take that one each time,
    other lengths are an error. The columns are named by a list out; a single name is followed by _ and the left operand's
    name (or its place, where that is a number). All are made of the columns as they were.
    """
    sides = [list(v) if isinstance(v, (list, tuple)) else [v] for v in ((left,) if op in UNARY else (left, right))]
    k = max(map(len, sides))
    if any(len(v) not in (1, k) or not v for v in sides):
        raise PrivacyError(f"{op}: operands of {' and '.join(str(len(v)) for v in sides)} columns don't go together")
    sides = [v * k if len(v) == 1 else v for v in sides]
    if isinstance(out, str):
        names = [out] if k == 1 and not isinstance(left, (list, tuple)) and not isinstance(right, (list, tuple)) else [f"{out}_{v if isinstance(v, str) else i}" for i, v in enumerate(sides[0])]
    else:
        names = list(out)
    if len(names) != k or len(set(names)) != k:
        raise PrivacyError(f"{op}: {k} columns need as many different names")
    made = [_made(frame, op, *own, base=base) for own in zip(*sides)]
    return _set(frame, {n: e for n, (e, _) in zip(names, made)}, {n: p for n, (_, p) in zip(names, made)})


def _made(frame: PrivateFrame, op: str, left, right=None, base: float = C.LOG_BASE) -> tuple[Column, Props]:
    """One column, and what is known of it."""
    x, p = _side(frame, left)
    unary = op in UNARY
    y, q = (None, None) if unary else _side(frame, right)
    kinds = {p.kind} | (set() if unary else {q.kind})
    nullable = p.nullable or bool(q and q.nullable)
    whole = kinds == {"int"}
    if op in ("negate", "and", "or"):
        if kinds != {"bool"}:
            raise PrivacyError(f"{op} takes booleans")
        expr = C.negate(x) if op == "negate" else C.logical_and(x, y) if op == "and" else C.logical_or(x, y)
        return expr, Props("bool", nullable, categories=(True, False))
    if op in ("equal", "greater_than", "less_than"):
        if op == "equal" and len(kinds) > 1 and not kinds <= set(_NUMBERS) or op != "equal" and not kinds <= set(_NUMBERS):
            raise PrivacyError(f"{op} takes operands of one kind")
        expr = C.equal(x, y, kinds <= set(_NUMBERS)) if op == "equal" else getattr(C, op)(x, y)
        return expr, Props("bool", False, categories=(True, False))
    if op == "add" and kinds == {"str"}:
        return C.concat(x, y), Props("str", nullable)
    if not kinds <= set(_NUMBERS):
        raise PrivacyError(f"{op} takes numbers")
    if not whole and not unary:
        x, y = x.cast("double"), y.cast("double")
    kind = "int" if whole else "float"
    a, b = _range(p), _range(q) if q else None
    if op in ("add", "subtract", "multiply", "row_max", "row_min"):
        expr, bounds = getattr(C, op)(x, y), getattr(I, op)(a, b)
    elif op == "divide":
        expr, bounds = (C.divide_integers if whole else C.divide)(x, y), I.divide(a, b)
        nullable = nullable or bounds == I.ALL
        if whole and None not in bounds:
            bounds = tuple(math.trunc(e) for e in bounds)
    elif op == "modulo":
        if b[0] is None or b[0] <= 0:
            raise PrivacyError("the divisor of modulo must be known to be positive")
        expr, bounds = C.modulo(x, y), I.modulo(a, b)
    elif op == "power":
        if whole and (b[0] is None or b[0] < 0):
            raise PrivacyError("an integer power needs a radical of zero or more")
        expr, bounds = (C.power_integers if whole else C.power)(x, y), I.power(a, b)
    elif op == "log":
        if p.kind != "float" or a[0] is None or a[0] <= 0 or base <= 0 or base == 1:
            raise PrivacyError("log takes floats known to be positive, and a base that is positive and not 1")
        expr, bounds = C.log(x, base), I.log(a, base)
    elif op == "abs":
        expr, bounds = C.absolute(x), I.absolute(a)
    elif op == "negative":
        expr, bounds = C.negative(x), I.negative(a)
    else:
        raise PrivacyError(f"unknown function {op}")
    return expr, Props(kind, nullable, *bounds)


# ---------------------------------------------------------------- a forced number of rows


def _nth(df: DataFrame, key: str, n: int) -> tuple[int, float | None]:
    """How many rows have a number in a column, and the n-th smallest of them (none if there are fewer)."""

    def look(first: list[R.Cell]) -> R.Asking:
        have, found = yield from R.at_places(first, lambda have: [n - 1] if have >= n else [])
        return have, found.get(n - 1)

    return R.ask(df, [(F.col(key), None)], [], [()], [(0, look)])[0][()]


def _up_to(df: DataFrame, key: str, n: int, last: float) -> DataFrame:
    """The n rows of the smallest numbers in a column of written rows; last: the n-th of them. Of rows that share it, any."""
    below, tied = df.where(F.col(key) < last), df.where(F.col(key) == last)
    more = n - below.count()
    kept = df.where(F.col(key) <= last) if more == tied.count() else below.unionByName(tied.limit(more))
    return kept.drop(key)


def _exactly(df: DataFrame, n: int, have: int, seed: int) -> DataFrame:
    """n rows of df, drawn without replacement, in as many partitions as df has: those up to the n-th smallest of a random number.

    Rows below a threshold that is sure to hold n (but for odds of e^-50, when it is widened) are written once, so that the
    number a row drew is the same each time it is read.
    """
    if n >= have:
        return df
    if n <= 0:
        return df.limit(0)
    share = n / have + 10 * math.sqrt(n / have / have) + 20 / have
    while True:
        drawn = df.withColumn("__u", F.rand(seed))
        few = written(drawn.where(F.col("__u") < share) if share < 1 else drawn, "drawn")
        found, last = _nth(few, "__u", n)
        if found >= n:
            return _up_to(few, "__u", n, last)
        share = min(1.0, 2 * share)


def subset(frame: PrivateFrame, n: int, weights: str | None = None, seed: int | None = None) -> PrivateFrame:
    """n rows, drawn one after the other without replacement, each time with odds in proportion to a column of weights (without one: equal).

    A row's key is an exponential time of its weight's rate, -ln(u) / w; the rows of the n smallest keys are such a draw
    (Efraimidis and Spirakis, 2006). Keys are written with the rows, the n-th smallest is found by counted ranges, and
    nothing is sorted. Rows whose weight is zero, negative or missing are never drawn; fewer than n others are an error.
    The weights are data, so what is released of a weighted subset costs as if all rows were read.
    """
    if n < 1:
        raise PrivacyError("a subset has a row or more")
    if weights is not None and frame.of(weights).kind not in _NUMBERS:
        raise PrivacyError(f"subset: {weights} is not numeric")
    if frame.keys:
        raise PrivacyError("subset takes rows that are not parted")
    w = F.lit(1.0) if weights is None else F.col(weights).cast("double")
    u = F.lit(1.0) - F.rand(secrets.randbits(62) if seed is None else seed)  # above 0
    keyed = frame.df.withColumn("__key", F.when(F.isnotnull(w) & ~F.isnan(w) & (w > 0), F.try_divide(-F.log(u), w)))
    keyed = written(keyed.where(F.col("__key").isNotNull()), "keyed")
    have, last = _nth(keyed, "__key", n)
    if have < n:
        raise PrivacyError(f"a subset of {n} rows needs as many with a positive weight")
    return frame.new_rows(_up_to(keyed, "__key", n, last), n=n, not_empty=True)


def _synthetic(frame: PrivateFrame, k: int, seed: int, lower, upper, categories, weights, distribution, shift, scale):
    """k made-up rows within the bounds and categories of the columns."""
    spark, exprs = frame.df.sparkSession, []
    types = dict(frame.df.dtypes)
    for i, (n, p) in enumerate(frame.props.items()):
        cats = categories.get(n) if isinstance(categories, dict) else categories
        cats = cats or p.categories
        if cats and p.kind != "float":
            expr = weighted(_distinct(cats), weights, F.rand(seed + i))
        elif p.kind in _NUMBERS:
            low = p.lower if lower is None else lower
            high = p.upper if upper is None else upper
            if low is None or high is None:
                raise PrivacyError(f"resize: the bounds of {n} must be known")
            if distribution == "gaussian" and p.kind == "float":
                expr = _truncated(seed + i, low, high, shift, scale)
            else:
                u = F.rand(seed + i)
                expr = F.lit(low) + F.lit(high - low) * u if p.kind == "float" else F.floor(u * (high - low + 1)) + low
        else:
            raise PrivacyError(f"resize: the categories of {n} must be known")
        exprs.append(expr.cast(types[n]).alias(n))
    return spark.range(k).select(*exprs)


def sampled_count(rate: float, n: int, definition: Definition, rng: Secure | None = None) -> int:
    """How many of n rows a sample at a rate has."""
    return math.floor(rate * n) if definition.neighboring == SUBSTITUTE else binomial(n, rate, rng or Secure())


def resize(frame: PrivateFrame, number_rows: int | None = None, minimum_rows: int | None = None, sample_proportion: float | None = None, lower=None, upper=None, categories=None, weights=None, distribution: str = "uniform", shift=None, scale=None, number_columns: int | None = None, seed: int | None = None, rng: Secure | None = None) -> PrivateFrame:
    """A known number of rows: a sample without replacement if there are more, made-up rows besides if there are fewer.

    minimum_rows only adds. With sample_proportion p the rows are first repeated ceil(p) times (which multiplies what an
    individual may move) and sampled at the rate p / ceil(p): exactly that share of them under substitution, a Binomial
    number under add/remove, so that the number of rows of the data doesn't show.
    """
    if number_columns is not None and number_columns != len(frame.props):
        raise PrivacyError("the number of columns is another")
    if (number_rows is None) == (minimum_rows is None):
        raise PrivacyError("resize needs number_rows or minimum_rows")
    seed = secrets.randbits(60) if seed is None else seed
    df, stability, rate = frame.df.select(*frame.props), frame.stability, frame.sample
    if sample_proportion is not None:
        if sample_proportion <= 0:
            raise PrivacyError("sample_proportion must be positive")
        c = math.ceil(sample_proportion)
        df = df.withColumn("__c", F.explode(F.sequence(F.lit(1), F.lit(c)))).drop("__c") if c > 1 else df
        stability, rate = stability * c, rate * sample_proportion / c
    want = number_rows if number_rows is not None else minimum_rows
    have = df.count()
    if number_rows is not None:
        most = have
        if sample_proportion is not None:
            p = sample_proportion / math.ceil(sample_proportion)
            most = sampled_count(p, have, frame.definition, rng)
        df, have = _exactly(df, min(want, most), have, seed), min(want, most)
    if have < want:
        more = _synthetic(frame, want - have, seed + 1, lower, upper, categories, weights, distribution, shift, scale)
        df = df.unionByName(more)
    props = {}
    for n, p in frame.props.items():
        if p.kind in _NUMBERS and lower is not None and p.lower is not None:
            p = replace(p, lower=min(p.lower, lower), upper=max(p.upper, upper))
        props[n] = p
    return frame.new_rows(df, props=props, n=number_rows, stability=stability, sample=rate, not_empty=want > 0)
