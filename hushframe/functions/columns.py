"""Element-wise functions as Column expressions. NaN is a missing number: it passes through arithmetic, equals nothing,
is neither greater nor less than anything, and row_max and row_min pass over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The base of log() where none is given.
LOG_BASE = 2.71828
INT_TEXT, FLOAT_TEXT = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|inf|infinity|nan)$"


#: Coefficients of P. J. Acklam's rational approximation of the inverse normal distribution function, highest power first, and where its tails begin.
_CENTRE = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_UNDER_CENTRE = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_TAIL = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277162838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_UNDER_TAIL = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_TAIL_BELOW = 0.02425


def col(x: Column | str | float | bool) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _nan(x: Column) -> Column:
    """Whether a number is missing: NaN or null."""
    return x.isNull() | F.isnan(x.cast("double"))


def absolute(x: Column) -> Column:
    return F.abs(x)


def add(x: Column, y: Column) -> Column:
    return x + y


def concat(x: Column, y: Column) -> Column:
    return F.concat(x, y)


def subtract(x: Column, y: Column) -> Column:
    return x - y


def multiply(x: Column, y: Column) -> Column:
    return x * y


def divide(x: Column, y: Column) -> Column:
    """Floating-point division, with infinities and NaN for a divisor of zero."""
    by_zero = F.when(_nan(x) | (x == 0), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(y == 0, by_zero).otherwise(F.try_divide(x.cast("double"), y.cast("double")))


def divide_integers(x: Column, y: Column) -> Column:
    """Towards zero; null for a divisor of zero."""
    return F.when(y != 0, F.call_function("div", x, y))


def modulo(x: Column, y: Column) -> Column:
    return F.pmod(x, y)


def power(x: Column, y: Column) -> Column:
    return F.pow(x, y)


def power_integers(x: Column, y: Column) -> Column:
    return F.pow(x, y).cast("long")


def log(x: Column, base: float = LOG_BASE) -> Column:
    return F.log(x) / F.log(F.lit(base))


def negative(x: Column) -> Column:
    return -x


def negate(x: Column) -> Column:
    return ~x


def logical_and(x: Column, y: Column) -> Column:
    return x & y


def logical_or(x: Column, y: Column) -> Column:
    return x | y


def equal(x: Column, y: Column, numeric: bool = True) -> Column:
    same = F.coalesce(x == y, F.lit(False))
    return same & ~_nan(x) & ~_nan(y) if numeric else same


def greater_than(x: Column, y: Column) -> Column:
    return F.coalesce(x > y, F.lit(False)) & ~_nan(x) & ~_nan(y)


def less_than(x: Column, y: Column) -> Column:
    return F.coalesce(x < y, F.lit(False)) & ~_nan(x) & ~_nan(y)


def row_max(x: Column, y: Column) -> Column:
    return F.when(_nan(x), y).when(_nan(y), x).otherwise(F.greatest(x, y))


def row_min(x: Column, y: Column) -> Column:
    return F.when(_nan(x), y).when(_nan(y), x).otherwise(F.least(x, y))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(_nan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def clamp_categories(x: Column, categories: Sequence, null_value) -> Column:
    return F.when(x.isin(list(categories)), x).otherwise(F.lit(null_value))


def edges_below(x: Column, edges: Sequence[float], or_equal: bool) -> Column:
    """How many of sorted edges are below x (or equal to it), by an expression that doesn't grow with the edges: of even edges a division and a look at both neighbours, else a binary search in an array."""
    k, table = len(edges), F.array(*[F.lit(float(e)) for e in edges])
    below = lambda edge: (edge <= x) if or_equal else (edge < x)
    each = (edges[-1] - edges[0]) / max(k - 1, 1)
    if k > 2 and all(abs(e - edges[0] - i * each) < each / 4 for i, e in enumerate(edges)):
        guess = (F.floor(F.least(F.greatest((x - F.lit(float(edges[0]))) / F.lit(float(each)), F.lit(-1.0)), F.lit(float(k - 1)))) + 1).cast("int")
        return F.when((guess < k) & F.coalesce(below(F.get(table, guess)), F.lit(False)), guess + 1).when((guess > 0) & ~below(F.get(table, guess - 1)), guess - 1).otherwise(guess)
    steps = [1 << b for b in range(k.bit_length() - 1, -1, -1)]

    def further(at: Column, step: Column) -> Column:
        edge = F.get(table, at + step - 1)  # null beyond the last
        return F.when(below(edge), at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def digitize(x: Column, edges: Sequence[float], null_value: int = -1, inclusive_left: bool = True) -> Column:
    """The bin of sorted edges that x lies in: [low, high), or (low, high]; null_value outside and for NaN."""
    edges = sorted(edges)
    at = edges_below(x, edges, inclusive_left)
    return F.when(~_nan(x) & (at > 0) & (at < len(edges)), at - 1).otherwise(F.lit(null_value)).cast("long")


def place_among(x: Column, edges: Sequence[float]) -> Column:
    """Where x lies among sorted, different edges: 2 j below edge j and above the one before, 2 j + 1 on edge j; null for a missing number."""
    table, at = F.array(*[F.lit(float(e)) for e in edges]), edges_below(x, edges, False)
    return F.when(~_nan(x), 2 * at + F.coalesce(F.get(table, at) == x, F.lit(False)).cast("int"))


def bin_value(x: Column, edges: Sequence[float], null_value: float, side: str = "midpoint", inclusive_left: bool = True) -> Column:
    """The lower edge, midpoint or upper edge of x's bin."""
    edges = sorted(edges)
    value = {"lower": edges[:-1], "upper": edges[1:], "midpoint": [(a + b) / 2 for a, b in zip(edges, edges[1:])]}[side]
    at = digitize(x, edges, -1, inclusive_left)
    return F.when(at >= 0, F.element_at(F.array(*[F.lit(float(v)) for v in value]), (at + 1).cast("int"))).otherwise(F.lit(float(null_value)))


def to_bool(x: Column, true_label) -> Column:
    return F.coalesce(x == F.lit(true_label), F.lit(False))


def to_float(x: Column, kind: str) -> Column:
    """Numbers and what reads as one; anything else is NaN."""
    if kind == "string":
        return F.coalesce(F.when(F.lower(x).rlike(FLOAT_TEXT), x.try_cast("double")), F.lit(float("nan")))
    return F.coalesce(x.cast("int").cast("double") if kind == "boolean" else x.cast("double"), F.lit(float("nan")))


def to_int(x: Column, kind: str, fallback: Column) -> Column:
    """Whole numbers; floats are rounded, halves away from zero; what cannot be read becomes fallback."""
    if kind == "string":
        return F.coalesce(F.when(x.rlike(INT_TEXT), x.try_cast("bigint")), fallback)
    if kind == "boolean":
        return F.coalesce(x.cast("int").cast("long"), fallback)
    if kind in ("double", "float"):
        return F.when(_nan(x) | (F.abs(x) >= 2.0**63), fallback).otherwise((F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("long"))
    return F.coalesce(x.cast("long"), fallback)


def to_string(x: Column, kind: str) -> Column:
    """Whole floats are written without a fraction."""
    if kind in ("double", "float"):
        return F.when(_nan(x), F.lit("NaN")).when((F.abs(x) < 1e15) & (x == F.floor(x)), x.cast("decimal(20,0)").cast("string")).otherwise(x.cast("string"))
    return x.cast("string")


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: Column) -> Column:
    """The quantile of the standard normal distribution at p (above 0, below 1), with a relative error of about 1e-9. p is evaluated once, so it may be random."""

    def at(u: Column) -> Column:
        q = u - 0.5
        t = F.sqrt(-2 * F.log(F.least(u, 1 - u)))
        tail = _polynomial(t, _TAIL) / _polynomial(t, _UNDER_TAIL)
        return F.when(F.abs(q) <= 0.5 - _TAIL_BELOW, q * _polynomial(q * q, _CENTRE) / _polynomial(q * q, _UNDER_CENTRE)).when(q < 0, tail).otherwise(-tail)

    return F.element_at(F.transform(F.array(p), at), 1)
