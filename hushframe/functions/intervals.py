"""Bounds of expressions from bounds of their parts (None: unbounded)."""

from __future__ import annotations

import math

Range = tuple[float | None, float | None]
ALL: Range = (None, None)


def _corners(f, a: Range, b: Range) -> Range:
    if None in a or None in b:
        return ALL
    ends = [f(x, y) for x in a for y in b]
    return min(ends), max(ends)


def add(a: Range, b: Range) -> Range:
    return tuple(None if x is None or y is None else x + y for x, y in zip(a, b))


def subtract(a: Range, b: Range) -> Range:
    return add(a, negative(b))


def negative(a: Range) -> Range:
    return tuple(None if x is None else -x for x in reversed(a))


def multiply(a: Range, b: Range) -> Range:
    return _corners(lambda x, y: x * y, a, b)


def divide(a: Range, b: Range) -> Range:
    """No bounds if the divisor may be zero."""
    if None in b or b[0] <= 0 <= b[1]:
        return ALL
    return _corners(lambda x, y: x / y, a, b)


def modulo(a: Range, b: Range) -> Range:
    return 0, b[1]


def power(a: Range, b: Range) -> Range:
    if None in a or None in b or a[0] < 0:
        return ALL
    try:
        return _corners(lambda x, y: x**y, a, b)
    except (OverflowError, ZeroDivisionError):
        return ALL


def log(a: Range, base: float) -> Range:
    ends = tuple(None if x is None or x <= 0 else math.log(x, base) for x in a)
    return ends if base > 1 else tuple(reversed(ends))


def absolute(a: Range) -> Range:
    low, high = a
    if None in a:
        return (low if low is not None and low >= 0 else -high if high is not None and high <= 0 else 0), None
    return (0 if low <= 0 <= high else min(abs(low), abs(high))), max(abs(low), abs(high))


def row_max(a: Range, b: Range) -> Range:
    low = [x for x in (a[0], b[0]) if x is not None]
    return max(low) if low else None, None if a[1] is None or b[1] is None else max(a[1], b[1])


def row_min(a: Range, b: Range) -> Range:
    high = [x for x in (a[1], b[1]) if x is not None]
    return None if a[0] is None or b[0] is None else min(a[0], b[0]), min(high) if high else None
