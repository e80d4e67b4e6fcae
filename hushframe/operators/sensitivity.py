"""How far one individual can move an aggregate, per column: closed forms of the number of records and the bounds."""

from __future__ import annotations

import math

from hushframe.privacy import SUBSTITUTE, PrivacyError

Bounds = tuple[float, float]


def _known(n: int | None) -> int:
    if n is None:
        raise PrivacyError("the number of records must be known")
    return n


def count(n: int | None, neighboring: str, distinct: bool = False) -> float:
    """With a known number of records a count tells nothing; a distinct count still moves by one."""
    return 1.0 if distinct or n is None else 0.0


def total(bounds: Bounds, neighboring: str) -> float:
    low, high = bounds
    return high - low if neighboring == SUBSTITUTE else max(abs(low), abs(high))


def mean(bounds: Bounds, n: int | None, neighboring: str) -> float:
    return (bounds[1] - bounds[0]) / _known(n)


def variance(bounds: Bounds, n: int | None, neighboring: str, ddof: int = 1) -> float:
    n = _known(n)
    scale = (n - 1) / n / (n - ddof) if neighboring == SUBSTITUTE else n / (n + 1) / (n - ddof)
    return (bounds[1] - bounds[0]) ** 2 * scale


def covariance(left: Bounds, right: Bounds, n: int | None, neighboring: str, ddof: int = 1) -> float:
    n = _known(n)
    scale = 2 * (n - 1) / n / (n - ddof) if neighboring == SUBSTITUTE else n / (n + 1) / (n - ddof)
    return (left[1] - left[0]) * (right[1] - right[0]) * scale


def power_range(bounds: Bounds, order: int) -> Bounds:
    """The range of x**order over the bounds."""
    ends = [bounds[0] ** order, bounds[1] ** order]
    if order % 2 == 0 and bounds[0] < 0 < bounds[1]:
        ends.append(0.0)
    return min(ends), max(ends)


def raw_moment(bounds: Bounds, order: int, n: int | None, neighboring: str) -> float:
    low, high = power_range(bounds, order)
    return (high - low) / _known(n)


def quantile(bounds: Bounds) -> float:
    return bounds[1] - bounds[0]


def quantile_utility(alpha: float, neighboring: str) -> float:
    return 1.0 if neighboring == SUBSTITUTE else max(alpha, 1 - alpha)


def histogram(categories: int, n: int | None, neighboring: str, norm: int = 1) -> float:
    if categories == 1:
        return 0.0 if n is not None else 1.0
    return (2.0 if norm == 1 else math.sqrt(2)) if neighboring == SUBSTITUTE else 1.0
