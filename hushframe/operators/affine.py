"""Affine maps of aggregates before noise: scales, shifts and linear mixes, with what they do to bounds and sensitivities.

A sensitivity that is a column's own is multiplied by the map's constant for that column; a mix of columns adds up what each
may move. A sensitivity of all values together (a histogram's) is multiplied by the map's operator norm: for the L1 norm the
largest sum of a column of the matrix, for the L2 norm its largest singular value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np

from hushframe.plans.frame import Aggregate
from hushframe.privacy import PrivacyError


def _checked(a: Aggregate) -> None:
    if a.candidates is not None and not a.joint:
        raise PrivacyError("utilities of candidates are compared by the exponential mechanism only")


def _each(a: Aggregate, by) -> list[float]:
    out = list(by) if isinstance(by, (list, tuple)) else [by] * a.width
    if len(out) != a.width or any(isinstance(b, bool) or not isinstance(b, (int, float)) or not np.isfinite(b) for b in out):
        raise PrivacyError(f"{a.width} values need one finite number or {a.width}")
    return out


def _scaled_bounds(a: Aggregate, by: list[float]) -> tuple[list | None, list | None]:
    if a.lower is None or a.upper is None:
        return a.lower, a.upper
    ends = [(low, high) if k > 0 else (high, low) if k < 0 else (0, 0) for low, high, k in zip(a.lower, a.upper, by)]
    product = lambda x, k: None if x is None else x * k
    return [product(x, k) for (x, _), k in zip(ends, by)], [product(x, k) for (_, x), k in zip(ends, by)]


def scaled(a: Aggregate, by: float | Sequence[float]) -> Aggregate:
    """Each value times a number."""
    _checked(a)
    by = _each(a, by)
    low, high = _scaled_bounds(a, by)
    most = max(map(abs, by))
    sensitivity = (lambda norm: [s * most for s in a.sensitivity(norm)]) if a.joint else (lambda norm: [s * abs(k) for s, k in zip(a.sensitivity(norm), by, strict=True)])
    return replace(a, finish=lambda v: [x * k for x, k in zip(a.finish(v), by, strict=True)], sensitivity=sensitivity, kind=a.kind if all(isinstance(k, int) for k in by) else "float", lower=low, upper=high)


def shifted(a: Aggregate, by: float | Sequence[float]) -> Aggregate:
    """Each value plus a number, which no individual moves."""
    _checked(a)
    by = _each(a, by)
    moved = lambda ends: ends and [None if x is None else x + k for x, k in zip(ends, by)]
    return replace(a, finish=lambda v: [x + k for x, k in zip(a.finish(v), by, strict=True)], kind=a.kind if all(isinstance(k, int) for k in by) else "float", lower=moved(a.lower), upper=moved(a.upper))


def mixed(a: Aggregate, rows: Sequence[Sequence[float]]) -> Aggregate:
    """Values that are sums of the aggregate's values, each times a number: a matrix of a row a new value."""
    _checked(a)
    matrix = [list(r) for r in rows]
    if not matrix or any(len(r) != a.width for r in matrix) or not np.isfinite(np.array(matrix, float)).all():
        raise PrivacyError(f"a mix needs rows of {a.width} finite numbers")
    m = np.array(matrix, float)

    def sensitivity(norm: int) -> list[float]:
        own = a.sensitivity(norm)
        if a.joint:
            return [float(own[0] * (np.linalg.norm(m, 2) if norm == 2 else np.abs(m).sum(axis=0).max()))] * len(matrix)
        return [sum(abs(k) * s for k, s in zip(r, own)) for r in matrix]

    def ends(upper: bool) -> list:
        if a.lower is None or a.upper is None:
            return [None] * len(matrix)
        out = []
        for r in matrix:
            used = [(k, (high if (k > 0) == upper else low)) for k, low, high in zip(r, a.lower, a.upper) if k]
            out.append(None if any(x is None for _, x in used) else sum(k * x for k, x in used))
        return out

    whole = a.kind == "int" and all(isinstance(k, int) for r in matrix for k in r)
    finish = lambda v: [sum(k * x for k, x in zip(r, a.finish(v), strict=True)) for r in matrix]
    return replace(a, finish=finish, sensitivity=sensitivity, kind="int" if whole else "float", lower=ends(False), upper=ends(True), columns=tuple(f"{a.name}{i}" for i in range(len(matrix))), candidates=tuple(range(len(matrix))) if a.joint else None)
