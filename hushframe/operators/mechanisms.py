"""Mechanisms on aggregates, and the private statistics made of them. All return planned releases; nothing runs before planner.release()."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from hushframe.operators import aggregates as A
from hushframe.operators import noise as N
from hushframe.operators import preprocess as P
from hushframe.operators import ranks as R
from hushframe.operators.slopes import Slopes
from hushframe.operators.structure import reshape
from hushframe.plans.frame import Aggregate, Noisy, Order, PrivateFrame
from hushframe.plans.planner import dense_keys
from hushframe.plans.shared import fixed_plans
from hushframe.privacy import PrivacyError, Usage, as_usage, effective

ADDITIVE = ("laplace", "gaussian", "analyticgaussian", "snapping", "simplegeometric")
LARGEST = 2**63 - 1


def _rng(frame: PrivateFrame, rng: N.Secure | None) -> N.Secure:
    rng = rng or N.Secure(frame.definition.protect_elapsed_time)
    if rng.testing and frame.definition.protect_floating_point:
        raise PrivacyError("a seeded source is for tests; it is refused while floating-point protection is on")
    return rng


def _shares(aggregate: Aggregate, paid: Usage, met: int) -> list[Usage]:
    """What the mechanism may use for each value of an aggregate for which an individual, who is in met of such row sets, pays in all."""
    if aggregate.parts:
        most = met * A.met(aggregate.parts)
        return [u for part in aggregate.parts for u in _shares(part, paid, most)]
    frame = aggregate.frame
    each = [paid] * aggregate.width if aggregate.joint else paid.spread(aggregate.width)
    return [effective(u, frame.stability * met, frame.definition.group_size, frame.sample) for u in each]


def _plan(aggregate: Aggregate, usage, sensitivity, norm: int, columns: int) -> tuple[list[Usage], list[Usage], list[float]]:
    """Per column: what is paid, what the mechanism may use, and the sensitivity."""
    frame = aggregate.frame
    if aggregate.parts or aggregate.joint:  # one budget, and what values share of it
        if isinstance(usage, list):
            raise PrivacyError("values that are released together have one budget")
        paid = [as_usage(usage)]
        used = _shares(aggregate, paid[0], 1)
        if len(used) != columns:
            used *= columns // len(used)
    else:
        paid = [as_usage(u) for u in usage] if isinstance(usage, list) else as_usage(usage).spread(columns)
        if len(paid) != columns:
            raise PrivacyError(f"{columns} columns need one budget or {columns}")
        used = [effective(u, frame.stability, frame.definition.group_size, frame.sample) for u in paid]
    for u in paid:
        u.check(frame.n, frame.definition.strict)
    if sensitivity is None:
        proved = aggregate.sensitivity(norm)
    elif frame.definition.protect_sensitivity:
        raise PrivacyError("a sensitivity of one's own is refused while sensitivity protection is on")
    else:
        proved = P._each(sensitivity, columns)
    if len(proved) != columns:
        raise PrivacyError(f"there are {len(proved)} sensitivities for {columns} columns")
    return paid, used, proved


def _width(aggregate: Aggregate) -> int:
    return aggregate.width


def _no_floats(frame: PrivateFrame, what: str) -> None:
    if frame.definition.protect_floating_point:
        raise PrivacyError(f"the {what} mechanism leaks through floating point; use snapping or simplegeometric, or turn the protection off")


def _noisy(aggregate: Aggregate, what: str, paid: list[Usage], draws: list, **arguments) -> Noisy:
    return Noisy(aggregate.name, [(aggregate, lambda v: [d(x) for d, x in zip(draws, v, strict=True)])], paid, mechanism=what, arguments=arguments)


def laplace_mechanism(aggregate: Aggregate, usage, sensitivity=None, rng: N.Secure | None = None) -> Noisy:
    _no_floats(aggregate.frame, "Laplace")
    rng = _rng(aggregate.frame, rng)
    paid, used, sens = _plan(aggregate, usage, sensitivity, 1, _width(aggregate))
    return _noisy(aggregate, "Laplace", paid, [lambda x, s=s, u=u: N.laplace(float(x), s, u.epsilon, rng) for s, u in zip(sens, used)], sensitivity=sens, epsilon=[u.epsilon for u in used])


def gaussian_mechanism(aggregate: Aggregate, usage, sensitivity=None, analytic: bool = True, rng: N.Secure | None = None) -> Noisy:
    _no_floats(aggregate.frame, "Gaussian")
    rng = _rng(aggregate.frame, rng)
    paid, used, sens = _plan(aggregate, usage, sensitivity, 2, _width(aggregate))
    for s, u in zip(sens, used):
        N.gaussian_sigma(s, u.epsilon, u.delta, analytic)
    return _noisy(aggregate, "AnalyticGaussian" if analytic else "Gaussian", paid, [lambda x, s=s, u=u: N.gaussian(float(x), s, u.epsilon, u.delta, rng, analytic) for s, u in zip(sens, used)], sensitivity=sens, epsilon=[u.epsilon for u in used])


def simple_geometric_mechanism(aggregate: Aggregate, usage, lower=None, upper=None, sensitivity=None, rng: N.Secure | None = None) -> Noisy:
    if aggregate.kind != "int":
        raise PrivacyError("the geometric mechanism takes integers")
    frame, k = aggregate.frame, _width(aggregate)
    rng = _rng(frame, rng)
    paid, used, sens = _plan(aggregate, usage, sensitivity, 1, k)
    low = [a if a is not None else b for a, b in zip(P._each(lower, k), aggregate.lower or [None] * k)]
    high = [a if a is not None else b for a, b in zip(P._each(upper, k), aggregate.upper or [None] * k)]
    if None in low or None in high:
        raise PrivacyError("the geometric mechanism needs lower and upper")
    return _noisy(aggregate, "SimpleGeometric", paid, [lambda x, s=s, u=u, a=a, b=b: N.simple_geometric(x, s, u.epsilon, int(a), int(b), rng, frame.definition.protect_elapsed_time) for s, u, a, b in zip(sens, used, low, high)], sensitivity=sens, epsilon=[u.epsilon for u in used], lower=low, upper=high)


def snapping_mechanism(aggregate: Aggregate, usage, lower=None, upper=None, binding_probability: float | None = None, sensitivity=None, rng: N.Secure | None = None) -> Noisy:
    k = _width(aggregate)
    rng = _rng(aggregate.frame, rng)
    paid, used, sens = _plan(aggregate, usage, sensitivity, 1, k)
    low = [a if a is not None else b for a, b in zip(P._each(lower, k), aggregate.lower or [None] * k)]
    high = [a if a is not None else b for a, b in zip(P._each(upper, k), aggregate.upper or [None] * k)]
    if None in low or None in high:
        raise PrivacyError("the snapping mechanism needs lower and upper")
    return _noisy(aggregate, "Snapping", paid, [lambda x, s=s, u=u, a=a, b=b: N.snapping(float(x), s, u.epsilon, float(a), float(b), rng, binding_probability) for s, u, a, b in zip(sens, used, low, high)], sensitivity=sens, epsilon=[u.epsilon for u in used], lower=low, upper=high)


def exponential_mechanism(utilities: Aggregate, usage, candidates: Sequence | None = None, sensitivity=None, rng: N.Secure | None = None) -> Noisy:
    """One of the candidates of each column (a value of one column, else a list). The utilities of a column are one choice, so they share one budget."""
    own = list(utilities.candidates or ())
    options = [list(c) for c in own] if own and isinstance(own[0], tuple) else [own]
    if candidates is not None:
        options = [list(c) for c in candidates] if isinstance(candidates[0], (list, tuple)) else [list(candidates)] * len(options)
    rng = _rng(utilities.frame, rng)
    paid, used, sens = _plan(replace(utilities, joint=False), usage, sensitivity, 0, len(options))

    def draw(u: list) -> object:
        if len(u) != sum(map(len, options)):
            raise PrivacyError("there must be a utility for each candidate")
        rest, out = iter(u), []
        for o, s, b in zip(options, sens, used):
            out.append(N.exponential([next(rest) for _ in o], o, s, b.epsilon, rng))
        return out if len(out) > 1 else out[0]

    return Noisy(utilities.name, [(utilities, draw)], paid, mechanism="Exponential", arguments={"sensitivity": sens, "candidates": options if len(options) > 1 else options[0]})


def dp_gumbel_median(frame: PrivateFrame, column: Sequence[str] | str, usage, lower, upper, rng: N.Secure | None = None, enforce_constant_time: bool | None = None) -> Noisy:
    """The median of a column (or of each of several) by the exponential mechanism over the gaps between sorted values: the gap of the best ln(gap) - (epsilon / 2) * |rank distance| plus Gumbel noise, then a uniform draw within it.

    The gap with the best noisy score is a gap drawn with probability in proportion to exp(score), and so it is drawn: by
    ranks.drawn_gap, with all randomness from the driver's source and none in the cluster. In constant time (by default where
    the definition protects elapsed time) the number of jobs and of random bits is the same whatever the data are.
    """
    names = [column] if isinstance(column, str) else list(column)
    low, high = P._each(lower, len(names)), P._each(upper, len(names))
    if any(a is None or b is None or not a < b for a, b in zip(low, high)):
        raise PrivacyError("lower must be below upper")
    frame.numeric(names, "gumbel median", null=True)
    constant = frame.definition.protect_elapsed_time if enforce_constant_time is None else enforce_constant_time
    rng = _rng(frame, rng)
    if constant and not rng.testing:
        rng = N.Secure(True)
    paid = [as_usage(u) for u in usage] if isinstance(usage, list) else as_usage(usage).spread(len(names))
    if len(paid) != len(names):
        raise PrivacyError(f"{len(names)} columns need one budget or {len(names)}")
    used = [effective(u.check(frame.n, frame.definition.strict), frame.stability, frame.definition.group_size, frame.sample).epsilon for u in paid]
    keys = [k.name for k in frame.keys]

    def gap(a: float, b: float, epsilon: float):
        def look(first: list[R.Cell]) -> R.Asking:
            found = yield from R.drawn_gap(first, float(a), float(b), epsilon, rng)
            return rng.uniform(*found)

        return look

    def direct() -> dict:
        every = dense_keys(frame)
        out: dict = {key: [] for key in every}
        for n, a, b, epsilon in zip(names, low, high, used):
            def look(first: list[R.Cell], a=float(a), b=float(b), epsilon=epsilon) -> R.Asking:
                found = yield from R.constant_gap(first, a, b, epsilon, rng, len(every))
                return rng.uniform(*found)

            with fixed_plans(frame.df.sparkSession):
                found = R.ask(frame.df, [(R.on_grid(F.col(n), a, b), (0.0, float(R.GRID)))], keys, every, [(0, look)])[0]
            for key in every:
                out[key].append(found[key])
        return out

    orders = () if constant else tuple(Order(n, (float(a), float(b)), gap(a, b, e)) for n, a, b, e in zip(names, low, high, used))
    chosen = Aggregate(frame, "gumbel_median", lambda c: [], list, lambda _: [0.0] * len(names), direct=direct if constant else None, orders=orders, columns=tuple(names), lower=list(low), upper=list(high))
    return Noisy("dp_gumbel_median", [(chosen, (lambda v: v) if len(names) > 1 else (lambda v: v[0]))], paid, mechanism="Gumbel", arguments={"lower": lower, "upper": upper})


# ---------------------------------------------------------------- private statistics


def _mechanism(aggregate: Aggregate, name: str, usage, lower=None, upper=None, rng=None) -> Noisy:
    name = name.lower()
    if name == "automatic":
        name = "simplegeometric" if aggregate.kind == "int" else "snapping" if aggregate.frame.definition.protect_floating_point else "laplace"
    if name == "laplace":
        return laplace_mechanism(aggregate, usage, rng=rng)
    if name in ("gaussian", "analyticgaussian"):
        return gaussian_mechanism(aggregate, usage, analytic=name != "gaussian", rng=rng)
    if name == "snapping":
        return snapping_mechanism(aggregate, usage, lower, upper, rng=rng)
    if name == "simplegeometric":
        return simple_geometric_mechanism(aggregate, usage, lower, upper, rng=rng)
    raise PrivacyError(f"unknown mechanism {name}")


def _as(name: str, x: Noisy, **arguments) -> Noisy:
    x.name, x.arguments = name, x.arguments | arguments
    return x


def dp_count(frame: PrivateFrame, usage, columns=None, distinct: bool = False, lower=0, upper=None, mechanism: str = "SimpleGeometric", rng=None) -> Noisy:
    upper = upper if upper is not None else frame.n
    if upper is None and mechanism.lower() in ("simplegeometric", "snapping"):
        raise PrivacyError("dp_count needs upper while the number of records is unknown")
    return _as("dp_count", _mechanism(A.count(frame, columns, distinct), mechanism, usage, lower, upper, rng), distinct=distinct)


def dp_sum(frame: PrivateFrame, usage, columns=None, lower=None, upper=None, mechanism: str = "Automatic", rng=None) -> Noisy:
    return _as("dp_sum", _mechanism(A.sum_(frame, columns), mechanism, usage, lower, upper, rng))


def dp_mean(frame: PrivateFrame, usage, columns=None, lower=None, upper=None, implementation: str = "resize", mechanism: str = "Automatic", count_upper: int | None = None, rng=None) -> Noisy:
    """resize: the mean of a known number of records. plug-in: a private sum over a private count of at least one."""
    if implementation == "resize":
        return _as("dp_mean", _mechanism(A.mean(frame, columns), mechanism, usage, lower, upper, rng), implementation=implementation)
    if implementation != "plug-in":
        raise PrivacyError(f"unknown implementation {implementation}")
    names = P._names(frame, columns)
    k, whole = len(names), as_usage(usage)
    kind = "laplace" if not frame.definition.protect_floating_point and mechanism.lower() == "automatic" else mechanism
    bound = count_upper if count_upper is not None else frame.n
    counts = dp_count(frame, whole * (1 / (k + 1)), upper=bound, mechanism="laplace" if kind == "laplace" else "SimpleGeometric", rng=rng)
    totals = A.sum_(frame, names)
    low = [bound * frame.of(c).lower for c in names] if bound else None
    high = [bound * frame.of(c).upper for c in names] if bound else None
    sums = _mechanism(totals, kind, whole * (k / (k + 1)), low, high, rng)
    return Noisy("dp_mean", counts.parts + sums.parts, counts.usages + sums.usages, lambda v: [s / max(v[0][0], 1) for s in v[1]], sums.mechanism, {"implementation": implementation})


def dp_variance(frame: PrivateFrame, usage, columns=None, lower=None, upper=None, mechanism: str = "Automatic", finite_sample_correction: bool = True, rng=None) -> Noisy:
    return _as("dp_variance", _mechanism(A.variance(frame, columns, finite_sample_correction), mechanism, usage, lower, upper, rng))


def dp_covariance(frame: PrivateFrame, usage, columns=None, left=None, right=None, lower=None, upper=None, mechanism: str = "Automatic", finite_sample_correction: bool = True, rng=None) -> Noisy:
    """A covariance matrix: symmetric of columns, or left by right."""
    x = _as("dp_covariance", _mechanism(A.covariance(frame, columns, left, right, finite_sample_correction), mechanism, usage, lower, upper, rng))
    if left is not None:
        shape, symmetric = (len(P._names(frame, left)), len(P._names(frame, right))), False
    else:
        shape, symmetric = (len(P._names(frame, columns)),) * 2, True
    x.combine = lambda v: reshape(np.array(v[0]), shape, symmetric)
    return x


def dp_raw_moment(frame: PrivateFrame, usage, columns=None, order: int = 1, lower=None, upper=None, mechanism: str = "Automatic", rng=None) -> Noisy:
    return _as("dp_raw_moment", _mechanism(A.raw_moment(frame, columns, order), mechanism, usage, lower, upper, rng), order=order)


def dp_quantile(frame: PrivateFrame, usage, columns=None, alpha: float = 0.5, candidates=None, lower=None, upper=None, mechanism: str = "Automatic", interpolation: str = "midpoint", rng=None, missing: str = "refuse") -> Noisy:
    kind = mechanism.lower()
    if kind == "automatic":
        kind = "exponential" if candidates is not None else "automatic"
    if kind == "exponential":
        if candidates is None:
            raise PrivacyError("the exponential mechanism needs candidates")
        return _as("dp_quantile", exponential_mechanism(A.quantile(frame, columns, alpha, candidates=candidates, missing=missing), usage, rng=rng), alpha=alpha)
    return _as("dp_quantile", _mechanism(A.quantile(frame, columns, alpha, interpolation), kind, usage, lower, upper, rng), alpha=alpha, interpolation=interpolation)


def dp_median(frame: PrivateFrame, usage, columns=None, candidates=None, lower=None, upper=None, mechanism: str = "Automatic", interpolation: str = "midpoint", rng=None) -> Noisy:
    if mechanism.lower() == "gumbel":
        return _as("dp_median", dp_gumbel_median(frame, P._names(frame, columns), usage, lower, upper, rng))
    return _as("dp_median", dp_quantile(frame, usage, columns, 0.5, candidates, lower, upper, mechanism, interpolation, rng))


def dp_minimum(frame: PrivateFrame, usage, columns=None, candidates=None, lower=None, upper=None, mechanism: str = "Automatic", rng=None) -> Noisy:
    return _as("dp_minimum", dp_quantile(frame, usage, columns, 0.0, candidates, lower, upper, mechanism, "lower", rng))


def dp_maximum(frame: PrivateFrame, usage, columns=None, candidates=None, lower=None, upper=None, mechanism: str = "Automatic", rng=None) -> Noisy:
    return _as("dp_maximum", dp_quantile(frame, usage, columns, 1.0, candidates, lower, upper, mechanism, "upper", rng))


def dp_histogram(frame: PrivateFrame, usage, column: str, edges=None, categories=None, null_value=None, lower=0, upper=None, inclusive_left: bool = True, mechanism: str = "SimpleGeometric", rng=None) -> Noisy:
    """Counts of all categories. An individual is in one category, so every count may use the whole budget (two counts move under substitution, which the sensitivity holds)."""
    x = A.histogram(frame, column, edges, categories, null_value, inclusive_left)
    upper = upper if upper is not None else frame.n
    if upper is None and mechanism.lower() in ("simplegeometric", "snapping"):
        raise PrivacyError("dp_histogram needs upper while the number of records is unknown")
    return _as("dp_histogram", _mechanism(x, mechanism, usage, lower, upper, rng), categories=list(x.candidates))


def dp_linear_regression(frame: PrivateFrame, usage, data_x: str, data_y: str, lower_slope: float, upper_slope: float, lower_intercept: float, upper_intercept: float, implementation: str = "theil-sen-k-match", k: int = 100, rng=None) -> Noisy:
    """Slope and intercept: the Gumbel medians of Theil-Sen candidates, half the budget each.

    The candidates of a matching are made from written points and counted in the same tasks, and both medians narrow them
    in the same rounds. With theil-sen the candidates are the lines through all pairs; they are never formed. An intercept is
    then the slope of the points (1 / x, y / x), so x must be known to keep away from zero. Pairs of equal x are left out.
    """
    half = as_usage(usage) * 0.5
    if implementation == "theil-sen":
        slope, intercept = _all_pairs(frame, half, data_x, data_y, ((lower_slope, upper_slope), (lower_intercept, upper_intercept)), rng)
        return Noisy("dp_linear_regression", slope.parts + intercept.parts, slope.usages + intercept.usages, list, "Gumbel", {"implementation": implementation})
    lines = A.theil_sen(frame, data_x, data_y, implementation, k, rng)
    slope = dp_gumbel_median(lines, "slope", half, lower_slope, upper_slope, rng)
    intercept = dp_gumbel_median(lines, "intercept", half, lower_intercept, upper_intercept, rng)
    return Noisy("dp_linear_regression", slope.parts + intercept.parts, slope.usages + intercept.usages, list, "Gumbel", {"implementation": implementation, "k": k})


def _all_pairs(frame: PrivateFrame, half: Usage, data_x: str, data_y: str, bounds: Sequence[tuple[float, float]], rng: N.Secure | None) -> list[Noisy]:
    """Gumbel medians of slopes and of intercepts of all pairs; an individual's row is in n - 1 of them."""
    x_props, _ = frame.numeric([data_x, data_y], "theil_sen")
    low, high = x_props.bounds
    if frame.n is None or frame.n < 2 or frame.keys:
        raise PrivacyError("all pairs need a known number of records, and rows that are not parted")
    if low <= 0 <= high:
        raise PrivacyError(f"intercepts of all pairs need bounds of {data_x} on one side of zero")
    if frame.definition.protect_elapsed_time:
        raise PrivacyError("all pairs are not narrowed in constant time; use theil-sen-k-match")
    rng = _rng(frame, rng)
    lines = frame.new_rows(frame.df, n=None, stability=frame.stability * (frame.n - 1))
    x, y = F.col(data_x).cast("double"), F.col(data_y).cast("double")
    out = []
    for points, (lower, upper) in zip(((x, y), (1 / x, y / x)), bounds):
        if not lower < upper:
            raise PrivacyError("lower must be below upper")
        epsilon = effective(half.check(frame.n, frame.definition.strict), lines.stability, frame.definition.group_size, frame.sample).epsilon

        def direct(points=points, lower=float(lower), upper=float(upper), epsilon=epsilon) -> dict:
            slopes = Slopes(frame.df, *points)
            found = slopes.ask(lambda first: R.drawn_gap(first, lower, upper, epsilon, rng, slopes.total, at_once=4), (lower, upper))
            return {(): [rng.uniform(*found)]}

        chosen = Aggregate(lines, "gumbel_median", lambda c: [], list, lambda _: [0.0], direct=direct, columns=(data_x, data_y), lower=[lower], upper=[upper])
        out.append(Noisy("dp_gumbel_median", [(chosen, lambda v: v[0])], [half], mechanism="Gumbel", arguments={"lower": lower, "upper": upper}))
    return out


def noisy_stats_regression(frame: PrivateFrame, usage, data_x: str, data_y: str, rng: N.Secure | None = None) -> Noisy:
    """A line by noisy sufficient statistics of columns within [0, 1]; returns its values at 0.25 and 0.75 (NaN if the noisy variance isn't positive)."""
    for c in (data_x, data_y):
        if frame.of(c).bounds != (0.0, 1.0):
            raise PrivacyError("both columns must be clamped to [0, 1]")
    if frame.n is None:
        raise PrivacyError("the number of records must be known")
    _no_floats(frame, "Laplace")
    rng = _rng(frame, rng)
    paid = as_usage(usage).check(frame.n, frame.definition.strict)
    epsilon = effective(paid, frame.stability, frame.definition.group_size, frame.sample).epsilon
    n = frame.n
    stats = A._aggregate(frame, "noisy_stats", lambda c: [F.covar_pop(c(data_x), c(data_y)) * n, F.var_pop(c(data_x)) * n, F.avg(c(data_x)), F.avg(c(data_y))], lambda _: [1 - 1 / n] * 4, [data_x, data_y])

    def draw(v: list) -> list[float]:
        scale = 3 * (1 - 1 / n) / epsilon
        cov, var = v[0] + N.laplace_quantile(rng.uniform(), scale), v[1] + N.laplace_quantile(rng.uniform(), scale)
        if var <= 0:
            return [math.nan, math.nan]
        slope = cov / var
        intercept = v[3] - slope * v[2] + N.laplace_quantile(rng.uniform(), 3 / n * (1 + abs(slope)) / epsilon)
        return [slope * 0.25 + intercept, slope * 0.75 + intercept]

    return Noisy("noisy_stats_regression", [(stats, draw)], [paid], mechanism="Laplace")
