"""Privacy definition, usage, composition rules and checks; plain Python on the driver."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable
from dataclasses import dataclass

ADD_REMOVE, SUBSTITUTE = "add_remove", "substitute"


class PrivacyError(ValueError):
    """A computation that cannot be shown to be private, or a budget that is no budget."""


@dataclass(frozen=True)
class Definition:
    """What is protected: how many individuals move together, how neighbours differ, and which side channels are closed.

    protect_overflow: sums of whole numbers are decimals of 38 digits, so that none fails or wraps. protect_elapsed_time:
    noise takes the same number of random bits or trials each time. protect_memory_utilization is kept for analyses that
    declare it; no operator's memory on the driver depends on the rows, and that of executors isn't hidden.
    """

    group_size: int = 1
    neighboring: str = ADD_REMOVE
    strict: bool = False
    protect_overflow: bool = False
    protect_elapsed_time: bool = False
    protect_memory_utilization: bool = False
    protect_floating_point: bool = True
    protect_sensitivity: bool = True

    def __post_init__(self) -> None:
        if self.group_size < 1:
            raise PrivacyError("group_size must be 1 or more")
        if self.neighboring not in (ADD_REMOVE, SUBSTITUTE):
            raise PrivacyError(f"unknown neighbouring definition: {self.neighboring}")


@dataclass(frozen=True)
class Usage:
    """An (epsilon, delta) budget."""

    epsilon: float
    delta: float = 0.0

    def __add__(self, other: Usage) -> Usage:
        return Usage(self.epsilon + other.epsilon, self.delta + other.delta)

    def __mul__(self, factor: float) -> Usage:
        return Usage(self.epsilon * factor, self.delta * factor)

    def check(self, n: int | None = None, strict: bool = False) -> Usage:
        if not self.epsilon > 0 or math.isinf(self.epsilon):
            raise PrivacyError("epsilon must be positive and finite")
        if not 0 <= self.delta < 1:
            raise PrivacyError("delta must be in [0, 1)")
        if n is not None and self.delta * n > 1:
            raise PrivacyError("delta must be below one over the number of records")
        if strict:
            if self.epsilon > 1:
                warnings.warn("epsilon over 1", stacklevel=2)
            if self.delta and n is None:
                raise PrivacyError("delta cannot be judged while the number of records is unknown")
            if self.delta and self.delta * n * n > 1:
                warnings.warn("delta over one over the square of the number of records", stacklevel=2)
        return self

    def spread(self, k: int) -> list[Usage]:
        """Equal parts for k columns."""
        return [Usage(self.epsilon / k, self.delta / k)] * k


def as_usage(x: Usage | float | tuple | dict) -> Usage:
    if isinstance(x, Usage):
        return x
    if isinstance(x, dict):
        return Usage(float(x["epsilon"]), float(x.get("delta", 0.0)))
    return Usage(*map(float, x)) if isinstance(x, (tuple, list)) else Usage(float(x))


def _group(epsilon: float, c: int) -> float:
    """The sum of e^(i epsilon) for i below c; infinite where no number holds it."""
    if c <= 64:
        return sum(math.exp(i * epsilon) for i in range(c))
    return math.expm1(c * epsilon) / math.expm1(epsilon) if c * epsilon < 700 else math.inf


def effective(actual: Usage, stability: int = 1, group_size: int = 1, sample: float = 1.0) -> Usage:
    """The budget a mechanism may use so that actual is what an individual pays.

    epsilon' = ln((e^epsilon - 1) / s + 1) / c and delta' = delta / (s * sum of e^(i epsilon) for i below c), where c is the
    number of rows an individual (or group) may move and s the sampling rate.
    """
    c = stability * group_size
    epsilon = math.log(math.expm1(actual.epsilon) / sample + 1) / c
    return Usage(epsilon, actual.delta / (sample * _group(actual.epsilon, c)) if actual.delta else 0.0)


def actual(used: Usage, stability: int = 1, group_size: int = 1, sample: float = 1.0) -> Usage:
    """What an individual pays for a budget a mechanism used; the inverse of effective()."""
    c = stability * group_size
    epsilon = math.log1p(sample * math.expm1(c * used.epsilon))
    return Usage(epsilon, used.delta * sample * _group(epsilon, c) if used.delta else 0.0)


def sequential(usages: Iterable[Usage]) -> Usage:
    """Releases over the same rows: budgets add up."""
    return sum(usages, Usage(0.0, 0.0))


def parallel(usages: Iterable[Usage]) -> Usage:
    """Releases over the parts of a partition: the largest counts."""
    usages = list(usages)
    return Usage(max((u.epsilon for u in usages), default=0.0), max((u.delta for u in usages), default=0.0))


#: The part of a partition that stands for each of them.
EVERY = object()
#: Where rows are: parts (partition's number, key) from the whole data down; () is the whole data.
Path = tuple[tuple[int, object], ...]
Charge = tuple[Path, Usage]


class Losses:
    """Sums over the releases that an individual is in, by which sequences of releases are judged: of epsilon, delta, -ln(1 - delta), expected loss and squared epsilon."""

    def __init__(self, values: tuple[float, ...] = (0.0,) * 5):
        self.values = values

    @classmethod
    def of(cls, u: Usage) -> Losses:
        return cls((u.epsilon, u.delta, -math.log1p(-min(u.delta, 1 - 1e-16)), u.epsilon * math.tanh(u.epsilon / 2), u.epsilon**2))

    def __add__(self, other: Losses) -> Losses:
        return Losses(tuple(map(sum, zip(self.values, other.values))))

    @classmethod
    def worst(cls, parts: Iterable[Losses]) -> Losses:
        """Bounds on an individual who is in one of some parts, whichever it is."""
        return cls(tuple(map(max, zip(cls().values, *[p.values for p in parts]))))

    def basic(self) -> Usage:
        return Usage(self.values[0], self.values[1])

    def advanced(self, slack: float) -> Usage:
        """The better of plain sums and of the bounds on sequences of different releases by Kairouz, Oh and Viswanath (2015); slack is added to delta if it is used."""
        epsilon, _, spared, expected, squares = self.values
        if not 0 < slack < 1:
            raise PrivacyError("the slack lies between 0 and 1")
        tails = (math.log(1 / slack), math.log(math.e + math.sqrt(squares) / slack))
        best = expected + math.sqrt(2 * squares * min(tails))
        return Usage(best, -math.expm1(math.log1p(-slack) - spared)) if best < epsilon else self.basic()


def losses(charges: Iterable[Charge]) -> Losses:
    """What an individual loses by releases on parts of the data.

    Paths make a tree. Releases on one path add up, and so do those on parts of different partitions and those on what holds
    a part; of the parts of one partition an individual is in one, so there the worst counts.
    """
    here, groups = Losses(), {}
    for path, usage in charges:
        if path:
            (partition, key), *rest = path
            groups.setdefault(partition, {}).setdefault(key, []).append((tuple(rest), usage))
        else:
            here = here + Losses.of(usage)
    for parts in groups.values():
        here = here + losses(parts.pop(EVERY, [])) + Losses.worst(map(losses, parts.values()))
    return here


def composed(charges: Iterable[Charge], slack: float | None = None) -> Usage:
    """The budget of releases on parts of the data: plain sums and maxima, or with a slack in delta the better of these and advanced composition."""
    found = losses(charges)
    return found.basic() if slack is None else found.advanced(slack)


def each_of(total: Usage, k: int, slack: float) -> Usage:
    """What each of k equal releases may cost so that all of them together stay within a total, by the better of both rules (found by bisection)."""
    if k < 1:
        raise PrivacyError("there must be a release")
    if total.delta <= slack:
        return total * (1 / k)
    delta = -math.expm1((math.log1p(-total.delta) - math.log1p(-slack)) / k)
    low, high = total.epsilon / k, total.epsilon
    for _ in range(200):
        middle = (low + high) / 2
        fits = composed([((), Usage(middle, delta))] * k, slack)
        low, high = (middle, high) if fits.epsilon <= total.epsilon and fits.delta <= total.delta * (1 + 1e-12) else (low, middle)
    return Usage(low, delta) if low > total.epsilon / k else total * (1 / k)


def common(paths: Iterable[Path]) -> Path:
    """The longest path that all of some begin with."""
    paths, out = list(paths), []
    for steps in zip(*paths):
        if any(s != steps[0] for s in steps):
            break
        out.append(steps[0])
    return tuple(out)


class Ledger:
    """What was spent, by submission and by the part of the data; refuses a release that would exceed its limit.

    Submissions add up. With a slack, the releases of a submission are judged by advanced composition where that is better.
    """

    def __init__(self, limit: Usage | None = None, slack: float | None = None):
        self.limit, self.slack = limit, slack
        self.entries: list[tuple[int, str, Usage, Path]] = []

    def _total(self, entries: list[tuple[int, str, Usage, Path]]) -> Usage:
        return sequential(composed([(path, u) for t, _, u, path in entries if t == s], self.slack) for s in sorted({e[0] for e in entries}))

    @property
    def spent(self) -> Usage:
        return self._total(self.entries)

    def spend(self, name: str, usage: Usage, submission: int = 0, path: Path = ()) -> None:
        self.spend_all([(name, usage, path)], submission)

    def spend_all(self, costs: list[tuple[str, Usage, Path]], submission: int = 0) -> None:
        """All of some releases, or none of them."""
        after = self.entries + [(submission, *c) for c in costs]
        total = self._total(after)
        if self.limit and (total.epsilon > self.limit.epsilon * (1 + 1e-12) or total.delta > self.limit.delta * (1 + 1e-12)):
            raise PrivacyError(f"{', '.join(c[0] for c in costs)} would take the budget to {total}, over {self.limit}")
        self.entries = after

    def of(self, name: str) -> Usage:
        """What was spent under a name."""
        return self._total([e for e in self.entries if e[1] == name])

    def by_submission(self) -> dict[int, Usage]:
        return {s: self._total([e for e in self.entries if e[0] == s]) for s in sorted({e[0] for e in self.entries})}
