"""Randomness and mechanisms, on the driver: noise is drawn once, on values that no longer depend on the cluster."""

from __future__ import annotations

import hashlib
import math
import secrets
from collections.abc import Sequence
from decimal import Decimal, localcontext

from hushframe.privacy import PrivacyError

#: Heads in a row after which an exponent isn't followed further.
EXPONENT_CAP = 1022
#: Digits for logarithms in the snapping mechanism (118 bits are 35.5 digits), and its least precision in bits.
DIGITS, SNAPPING_BITS = 48, 118


class Secure:
    """Draws from the operating system's generator. constant_time: a uniform draw takes the same number of bits each time."""

    testing = False

    def __init__(self, constant_time: bool = False):
        self.constant_time = constant_time

    def bits(self, n: int) -> int:
        return secrets.randbits(n)

    def leading_zeros(self) -> int:
        """Zeros before the first one in fair bits, EXPONENT_CAP at most."""
        if self.constant_time:
            return min(EXPONENT_CAP + 2 - self.bits(EXPONENT_CAP + 2).bit_length(), EXPONENT_CAP)
        count = 0
        while count < EXPONENT_CAP:
            x = self.bits(64)
            if x:
                return min(count + 64 - x.bit_length(), EXPONENT_CAP)
            count += 64
        return EXPONENT_CAP

    def uniform(self, low: float = 0.0, high: float = 1.0) -> float:
        """A double of (0, 1) with all its mantissa bits random at any exponent, scaled."""
        u = math.ldexp(1 + self.bits(52) / 2**52, -(1 + self.leading_zeros()))
        return low + (high - low) * u

    def integer(self, low: int, high: int) -> int:
        """Of low .. high, each equally likely, by rejection."""
        span = high - low + 1
        n = max(1, (span - 1).bit_length())
        while (x := self.bits(n)) >= span:
            pass
        return low + x

    def bernoulli(self, p: float) -> bool:
        """True with probability exactly p: the bit of p's binary expansion at a geometric place."""
        if not 0 <= p <= 1:
            raise PrivacyError("a probability lies between 0 and 1")
        if p in (0.0, 1.0):
            return p == 1.0
        numerator, denominator = p.as_integer_ratio()
        at = self.leading_zeros() + 1  # the first place is worth a half
        return bool((numerator << at) // denominator & 1)


class Seeded(Secure):
    """A repeatable source for tests: the i-th number is the md5 of seed and i. Refused where floating-point protection is on."""

    testing = True

    def __init__(self, seed: str):
        super().__init__()
        self.seed, self.count = seed, 0

    def uniform(self, low: float = 0.0, high: float = 1.0) -> float:
        u = (int(hashlib.md5(f"{self.seed}|{self.count}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        self.count += 1
        return low + (high - low) * u

    def bits(self, n: int) -> int:
        out = 0
        for _ in range(-(-n // 64)):
            out = out << 64 | int(hashlib.md5(f"{self.seed}|{self.count}".encode()).hexdigest()[:16], 16)
            self.count += 1
        return out >> -n % 64


def _positive(sensitivity: float, epsilon: float) -> None:
    if sensitivity < 0 or math.isnan(sensitivity):
        raise PrivacyError("a sensitivity cannot be negative")
    if not epsilon > 0:
        raise PrivacyError("epsilon must be positive")


def laplace_quantile(u: float, scale: float) -> float:
    return -scale * math.copysign(1.0, u - 0.5) * math.log1p(-2 * abs(u - 0.5)) if u != 0.5 else 0.0


def laplace(value: float, sensitivity: float, epsilon: float, rng: Secure) -> float:
    _positive(sensitivity, epsilon)
    return value + laplace_quantile(rng.uniform(), sensitivity / epsilon) if sensitivity else value


def _phi(t: float) -> float:
    return 0.5 * math.erfc(-t / math.sqrt(2))


def analytic_sigma(sensitivity: float, epsilon: float, delta: float) -> float:
    """The least standard deviation of Gaussian noise for (epsilon, delta), after Balle and Wang (2018)."""
    def upper(v: float) -> float:
        return _phi(math.sqrt(epsilon * v)) - math.exp(epsilon) * _phi(-math.sqrt(epsilon * (v + 2)))

    def lower(v: float) -> float:
        return _phi(-math.sqrt(epsilon * v)) - math.exp(epsilon) * _phi(-math.sqrt(epsilon * (v + 2)))

    at_zero = upper(0.0)
    if delta == at_zero:
        alpha = 1.0
    else:
        rises = delta > at_zero
        good = (lambda v: upper(v) >= delta) if rises else (lambda v: lower(v) <= delta)
        hi = 1.0
        while not good(hi):
            hi *= 2
        lo = 0.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if good(mid) else (mid, hi)
        v = lo if rises else hi  # the side that keeps within delta
        alpha = math.sqrt(1 + v / 2) + (-1 if rises else 1) * math.sqrt(v / 2)
    return alpha * sensitivity / math.sqrt(2 * epsilon)


def gaussian_sigma(sensitivity: float, epsilon: float, delta: float, analytic: bool = True) -> float:
    _positive(sensitivity, epsilon)
    if not 0 < delta < 1:
        raise PrivacyError("Gaussian noise needs a delta above 0 and below 1")
    if analytic:
        return analytic_sigma(sensitivity, epsilon, delta)
    if epsilon > 1:
        raise PrivacyError("the classic Gaussian mechanism holds for an epsilon of at most 1")
    return sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / epsilon


def standard_normal(rng: Secure) -> float:
    return math.sqrt(-2 * math.log(rng.uniform())) * math.cos(2 * math.pi * rng.uniform())


def gaussian(value: float, sensitivity: float, epsilon: float, delta: float, rng: Secure, analytic: bool = True) -> float:
    sigma = gaussian_sigma(sensitivity, epsilon, delta, analytic)
    return value + sigma * standard_normal(rng) if sensitivity else value


def simple_geometric(value: int, sensitivity: float, epsilon: float, low: int, high: int, rng: Secure, constant_time: bool = False) -> int:
    """Two-sided geometric noise on an integer within bounds; the search for a success ends after high - low trials."""
    _positive(sensitivity, epsilon)
    if high < low:
        raise PrivacyError("lower must not exceed upper")
    value = min(max(int(value), low), high)
    if not sensitivity:
        return value
    alpha = math.exp(-epsilon / sensitivity)
    if rng.bernoulli((1 - alpha) / (1 + alpha)):
        return value
    sign = 1 if rng.bits(1) else -1
    if constant_time:
        if high - low > 10_000_000:
            raise PrivacyError("bounds are too far apart for constant time")
        found = [rng.bernoulli(1 - alpha) for _ in range(high - low)]
        size = found.index(True) + 1 if True in found else high - low
    else:
        size = 1
        while size < high - low and not rng.bernoulli(1 - alpha):
            size += 1
    return min(max(value + sign * size, low), high)


def snapping_parameters(epsilon: float, bound: float) -> tuple[float, float]:
    """Epsilon after the correction for rounding, and the grid: the least power of two that is at least one over it. bound: half the range, in sensitivities."""
    bits = max(SNAPPING_BITS, math.ceil(math.log2(epsilon)) + 2)
    eta = math.ldexp(1.0, -bits)
    inner = (epsilon - 2 * eta) / (1 + 12 * bound * eta)
    if inner <= 0:
        raise PrivacyError("epsilon is too small for the snapping mechanism")
    mantissa, exponent = math.frexp(1 / inner)
    return inner, math.ldexp(1.0, exponent - 1 if mantissa == 0.5 else exponent)


def nearest_multiple(x: float | Decimal, step: float) -> float:
    """x rounded to a multiple of step (a power of two), halves away from zero."""
    with localcontext() as c:
        c.prec = DIGITS * 8
        q = Decimal(x) / Decimal(step)
        return float(int(q.copy_abs() + Decimal("0.5")) * (-1 if q < 0 else 1) * Decimal(step))


def snapping(value: float, sensitivity: float, epsilon: float, low: float, high: float, rng: Secure, binding_probability: float | None = None) -> float:
    """Laplace noise in extended precision, snapped to a grid so that no low bits tell the value."""
    _positive(sensitivity, epsilon)
    if not low < high:
        raise PrivacyError("lower must be below upper")
    if not sensitivity:
        return min(max(value, low), high)
    middle, half = (low + high) / 2, (high - low) / 2
    bound = half / sensitivity
    inner, grid = snapping_parameters(epsilon, bound)
    if binding_probability is not None:
        if not 0 <= binding_probability < 1:
            raise PrivacyError("the binding probability lies in [0, 1)")
        bound += (1 - 2 * math.log(1 - binding_probability)) / inner
    with localcontext() as c:
        c.prec = DIGITS
        x = Decimal(min(max(value - middle, -half), half)) / Decimal(sensitivity)
        noise = Decimal(rng.uniform()).ln() / Decimal(inner)
        snapped = nearest_multiple(x + noise * (1 if rng.bits(1) else -1), grid)
    return min(max(snapped, -bound), bound) * sensitivity + middle


def exponential_weights(utilities: Sequence[float], sensitivity: float, epsilon: float) -> list[float]:
    _positive(sensitivity, epsilon)
    if not utilities:
        raise PrivacyError("there is no candidate")
    top = max(utilities)
    if not sensitivity:
        best = [float(u == top) for u in utilities]
        return [b / sum(best) for b in best]
    weights = [math.exp(epsilon * (u - top) / (2 * sensitivity)) for u in utilities]
    total = math.fsum(weights)
    return [w / total for w in weights]


def exponential(utilities: Sequence[float], candidates: Sequence, sensitivity: float, epsilon: float, rng: Secure):
    if len(utilities) != len(candidates):
        raise PrivacyError("there must be a utility for each candidate")
    u, reached = rng.uniform(), 0.0
    weights = exponential_weights(utilities, sensitivity, epsilon)
    for candidate, w in zip(candidates, weights):
        reached += w
        if u < reached:
            return candidate
    return candidates[max(i for i, w in enumerate(weights) if w)]


def gumbel(rng: Secure) -> float:
    return -math.log(-math.log(rng.uniform()))


def pick(categories: Sequence, rng: Secure, weights: Sequence[float] | None = None):
    """One of some categories, by weight."""
    p = [w / math.fsum(weights) for w in weights] if weights else [1 / len(categories)] * len(categories)
    u, reached = rng.uniform(), 0.0
    for c, w in zip(categories, p):
        reached += w
        if u < reached:
            return c
    return categories[-1]


#: Fair bits that are drawn at once.
BLOCK_BITS = 1 << 20


def heads(n: int, rng: Secure) -> int:
    """Ones among n fair bits."""
    return sum(rng.bits(min(BLOCK_BITS, n - at)).bit_count() for at in range(0, n, BLOCK_BITS))


def binomial(n: int, p: float, rng: Secure) -> int:
    """Successes in n trials of probability exactly p, from fair bits only.

    Each trial compares p's binary digits with fair bits until they differ, and all trials do so together: of those still
    equal, as many as show ones go one way and the others the other. About two bits a trial are drawn in all.
    """
    if not 0 <= p <= 1:
        raise PrivacyError("a probability lies between 0 and 1")
    numerator, denominator = p.as_integer_ratio()
    equal, found = n, 0
    while equal and numerator:
        numerator *= 2
        digit, numerator = (1, numerator - denominator) if numerator >= denominator else (0, numerator)
        if digit and not numerator and denominator == 1:  # p is one
            return n
        ones = heads(equal, rng)
        if digit:
            found, equal = found + equal - ones, ones  # a zero is below the digit
        else:
            equal -= ones  # a one is above it
    return found
