"""Accuracy at a confidence from a budget, and the budget for a wanted accuracy."""

from __future__ import annotations

import math
from statistics import NormalDist

from hushframe.operators.noise import gaussian_sigma, snapping_parameters
from hushframe.privacy import PrivacyError, Usage


def laplace(sensitivity: float, epsilon: float, alpha: float) -> float:
    return math.log(1 / alpha) * sensitivity / epsilon


def laplace_usage(sensitivity: float, accuracy: float, alpha: float) -> Usage:
    return Usage(math.log(1 / alpha) * sensitivity / accuracy)


def geometric(sensitivity: float, epsilon: float, alpha: float) -> float:
    return math.ceil(math.log(1 / alpha) * sensitivity / epsilon)


geometric_usage = laplace_usage


def gaussian(sensitivity: float, epsilon: float, delta: float, alpha: float, analytic: bool = True) -> float:
    return gaussian_sigma(sensitivity, epsilon, delta, analytic) * NormalDist().inv_cdf(1 - alpha / 2)


def gaussian_usage(sensitivity: float, accuracy: float, delta: float, alpha: float, analytic: bool = False) -> Usage:
    sigma = accuracy / NormalDist().inv_cdf(1 - alpha / 2)
    if not analytic:
        return Usage(sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / sigma, delta)
    low, high = 1e-9, 1e3
    for _ in range(200):
        middle = math.sqrt(low * high)
        low, high = (middle, high) if gaussian_sigma(sensitivity, middle, delta) > sigma else (low, middle)
    return Usage(high, delta)


def snapping(sensitivity: float, epsilon: float, alpha: float, low: float, high: float) -> float:
    inner, grid = snapping_parameters(epsilon, (high - low) / 2 / sensitivity)
    return (grid / 2 - math.log(alpha) / inner) * sensitivity


def snapping_usage(sensitivity: float, accuracy: float, alpha: float, low: float, high: float) -> Usage:
    a, b = 1e-9, 1e6
    if snapping(sensitivity, b, alpha, low, high) > accuracy:
        raise PrivacyError("no epsilon gives this accuracy")
    for _ in range(200):
        middle = math.sqrt(a * b)
        a, b = (middle, b) if snapping(sensitivity, middle, alpha, low, high) > accuracy else (a, middle)
    return Usage(b)
