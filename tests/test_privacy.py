import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from hushframe.functions import intervals as I
from hushframe.operators import accuracy as A
from hushframe.operators import noise as N
from hushframe.operators import sensitivity as S
from hushframe.operators.structure import even_lengths, reshape
from hushframe.privacy import SUBSTITUTE, Definition, Ledger, PrivacyError, Usage, actual, as_usage, effective, parallel, sequential


@given(st.floats(0.01, 3), st.floats(0, 1e-4), st.integers(1, 5), st.integers(1, 3), st.floats(0.05, 1))
def test_actual_undoes_effective(epsilon, delta, c, g, s):
    u = actual(effective(Usage(epsilon, delta), c, g, s), c, g, s)
    assert math.isclose(u.epsilon, epsilon, rel_tol=1e-9) and math.isclose(u.delta, delta, rel_tol=1e-9, abs_tol=1e-18)


def test_effective_leaves_plain_budgets_alone():
    u = effective(Usage(0.1, 1e-6))
    assert math.isclose(u.epsilon, 0.1) and math.isclose(u.delta, 1e-6)


def test_checks():
    for bad in (Usage(0), Usage(-1), Usage(1, 1.0), Usage(1, -0.1), Usage(math.inf)):
        with pytest.raises(PrivacyError):
            bad.check()
    with pytest.raises(PrivacyError):
        Usage(1, 0.1).check(11)
    with pytest.raises(PrivacyError):
        Usage(0.5, 1e-9).check(None, strict=True)
    with pytest.warns(UserWarning):
        Usage(2.0).check(10, strict=True)
    with pytest.raises(PrivacyError):
        Definition(group_size=0)
    assert as_usage({"epsilon": 1}) == as_usage(1.0) == as_usage((1.0,)) == Usage(1.0)


def test_composition_and_ledger():
    u, v = Usage(0.5, 1e-6), Usage(0.25)
    assert sequential([u, v]) == Usage(0.75, 1e-6) and parallel([u, v]) == u
    ledger = Ledger(Usage(1.0))
    ledger.spend("a", Usage(0.6))
    with pytest.raises(PrivacyError):
        ledger.spend("b", Usage(0.6))
    ledger.spend("c", Usage(0.4), 1)
    assert ledger.by_submission() == {0: Usage(0.6), 1: Usage(0.4)}


def test_sensitivities():
    assert S.count(None, "add_remove") == 1 and S.count(5, "add_remove") == 0 and S.count(5, "add_remove", distinct=True) == 1
    assert S.total((-3, 2), "add_remove") == 3 and S.total((-3, 2), SUBSTITUTE) == 5
    assert S.raw_moment((10, 11), 2, 1, SUBSTITUTE) == 21 and S.raw_moment((-2, 1), 2, 4, SUBSTITUTE) == 1
    with pytest.raises(PrivacyError):
        S.mean((0, 1), None, SUBSTITUTE)


def test_sigmas_and_accuracies():
    assert round(N.analytic_sigma(1, 1, 1e-5), 5) == 3.73063
    assert round(N.gaussian_sigma(1, 1, 1e-5, analytic=False), 5) == 4.84481
    assert round(A.laplace(1, 0.5, 0.05), 4) == 5.9915 and A.geometric(1, 0.5, 0.05) == 6
    for kind, args in ((A.laplace_usage, (1, 3.0, 0.05)),):
        assert math.isclose(A.laplace(1, kind(*args).epsilon, 0.05), 3.0)
    u = A.snapping_usage(1.0, 5.0, 0.05, 0.0, 100.0)
    assert A.snapping(1.0, u.epsilon, 0.05, 0.0, 100.0) <= 5.0
    g = A.gaussian_usage(1.0, 5.0, 1e-5, 0.05, analytic=True)
    assert math.isclose(A.gaussian(1.0, g.epsilon, 1e-5, 0.05), 5.0, rel_tol=1e-6)


def test_noise_distributions():
    rng, n = N.Secure(), 20000
    assert abs(sum(rng.bernoulli(0.3) for _ in range(n)) / n - 0.3) < 0.02
    assert abs(sum(N.laplace(0.0, 1.0, 1.0, rng) for _ in range(n)) / n) < 0.08
    assert abs(sum(N.gumbel(rng) for _ in range(n)) / n - 0.5772) < 0.08
    draws = [N.simple_geometric(5, 1.0, 0.7, 0, 10, rng) for _ in range(n)]
    assert min(draws) >= 0 and max(draws) <= 10
    alpha = math.exp(-0.7)
    assert abs(draws.count(5) / n - (1 - alpha) / (1 + alpha)) < 0.02
    assert {rng.integer(3, 5) for _ in range(200)} == {3, 4, 5}


def test_snapping():
    rng = N.Secure()
    for _ in range(100):
        x = N.snapping(50, 1 / 1000, 1, -50, 150, rng)
        assert -50 <= x <= 150
    assert [N.nearest_multiple(x, 0.5) for x in (-30.01, 0.25, -0.25, 0.74)] == [-30.0, 0.5, -0.5, 0.5]
    assert N.snapping(3.0, 0.0, 1.0, 0.0, 2.0, rng) == 2.0
    inner, grid = N.snapping_parameters(0.5, 10.0)
    assert grid == 2.0 and inner <= 0.5


def test_exponential():
    assert N.exponential_weights([0.0, 0.0], 1, 1) == [0.5, 0.5]
    assert N.exponential([0.0, 900.0], ["a", "b"], 1.0, 1.0, N.Secure()) == "b"
    with pytest.raises(PrivacyError):
        N.exponential([1.0], ["a", "b"], 1, 1, N.Secure())


def test_zero_sensitivity_is_exact():
    rng = N.Secure()
    assert N.laplace(4.0, 0.0, 1.0, rng) == 4.0 and N.simple_geometric(4, 0.0, 1.0, 0, 9, rng) == 4 and N.gaussian(4.0, 0.0, 1.0, 1e-6, rng) == 4.0


@given(*[st.floats(-50, 50)] * 2, st.floats(0, 20), st.floats(0, 20), st.floats(0, 1), st.floats(0, 1))
def test_intervals_hold_values(a, c, w, z, p, q):
    x, y = (a, a + w), (c, c + z)
    u, v = a + w * p, c + z * q
    for f, value in ((I.add, u + v), (I.subtract, u - v), (I.multiply, u * v), (I.row_max, max(u, v)), (I.row_min, min(u, v))):
        low, high = f(x, y)
        assert low - 1e-6 <= value <= high + 1e-6
    low, high = I.absolute(x)
    assert low - 1e-9 <= abs(u) <= high + 1e-9


def test_even_split_and_reshape():
    assert [even_lengths(*x) for x in ((4, 3), (5, 3), (3, 3), (2, 3))] == [[2, 1, 1], [2, 2, 1], [1, 1, 1], [1, 1, 0]]
    assert reshape(range(10), (4, 4), symmetric=True).tolist() == [[0, 1, 2, 3], [1, 4, 5, 6], [2, 5, 7, 8], [3, 6, 8, 9]]
    with pytest.raises(PrivacyError):
        reshape(range(9), (4, 4), symmetric=True)
