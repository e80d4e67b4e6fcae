import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.operators import noise as N
from hushframe.operators import ranks as R
from hushframe.operators import slopes as S


def pairs(points):
    x, y = np.array(points, float).T
    i, j = np.triu_indices(len(x), 1)
    dx, dy = x[j] - x[i], y[j] - y[i]
    return np.sort(dy[dx != 0] / dx[dx != 0])


def made(spark, points):
    return S.Slopes(spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double").repartition(3), F.col("x"), F.col("y"))


def places(s, wanted):
    return s.ask(lambda first: R.at_places(first, lambda n: wanted))


@pytest.mark.parametrize("kind", ["smooth", "ties", "flat", "steep"])
def test_against_all_pairs(spark, monkeypatch, kind):
    """2,000 points, in many blocks, few of them left to list at the end."""
    r = np.random.default_rng(5)
    n = 2000
    x = r.normal(0, 10, n) if kind in ("smooth", "steep") else r.integers(0, 40, n)
    y = 3 * x + r.normal(0, 5, n) if kind == "smooth" else r.integers(0, 5, n) if kind == "ties" else np.full(n, 7.0) if kind == "flat" else np.exp(r.normal(0, 12, n))
    points = list(zip(x.tolist(), y.tolist()))
    monkeypatch.setattr(S, "LEAST", 200)
    monkeypatch.setattr(S, "LEAF_PAIRS", 5000)
    s, want = made(spark, points), pairs(points)
    assert s.total == len(want) and s.count >= 8
    asked = [len(want) // 2, len(want) // 2 + 1, len(want) // 10] + ([0, len(want) - 1] if kind == "ties" else [])
    n, got = places(s, asked)
    assert n == len(want) and all(math.isclose(got[p], want[p], rel_tol=1e-9, abs_tol=1e-12) for p in asked)


def test_few_points(spark):
    assert made(spark, [(1, 2)]).total == 0 and places(made(spark, [(1, 2), (1, 5)]), []) == (0, {})
    assert places(made(spark, [(1, 2), (3, 6)]), [0]) == (1, {0: 2.0})


def test_gaps_by_their_weight(spark):
    """A drawn gap of slopes, cut at thresholds, has the share of a gap of the sorted slopes."""
    r = np.random.default_rng(6)
    points = [(float(i), 2.0 * i + r.normal(0, 1)) for i in range(12)]
    z, epsilon = [0.0, *np.clip(pairs(points), 0, 4), 4.0], 0.5
    m = len(z)
    weight = [(z[i] - z[i - 1]) * math.exp(-epsilon / 2 * math.ceil(abs(i - m / 2))) for i in range(1, m)]
    s, rng, below = made(spark, points), N.Seeded("s"), 0
    cut, whole = {}, s.whole((0.0, 4.0))

    def draw():
        asking, send = R.drawn_gap([whole], 0.0, 4.0, epsilon, rng, s.total, at_once=2), None
        while True:
            try:
                cells = asking.send(send)
            except StopIteration as e:
                return rng.uniform(*e.value)
            send = [cut.setdefault(c, None) or cut.__setitem__(c, s.narrowed([c])[0]) or cut[c] for c in cells]

    draws = 1500
    middle = (z[m // 2 - 4] + z[m // 2 - 3]) / 2
    share = sum(w * min(1.0, max(0.0, (middle - a) / (b - a))) for w, a, b in zip(weight, z, z[1:]) if b > a) / sum(weight)
    for _ in range(draws):
        below += draw() < middle
    assert abs(below - draws * share) <= 5 * math.sqrt(draws * share * (1 - share)) + 1


def test_beyond_twenty_thousand(spark):
    """30,000 points are 450 million pairs; their median slope is that of the line they lie near."""
    df = spark.range(0, 30_000, 1, 4).selectExpr("cast(id as double) as x", "2.5 * id + cast(hash(id) % 1000 as double) as y")
    began = time.time()
    s = S.Slopes(df, F.col("x"), F.col("y"))
    n, got = places(s, [s.total // 2])
    assert n == 30_000 * 29_999 // 2 and abs(got[n // 2] - 2.5) < 0.01 and time.time() - began < 120


def test_regression_over_all_pairs(spark):
    """Slope and intercept of a line with little noise."""
    from hushframe.plans import planner
    from hushframe.privacy import Definition, PrivacyError, Usage
    from hushframe.sources import readers

    df = spark.range(0, 4_000, 1, 4).selectExpr("10.0 + id / 160 as x", "30 - 1.5 * (10.0 + id / 160) + cast(hash(id) % 100 as double) / 100 as y")
    f = readers.from_dataframe(df, Definition(protect_floating_point=False)).clamp(["x", "y"], [1.0, -50.0], [100.0, 100.0]).impute(["x", "y"])
    f = f.new_rows(f.df, n=4_000)
    planned = f.dp_linear_regression(Usage(200.0), "x", "y", -10.0, 10.0, 0.0, 100.0, "theil-sen", rng=N.Seeded("r"))
    slope, intercept = planner.release([planned])[0]
    assert planned.usage == Usage(200.0) and abs(slope + 1.5) < 0.05 and abs(intercept - 30) < 1.0
    with pytest.raises(PrivacyError):
        f.clamp("x", 1.0, 2.0).subtract("z", "x", 1.5).dp_linear_regression(Usage(1.0), "z", "y", -1.0, 1.0, 0.0, 1.0, "theil-sen")
    middle = planner.evaluate([f.theil_sen_slope("x", "y")])[0][()][0]
    assert abs(middle + 1.5) < 0.01
    with pytest.raises(PrivacyError):
        f.theil_sen_slope("x", "y").sensitivity(1)


def test_work_is_not_quadratic(spark):
    """A million points are 5e11 pairs, whose median slope is that of the line they lie near."""
    df = spark.range(0, 1_000_000, 1, 4).selectExpr("cast(id as double) as x", "0.5 * id + cast(hash(id) % 1000 as double) as y")
    began = time.time()
    s = S.Slopes(df, F.col("x"), F.col("y"))
    n, got = places(s, [s.total // 2])
    assert n == 1_000_000 * 999_999 // 2 and abs(got[n // 2] - 0.5) < 1e-4 and time.time() - began < 240


@pytest.mark.parametrize("wide", [3, 50, 10**6])
def test_equal_points(spark, monkeypatch, wide):
    """Runs of equal x over several blocks, equal points, and more pairs of one slope than are listed."""
    r = np.random.default_rng(wide)
    points = list(zip(r.integers(0, wide, 1500).tolist(), r.integers(-2, 2, 1500).tolist()))
    monkeypatch.setattr(S, "LEAST", 100)
    monkeypatch.setattr(S, "LEAF_PAIRS", 300)
    s, want = made(spark, points), pairs(points)
    assert s.total == len(want) and s.count >= 12
    at = [-1.0, -1e-9, 0.0, 1e-9, 1.0]
    assert s._counted([*at, math.inf]).tolist() == [*[int((want < t).sum() if t < 0 else (want <= t).sum()) for t in at], len(want)]
    asked = [0, len(want) // 3, len(want) // 2, len(want) - 1]
    n, got = places(s, asked)
    assert all(math.isclose(got[p], want[p], rel_tol=1e-9, abs_tol=1e-12) for p in asked)


def test_inversions():
    r = np.random.default_rng(1)
    for n, most in ((0, 1), (1, 1), (31, 9), (33, 2), (700, 40), (3000, 3000)):
        v, w = r.integers(0, most, n), r.integers(0, 30, n)
        out = np.triu(v[:, None] > v[None, :], 1)
        assert S.inversions(v) == out.sum() and S.inversions(v, w) == (out * np.outer(w, w)).sum()
        i, j = S._out_of_order(v)
        assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*(a.tolist() for a in np.nonzero(out))))


def test_points_that_cross_ranges(spark, monkeypatch):
    """Points that come through whole ranges between two thresholds: the slopes listed are those between them."""
    r = np.random.default_rng(2)
    points = [(float(i), float(r.normal(0, 1)) + (300.0 if i % 97 == 0 else 0.0)) for i in range(1200)]
    monkeypatch.setattr(S, "LEAST", 100)
    s, want = made(spark, points), pairs(points)
    assert s.count >= 10
    for low, high in ((-1e-3, 1e-3), (-5.0, -0.5), (0.01, 0.4), (-s.top, s.top)):
        found = s._listed([R.Cell(low, high, 0, 0, True)])[0]
        here = want[(want > low) & (want <= high)]
        assert sum(c.count for c in found) == len(here) and np.allclose([c.low for c in found], np.unique(here + 0.0))
