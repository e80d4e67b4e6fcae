"""Operands of several columns, weighted subsets and exact binomial draws."""

import math

import pytest
from pyspark.sql import functions as F

from hushframe.operators import noise as N
from hushframe.privacy import Definition, PrivacyError
from hushframe.sources import readers

SOFT = Definition(protect_floating_point=False)


def test_operands_of_several_columns(spark):
    f = readers.literal(spark, {"x": [1.0, 2.0], "y": [3.0, None], "k": [1, 2]}, SOFT).clamp(["x", "y"], [0.0, 0.0], [5.0, 10.0])
    one = f.add("out", ["x", "y"], 1.0)
    assert list(one.props)[-2:] == ["out_x", "out_y"] and [tuple(r)[-2:] for r in one.df.collect()] == [(2.0, 4.0), (3.0, None)]
    assert (one.of("out_x").lower, one.of("out_y").upper, one.of("out_y").nullable) == (1.0, 11.0, True)
    assert [tuple(r) for r in f.multiply(["a", "b"], ["x", "y"], ["y", "x"]).df.select("a", "b").limit(1).collect()] == [(3.0, 3.0)]
    assert [tuple(r) for r in f.multiply(["a", "b"], ["x", "y"], [10.0, 100.0]).df.select("a", "b").limit(1).collect()] == [(10.0, 300.0)]
    assert [tuple(r) for r in f.subtract(["x", "y"], 10.0, ["y", "x"]).df.select("x", "y").limit(1).collect()] == [(7.0, 9.0)]  # of the columns as they were
    assert [tuple(r) for r in f.negative("n", ["x", "k"]).df.select("n_x", "n_k").collect()] == [(-1.0, -1), (-2.0, -2)]
    assert f.add("out", ["x"], 1.0).of("out_x").upper == 6.0 and f.negative("n", ["k"]).of("n_k").kind == "int"
    for bad in (lambda: f.add("o", ["x", "y"], ["x", "y", "k"]), lambda: f.add(["o"], ["x", "y"], 1.0), lambda: f.add(["o", "o"], ["x", "y"], 1.0), lambda: f.add("o", [], 1.0), lambda: f.modulo("o", ["x", "y"], [2.0, -1.0])):
        with pytest.raises(PrivacyError):
            bad()


def test_weighted_subsets(spark):
    """n rows over eight partitions; the shares of two weights follow the times at which a row's key is up: 1 - exp(-w t) of each, where n are up in all."""
    df = spark.range(0, 40_000, 1, 8).selectExpr("id", "case when id % 4 = 0 then 2.0D else 1.0D end as w")
    f = readers.from_dataframe(df, SOFT)
    g = f.subset(15_000, "w")
    got = {r["w"]: r["n"] for r in g.df.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert g.n == 15_000 and sum(got.values()) == 15_000 and g.df.select("id").distinct().count() == 15_000
    light, heavy = 30_000, 10_000
    q = (-light + math.sqrt(light**2 + 4 * heavy * (light + heavy - 15_000))) / (2 * heavy)  # light (1 - q) + heavy (1 - q^2) = n
    assert abs(got[2.0] - heavy * (1 - q * q)) < 6 * math.sqrt(heavy * (1 - q * q) * q * q)
    assert f.subset(10, seed=3).df.count() == 10
    odd = readers.from_dataframe(spark.createDataFrame([(1, 0.0), (2, -1.0), (3, None), (4, float("nan")), (5, 1.0), (6, 3.0)], "id long, w double"), SOFT)
    assert sorted(r["id"] for r in odd.subset(2, "w").df.collect()) == [5, 6]
    firsts = sum(odd.subset(1, "w", seed=i).df.first()["id"] == 6 for i in range(12))
    assert 3 <= firsts <= 12  # three in four
    for bad in (lambda: odd.subset(3, "w"), lambda: f.subset(0), lambda: f.subset(50_000)):
        with pytest.raises(PrivacyError):
            bad()


@pytest.mark.parametrize("p", [0.0, 1.0, 0.5, 0.75, 0.3, 1e-3, 1 - 2**-53])
def test_binomial(p):
    rng, n, draws = N.Seeded(f"b{p}"), 1000, 60
    got = [N.binomial(n, p, rng) for _ in range(draws)]
    assert all(0 <= g <= n for g in got) and abs(sum(got) - draws * n * p) <= 5 * math.sqrt(draws * n * p * (1 - p)) + 1e-9
    assert N.binomial(0, p, rng) == 0


def test_binomial_over_blocks(monkeypatch):
    monkeypatch.setattr(N, "BLOCK_BITS", 7)
    counts = [0] * 4
    for i in range(800):
        counts[N.binomial(3, 0.25, N.Seeded(f"c{i}"))] += 1
    for k, c in enumerate(counts):
        w = math.comb(3, k) * 0.25**k * 0.75 ** (3 - k)
        assert abs(c - 800 * w) < 5 * math.sqrt(800 * w * (1 - w))
