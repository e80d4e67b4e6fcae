import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.operators import matchings as M
from hushframe.operators import noise as N
from hushframe.operators import ranks as R
from hushframe.plans import planner
from hushframe.plans.shared import own_dir
from hushframe.privacy import SUBSTITUTE, Definition, Usage
from hushframe.sources import readers


def framed(spark, n, neighboring="add_remove"):
    df = spark.range(0, n, 1, 4).selectExpr("cast(id as double) as x", "2.0D * id + cast(pmod(hash(id), 100) as double) as y")
    f = readers.from_dataframe(df, Definition(protect_floating_point=False, neighboring=neighboring)).clamp(["x", "y"], [0.0, 0.0], [1e7, 1e8]).impute(["x", "y"])
    return f.new_rows(f.df, n=n)


def written_bytes(spark):
    top = own_dir(spark).removeprefix("file://")
    return sum(os.path.getsize(os.path.join(d, name)) for d, _, names in os.walk(top) for name in names)


def test_regression_writes_points_only(spark):
    """Lines are 50 times as many as points; what is written is of the points' size."""
    n = 100_000
    f, before = framed(spark, n), written_bytes(spark)
    planned = f.dp_linear_regression(Usage(200.0), "x", "y", 0.0, 10.0, -1000.0, 1000.0, rng=N.Seeded("m"))
    slope, intercept = planner.release([planned])[0]
    assert abs(slope - 2.0) < 0.01 and abs(intercept - 49.5) < 50
    assert written_bytes(spark) - before < 40 * n


@pytest.mark.parametrize("n, k", [(1000, 3), (997, 4), (40, 7), (31, 6), (5, 9)])
def test_rounds_of_blocks(spark, monkeypatch, n, k):
    """In each round each point has one partner (but one of an odd number), and no pair comes twice unless there are too few."""
    monkeypatch.setattr(M, "BLOCK", 16)
    monkeypatch.setattr(M, "TASK", 200)
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(n)], "x double, y double").repartition(3)
    got = M.lines(df, n, k, N.Seeded("r"), True).collect()
    assert len(got) == k * (n // 2)
    # the slope of points i and j is i + j, the intercept -i j
    pairs = []
    for r in got:
        s, p = round(r["slope"]), -round(r["intercept"])
        d = math.isqrt(s * s - 4 * p)
        assert d * d == s * s - 4 * p
        pairs.append(((s - d) // 2, (s + d) // 2))
    met = np.bincount([i for pair in pairs for i in pair], minlength=n)
    assert all(0 <= a < b < n for a, b in pairs) and met.max() <= k and met.sum() == 2 * k * (n // 2)
    assert n % 2 or (met == k).all()
    if n > 2 * k:
        assert len(set(pairs)) == len(pairs)


def test_lines_are_counted_where_they_are_made(spark):
    """The same places of slopes and intercepts as of the table of lines; and without lines, none."""
    df = framed(spark, 3001, SUBSTITUTE).theil_sen("x", "y", k=5, rng=N.Seeded("c")).df
    assert df in R.SOURCES and df.count() == 5 * 1500
    for bounds in ((None, None), ((1.9, 2.1), (0.0, 100.0))):
        order = [(j, lambda first: R.at_places(first, lambda n: [0, n // 4, n // 2, n - 1])) for j in (0, 1)]
        here = R.ask(df, list(zip(("slope", "intercept"), bounds)), [], [()], order)
        there = R.ask(df, [(F.col(c), b) for c, b in zip(("slope", "intercept"), bounds)], [], [()], order)
        assert here == there
    none = framed(spark, 1).theil_sen("x", "y", k=5).df
    assert none.count() == 0 and R.ask(none, [("slope", None)], [], [()], [(0, lambda first: R.at_places(first, lambda n: [0]))]) == [{(): (0, {})}]
