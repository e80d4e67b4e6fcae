"""Composition over parts, unions and affine maps of aggregates, shared jobs, and medians in constant time."""

import collections
import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.operators import noise as N
from hushframe.operators import ranks as R
from hushframe.plans import planner
from hushframe.plans.graph import Analysis
from hushframe.plans.registry import OPERATORS
from hushframe.privacy import EVERY, SUBSTITUTE, Definition, Ledger, PrivacyError, Usage, composed, each_of
from hushframe.sources import readers

SOFT = Definition(protect_floating_point=False)


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(0, 6000, 1, 4).selectExpr("cast(id % 101 as double) as x", "cast(id * 7919 % 5000 as double) as y", "substr('abc', 1 + int(id % 3), 1) as g", "substr('uv', 1 + int(id % 2), 1) as h")
    f = readers.from_dataframe(df, SOFT).clamp(["x", "y"], [0.0, 0.0], [100.0, 5000.0]).impute(["x", "y"])
    return f.clamp("g", categories=["a", "b", "c"], null_value="?").clamp("h", categories=["u", "v"], null_value="?")


def jobs(spark, work):
    """Jobs that some work runs, and its result."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out


def test_paths():
    u = lambda e: Usage(e, e / 1000)
    a, b, every = (1, ("a",)), (1, ("b",)), (1, EVERY)
    assert composed([((a,), u(1.0)), ((b,), u(0.5))]) == u(1.0)  # apart
    assert composed([((a,), u(1.0)), ((a,), u(0.5)), ((b,), u(1.2))]) == u(1.5)  # one part twice
    assert composed([((a,), u(1.0)), ((b,), u(2.0)), ((), u(0.5))]) == u(2.5)  # a part beside the whole
    assert composed([((a,), u(1.0)), ((every,), u(0.25))]) == u(1.25)  # a part beside all parts
    assert composed([((a,), u(1.0)), (((2, ("a",)),), u(1.0))]) == u(2.0)  # parts of two partitions
    nested = [((a, (3, ("u",))), u(1.0)), ((a, (3, ("v",))), u(0.5)), ((a,), u(0.25)), ((b, (4, ("u",))), u(1.5))]
    assert composed(nested) == u(1.5) and composed(nested[:3]) == u(1.25)
    assert composed([]) == Usage(0.0)


def test_parts_apart(spark, rows):
    p = rows.partition("g")
    planned = [p.index(key="a").dp_count(Usage(1.0), upper=10**6), p.index(key="b").clamp("x", 0.0, 50.0).dp_sum(Usage(0.5), "x")]
    ledger = Ledger(Usage(1.0))
    planner.release(planned, ledger)
    assert ledger.spent == Usage(1.0) and ledger.of("dp_sum") == Usage(0.5)
    with pytest.raises(PrivacyError):
        planner.release([rows.dp_count(Usage(0.1), upper=10**6)], ledger)
    nested = p.index(key="a").partition("h")
    more = [nested.index(key="u").dp_count(Usage(0.25), upper=10**6), nested.dp_count(Usage(0.125), upper=10**6)]
    ledger = Ledger(Usage(1.5))
    planner.release(planned + more, ledger)
    assert ledger.spent == Usage(1.375) and len(ledger.entries) == 4
    with pytest.raises(PrivacyError):  # the partition again is another one
        planner.release([rows.partition("g").index(key="b").dp_count(Usage(1.0), upper=10**6)], ledger)


def test_graph_and_ledger_agree(spark, rows):
    a = Analysis(spark, SOFT)
    x = a.dataframe(rows.df).clamp("g", categories=["a", "b", "c"], null_value="?")
    p = x.partition("g")
    for key, e in (("a", 1.0), ("b", 0.75), ("b", 0.5)):
        p.index(key=key).dp_count(Usage(e), upper=10**6)
    x.dp_count(Usage(0.1), upper=10**6)
    assert a.privacy_usage() == Usage(1.35)
    a.submit()
    p.index(key="c").dp_count(Usage(0.2), upper=10**6)
    assert math.isclose(a.privacy_usage().epsilon, 1.55)
    a.release()
    assert math.isclose(a.ledger.spent.epsilon, a.privacy_usage().epsilon)


def test_union_of_aggregates(spark, rows):
    p = rows.partition("g")
    a, b, c = (p.index(key=k) for k in "abc")
    three = OPERATORS["union"](a.count(), b.count(), c.count())
    assert planner.evaluate([three])[0][()] == [2000, 2000, 2000] and three.sensitivity(1) == [1.0] * 3
    planned = OPERATORS["simple_geometric_mechanism"](three, Usage(1.0), lower=0, upper=10**6)
    assert planned.usage == Usage(1.0) and planned.charge == ((), Usage(1.0))
    tight = OPERATORS["laplace_mechanism"](three, Usage(1.0), rng=N.Seeded("u"))
    value = planner.release([tight])[0]
    rng = N.Seeded("u")
    assert value == [N.laplace(2000.0, 1.0, 1.0, rng) for _ in range(3)]  # the whole budget for each
    twice = OPERATORS["laplace_mechanism"](OPERATORS["union"](a.count(), b.count(), a.count()), Usage(1.0), rng=N.Seeded("u"))
    rng = N.Seeded("u")
    assert planner.release([twice])[0] == [N.laplace(2000.0, 1.0, 0.5, rng) for _ in range(3)]  # one part twice: half of it
    beside = OPERATORS["union"](a.sum(["x", "y"]), rows.sum("x"))
    planned = OPERATORS["laplace_mechanism"](beside, Usage(1.0), rng=N.Seeded("u"))
    exact, rng = planner.evaluate([beside])[0][()], N.Seeded("u")
    assert planner.release([planned])[0] == [N.laplace(x, s, e, rng) for x, s, e in zip(exact, [100.0, 5000.0, 100.0], [0.25, 0.25, 0.5])]
    assert a.union(b).stability == 1 and rows.union(rows).stability == 2 and a.union(a).stability == 2 and rows.union(a).stability == 2
    with pytest.raises(PrivacyError):
        OPERATORS["union"](a.count(), b)
    with pytest.raises(PrivacyError):
        OPERATORS["union"](p.count(), a.count())


def test_affine(rows):
    f = rows.new_rows(rows.df, n=6000)
    value = lambda a: planner.evaluate([a])[0][()]
    s = f.sum(["x", "y"])
    x, y = value(s)
    half = s.multiply([0.5, -2])
    assert value(half) == [x / 2, -2 * y] and half.sensitivity(1) == [50.0, 10000.0] and (half.lower, half.upper) == ([0.0, -2 * 6000 * 5000.0], [6000 * 50.0, 0.0])
    moved = s.divide(2).add([1, 2]).negative()
    assert value(moved) == [-x / 2 - 1, -y / 2 - 2] and moved.sensitivity(2) == [50.0, 2500.0]
    mix = s.mix([[1, 1], [2, -1]])
    assert value(mix) == [x + y, 2 * x - y] and mix.sensitivity(1) == [5100.0, 5200.0] and mix.upper == [6000 * 5100.0, 6000 * 200.0]
    sub = rows.new_rows(rows.df, definition=Definition(neighboring=SUBSTITUTE, protect_floating_point=False))
    h = sub.histogram("g")
    m = [[1, 1, 0, 0], [1, 0, 0, 0], [1, -1, 1, 0]]
    mixed = h.mix(m)
    assert value(mixed) == [4000, 2000, 2000] and mixed.sensitivity(1) == [6.0] * 3 and mixed.kind == "int"
    assert np.allclose(mixed.sensitivity(2), np.linalg.norm(np.array(m), 2) * math.sqrt(2))
    assert OPERATORS["laplace_mechanism"](mixed, Usage(1.0)).usage == Usage(1.0)
    for bad in (lambda: s.multiply([1]), lambda: s.add(math.nan), lambda: s.mix([[1]]), lambda: f.quantile("x", candidates=[1.0, 2.0]).multiply(2)):
        with pytest.raises(PrivacyError):
            bad()


def test_advanced_composition():
    many, slack = [((), Usage(0.1, 1e-8))] * 100, 1e-6
    e = 100 * 0.1 * math.tanh(0.05) + math.sqrt(2 * 100 * 0.01 * min(math.log(1 / slack), math.log(math.e + math.sqrt(1.0) / slack)))
    got = composed(many, slack)
    assert math.isclose(got.epsilon, e) and math.isclose(got.delta, 1 - (1 - slack) * (1 - 1e-8) ** 100, rel_tol=1e-7) and got.epsilon < 10
    assert composed(many[:3], slack) == composed(many[:3])  # plain sums are better
    one = each_of(Usage(2.0, 1e-5), 50, slack)
    assert composed([((), one)] * 50, slack).epsilon <= 2.0 + 1e-9 and one.epsilon > 2.0 / 50 and each_of(Usage(1.0), 4, slack) == Usage(0.25)
    part = [(((1, (k,)),), Usage(0.1)) for k in "ab"] * 60
    assert math.isclose(composed(part, slack).epsilon, composed(part[::2], slack).epsilon)
    ledger = Ledger(Usage(3.5, 1e-5), slack)
    for _ in range(40):
        ledger.spend("x", Usage(0.1))
    assert ledger.spent.epsilon < 3.5
    with pytest.raises(PrivacyError):
        Ledger(Usage(3.5, 1e-5)).spend_all([("x", Usage(0.1), ())] * 40)


def test_one_job_for_a_row_set(spark, rows):
    f = rows.new_rows(rows.df, n=6000)
    a, b, c = f.index("x"), f.index("y"), f.clamp("x", 10.0, 20.0).add("z", "x", "y")
    some = [a.mean("x"), b.sum("y"), c.sum("x"), c.mean("z"), f.count(), f.histogram("x", edges=[0.0, 50.0, 101.0])]
    n, values = jobs(spark, lambda: planner.evaluate(some))
    apart = [planner.evaluate([s])[0] for s in some]
    assert n <= 2 and all(np.allclose(v[()], w[()]) for v, w in zip(values, apart))  # a stage of partial sums is a job for adaptive execution


def test_one_set_of_rounds_for_order_statistics(spark, rows):
    f = rows.new_rows(rows.df, n=6000)
    some = [f.quantile(["x", "y"], alpha=alpha, interpolation="linear") for alpha in (0.1, 0.25, 0.5, 0.9)]
    n, values = jobs(spark, lambda: planner.evaluate(some))
    data = f.df.select("x", "y", "g").toPandas()
    assert n <= 6 and all(np.allclose(v[()], [np.quantile(data[c], q) for c in "xy"]) for v, q in zip(values, (0.1, 0.25, 0.5, 0.9)))
    keyed = rows.partition("g")
    keyed = keyed.new_rows(keyed.df, not_empty=True)
    n, (m, q) = jobs(spark, lambda: planner.evaluate([keyed.median("y"), keyed.index("y").quantile("y", alpha=0.9)]))
    assert n <= 6 and m[("a",)][0] == np.median(data["y"][data["g"] == "a"]) and set(q) == {("a",), ("b",), ("c",), ("?",)}


def test_every_column_is_answered(spark, rows):
    f = rows.new_rows(rows.df, n=6000)
    utilities = planner.evaluate([f.quantile(["x", "y"], candidates=[1.0, 50.0])])[0][()]
    assert utilities == [u for c in "xy" for u in planner.evaluate([f.quantile(c, candidates=[1.0, 50.0])])[0][()]]
    many = [[float(i) for i in range(0, 100)], [50.0 * i for i in range(1, 99)]]
    utilities = planner.evaluate([f.quantile(["x", "y"], candidates=many)])[0][()]
    few = [u for c, own in zip("xy", many) for at in (0, 50) for u in planner.evaluate([f.quantile(c, candidates=own[at : at + 50])])[0][()]]
    assert utilities == few and len(utilities) == 198
    m = f.dp_median(Usage(100.0), ["x", "y"], candidates=[[0.0, 50.0, 100.0], [0.0, 2500.0]])
    assert m.usage == Usage(100.0) and planner.release([m])[0] == [50.0, 2500.0]
    g = f.dp_median(Usage(100.0), ["x", "y"], lower=[0.0, 0.0], upper=[100.0, 5000.0], mechanism="gumbel")
    value = planner.release([g])[0]
    assert len(value) == 2 and abs(value[0] - 50) <= 2 and abs(value[1] - 2500) <= 10 and g.usage == Usage(100.0)
    for bad in (lambda: f.quantile(["x", "y"], candidates=[[1.0]]), lambda: f.quantile("x", candidates=[]), lambda: f.dp_median(Usage(1.0), ["x", "y"], lower=[0.0], upper=1.0, mechanism="gumbel")):
        with pytest.raises((PrivacyError, IndexError)):
            bad()


def test_no_release_is_nan(spark):
    """Missing values of every kind: imputed to numbers, or refused."""
    df = spark.createDataFrame([(1, 1.0), (None, None), (3, float("nan"))], "i long, d double")
    f = readers.from_dataframe(df, SOFT)
    with pytest.raises(PrivacyError):
        f.impute("i")
    with pytest.raises(PrivacyError):
        f.impute("i", 0.5, 2.0)
    assert [r.i for r in f.clamp("i", 0, 10).df.orderBy(F.col("d").desc()).collect()].count(None) == 1  # stays missing
    for g in (f.impute("i", 0, 10).impute("d", 0.0, 1.0), f.clamp(["i", "d"], [0, 0.0], [2, 1.0]).impute(["i", "d"]), f.clamp("i", 0, 2).impute("i", distribution="gaussian", shift=1.0, scale=1.0).clamp("d", 0.0, 1.0).impute("d")):
        assert not g.of("i").nullable and g.of("i").kind == "int" and dict(g.df.dtypes)["i"] == "bigint"
        g = g.to_float("i").clamp(["i", "d"], [0.0, 0.0], [10.0, 1.0])
        g = g.new_rows(g.df, n=3)
        for planned in (g.dp_mean(Usage(1.0), ["i", "d"]), g.dp_variance(Usage(1.0), ["i", "d"]), g.dp_quantile(Usage(1.0), ["i", "d"], mechanism="laplace"), g.dp_sum(Usage(1.0), "d")):
            assert not any(math.isnan(v) for v in planner.release([planned])[0])
    widened = f.clamp("i", 0, 10).impute("i", -5, 5).of("i")
    assert (widened.lower, widened.upper) == (-5, 10)


def test_gaps_in_constant_time_have_their_weights():
    x = sorted([0.5, 1.0, 1.0, 1.0, 2.5, 2.75, 4.0, 4.5, 7.0, 7.0])
    z, epsilon, grid = [0.0, *x, 8.0], 0.7, R.GRID
    weights = {(z[i - 1], z[i]): (z[i] - z[i - 1]) * math.exp(-epsilon / 2 * math.ceil(abs(i - len(z) / 2))) for i in range(1, len(z)) if z[i] > z[i - 1]}
    on = [v / 8 * grid for v in x]

    def counted(c):
        inside = [v for v in on if c.low <= v <= c.high]
        parts, out, before = collections.defaultdict(list), [], c.before
        for v in inside:
            parts[min(int((v - c.low) / max(c.high - c.low, 1) * 4096), 4095)].append(v)
        for p in sorted(parts):
            out.append(R.Cell(min(parts[p]), max(parts[p]), len(parts[p]), before))
            before += len(parts[p])
        return out

    rng, seen, asked_of, total = N.Seeded("constant"), collections.Counter(), set(), sum(weights.values())
    for _ in range(1200):
        g, sizes = R.constant_gap(counted(R.Cell(0.0, float(grid), 10, 0)), 0.0, 8.0, epsilon, rng, 1), []
        try:
            asked = next(g)
            while True:
                sizes.append(len(asked))
                asked = g.send(list(map(counted, asked)))
        except StopIteration as e:
            seen[e.value] += 1
        asked_of.add(tuple(sizes))
    assert set(seen) <= set(weights) and len(asked_of) == 1
    for gap, w in weights.items():
        p = w / total
        assert abs(seen[gap] - 1200 * p) <= 5 * math.sqrt(1200 * p * (1 - p)) + 1


def test_constant_time_takes_the_same_jobs(spark):
    timed, counts = Definition(protect_floating_point=False, protect_elapsed_time=True), set()
    for values in ([1.0] * 500, [float(i) for i in range(500)], [math.exp(-i) for i in range(500)], []):
        f = readers.from_dataframe(spark.createDataFrame([(v,) for v in values], "x double"), timed)
        n, v = jobs(spark, lambda: planner.release([f.dp_gumbel_median("x", Usage(2.0), 0.0, 600.0)])[0])
        assert 0 <= v <= 600
        counts.add(n)
    assert len(counts) == 1
    f = readers.from_dataframe(spark.range(2001).selectExpr("cast(id as double) x"), timed)
    assert abs(planner.release([f.dp_gumbel_median("x", Usage(20.0), 0.0, 2000.0)])[0] - 1000) < 20


def test_robust_utilities(spark):
    """The distance is the largest that any place of the missing rows makes; one more row of any kind moves it by its sensitivity at most."""
    def utilities(values, definition=SOFT, alpha=0.3, candidates=(1.0, 2.0, 3.5)):
        f = readers.from_dataframe(spark.createDataFrame([(v,) for v in values], "x double").coalesce(1), definition)
        return planner.evaluate([f.quantile("x", alpha=alpha, candidates=list(candidates), missing="interval")])[0][()]

    x = [1.0, 2.0, 2.5, 3.0, math.nan, None, 4.0]
    for at, c in zip(utilities(x), (1.0, 2.0, 3.5)):
        known = [v for v in x if v is not None and not math.isnan(v)]
        placed = [abs(0.7 * (sum(v < c for v in known) + k) - 0.3 * (sum(v > c for v in known) + 2 - k)) for k in range(3)]
        assert math.isclose(at, 7 * 0.7 - max(placed))
    shifted = lambda v, n: [u - n * 0.7 for u in v]  # noqa: E731  what depends on the number of rows only is the same for all candidates
    base = shifted(utilities(x), len(x))
    for more in (0.0, 9.0, math.nan):
        assert max(abs(a - b) for a, b in zip(shifted(utilities([*x, more]), len(x) + 1), base)) <= 0.7 + 1e-9
    wide = [float(i) / 10 for i in range(80)]
    assert np.allclose(utilities(x, candidates=wide), [u for at in range(0, 80, 40) for u in utilities(x, candidates=wide[at : at + 40])])
    f = readers.from_dataframe(spark.createDataFrame([(v,) for v in x], "x double"), SOFT)
    with pytest.raises(PrivacyError):
        f.quantile("x", candidates=[1.0])
    assert planner.release([f.dp_quantile(Usage(50.0), "x", candidates=[2.5, 100.0], missing="interval")])[0] == 2.5
