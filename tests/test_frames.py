import collections
import math

import pytest
from pyspark.sql import functions as F

from hushframe.functions import columns as C
from hushframe.operators import noise as N
from hushframe.operators import preprocess, structure
from hushframe.operators import ranks as R
from hushframe.plans import graph, planner
from hushframe.plans.frame import PrivateFrame
from hushframe.privacy import SUBSTITUTE, Definition, Ledger, PrivacyError, Usage
from hushframe.sources import readers
from hushframe.streaming.releases import release_stream

SOFT = Definition(protect_floating_point=False)


@pytest.fixture(scope="module")
def small(spark) -> PrivateFrame:
    f = readers.literal(spark, {"x": [1.0, 2.0, 3.0], "y": [10.0, 20.0, 30.0], "g": ["a", "b", "a"]}, SOFT)
    f = f.clamp(["x", "y"], [0.0, 0.0], [5.0, 50.0]).impute(["x", "y"])
    return f.new_rows(f.df, n=3)


def value(a):
    return planner.evaluate([a])[0][()]


def test_goldens(small):
    assert value(small.sum(["x", "y"])) == [6, 60] and value(small.mean(["x", "y"])) == [2, 20] and value(small.variance(["x", "y"])) == [1, 100]
    assert value(small.count()) == [3] and value(small.raw_moment("x", order=2)) == [14 / 3] and value(small.covariance(["x", "y"])) == [1, 10, 100]
    assert value(small.minimum("x")) == [1.0] and value(small.maximum("x")) == [3.0] and value(small.median("x")) == [2.0]
    assert value(small.quantile("x", alpha=0.25, interpolation="linear")) == [1.5]


def test_utilities_golden(spark):
    f = readers.literal(spark, {"x": [float(v) for v in (0, 10, 5, 7, 6, 4, 3, 8, 7, 6, 5, 5)]}, SOFT).clamp("x", -20.0, 20.0).impute("x")
    assert value(f.quantile("x", alpha=0.5, candidates=[-10, -5, 0, 2, 5, 7, 10, 12])) == [0, 0, 0.5, 1, 4.5, 3, 0.5, 0]
    g = readers.literal(spark, {"x": [0.0, 1.0, 1.0, 2.0, 5.0]}, SOFT).clamp("x", -20.0, 20.0).impute("x")
    assert value(g.quantile("x", alpha=0.5, candidates=[2, 0, 1])) == [1.5, 0.5, 2.0]


def test_digitize_golden(spark):
    f = readers.literal(spark, {"x": [-1.0, 0.0, 1.1, 2.0, 2.9, 4.1, 5.0, 6.4, float("nan")]})
    for left, want in ((True, [-1, 0, 1, 2, 2, 4, -1, -1, -1]), (False, [-1, -1, 1, 1, 2, 4, 4, -1, -1])):
        assert [r[0] for r in f.digitize("x", [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], inclusive_left=left).df.select("x").collect()] == want


def test_missing_numbers(spark):
    f = readers.literal(spark, {"x": [1.0, float("nan"), None], "y": [2.0, 2.0, float("nan")]})
    df = f.df.select(C.equal(f.df.x, f.df.x).alias("e"), C.row_max(f.df.x, f.df.y).alias("m"), C.greater_than(f.df.x, f.df.y).alias("g"), C.divide(f.df.y, f.df.y * 0).alias("d"))
    got = df.collect()
    assert [r["e"] for r in got] == [True, False, False] and got[0]["m"] == 2 and got[1]["m"] == 2 and not any(r["g"] for r in got)
    assert got[0]["d"] == math.inf and math.isnan(got[2]["d"])


def test_guards(spark, small):
    raw = readers.literal(spark, {"x": [1.0, None], "g": ["a", "b"]}, SOFT)
    for bad in (
        lambda: raw.clamp("x", 0.0, 1.0).sum("x"), lambda: raw.impute("x"), lambda: raw.sum("g"), lambda: raw.partition("g"), lambda: raw.clamp("x", 2.0, 1.0),
        lambda: small.sum("x").sensitivity(1) and small.index("nope"), lambda: small.digitize("x", [1.0, 1.0]), lambda: small.log("o", "x"), lambda: small.modulo("o", "x", "y"),
        lambda: small.dp_mean(Usage(0.0), "x"), lambda: small.clamp("x", categories=[1.5], null_value=0.5), lambda: small.column_bind(raw), lambda: small.filter("x"),
        lambda: small.greater_than("m", "x", 1.0).filter("m").mean("x"), lambda: readers.literal(spark, {"x": [1.0]}).clamp("x", 0.0, 1.0).impute("x").sum("x") and graph.Analysis(spark).nothing(1),
    ):
        with pytest.raises(PrivacyError):
            bad()


def test_mechanism_guards(spark):
    hard = readers.literal(spark, {"x": [1.0, 2.0]}).clamp("x", 0.0, 5.0).impute("x")
    hard = hard.new_rows(hard.df, n=2)
    from hushframe.operators import mechanisms as M

    with pytest.raises(PrivacyError):
        M.laplace_mechanism(hard.mean("x"), 1.0)
    with pytest.raises(PrivacyError):
        M.gaussian_mechanism(hard.mean("x"), (1.0, 1e-6))
    with pytest.raises(PrivacyError):
        M.snapping_mechanism(hard.mean("x"), 1.0, sensitivity=0.1)
    with pytest.raises(PrivacyError):
        M.snapping_mechanism(hard.mean("x"), 1.0, rng=N.Seeded("x"))
    with pytest.raises(PrivacyError):
        M.simple_geometric_mechanism(hard.mean("x"), 1.0)
    assert 0 <= planner.release([hard.dp_mean(1.0, "x")])[0][0] <= 5


def test_partition_and_parallel_budget(small):
    p = small.clamp("g", categories=["a", "b", "c"], null_value="?").partition("g")
    assert {k[0]: v[0] for k, v in planner.evaluate([p.count()])[0].items()} == {"a": 2, "b": 1, "c": 0, "?": 0}
    ledger = Ledger(Usage(1.0))
    got = planner.release([p.dp_count(1.0, upper=10)], ledger)[0]
    assert set(got) == {("a",), ("b",), ("c",), ("?",)} and ledger.spent == Usage(1.0)
    twice = PrivateFrame(small.df, small.props, Definition(neighboring=SUBSTITUTE)).clamp("g", categories=["a"], null_value="?").partition("g")
    assert twice.stability == 2


def test_undeclared_keys_do_not_show(spark):
    f = readers.literal(spark, {"g": ["a", "z"], "x": [1.0, 2.0]}, SOFT).clamp("x", 0.0, 5.0).impute("x")
    g = f.clamp("g", categories=["a"], null_value="?").partition("g")
    assert set(planner.evaluate([g.sum("x")])[0]) == {("a",), ("?",)}


def test_one_job_for_fused_aggregates(spark, small):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fused", "fused")
    planner.evaluate([small.sum("x"), small.mean("y"), small.variance("x"), small.count()])
    few = len(tracker.getJobIdsForGroup("fused"))
    spark.sparkContext.setJobGroup("single", "single")
    planner.evaluate([small.sum("x")])
    assert few == len(tracker.getJobIdsForGroup("single"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_resize(spark):
    f = readers.from_dataframe(spark.range(1000).selectExpr("cast(id as double) as x"), SOFT).clamp("x", 0.0, 1000.0).impute("x")
    assert f.resize(number_rows=100).df.count() == 100 and f.resize(number_rows=1500).df.count() == 1500 and f.resize(minimum_rows=10).df.count() == 1000
    g = f.resize(number_rows=3000, sample_proportion=2.5)
    assert g.df.count() == 3000 and g.stability == 3 and math.isclose(g.sample, 2.5 / 3)
    assert f.resize(number_rows=500).df.distinct().count() == 500


def test_exact_ranks_by_cells(spark, monkeypatch):
    monkeypatch.setattr(R, "LEAF_ROWS", 50)
    monkeypatch.setattr(R, "KEY_CELLS", 7)
    f = readers.from_dataframe(spark.range(5000).selectExpr("cast((id * 7919) % 5000 as double) as x", "cast(id % 3 as string) as g"), SOFT).clamp("x", 0.0, 5000.0).impute("x")
    for alpha in (0.0, 0.3, 0.5, 1.0):
        assert value(f.quantile("x", alpha=alpha, interpolation="lower")) == [float(math.floor(4999 * alpha))]
    same = readers.from_dataframe(spark.range(500).selectExpr("1.0D as x"), SOFT).clamp("x", 0.0, 2.0).impute("x")
    assert value(same.median("x")) == [1.0]
    parts = f.clamp("g", categories=["0", "1", "2", "9"], null_value="?").partition("g")
    got = planner.evaluate([parts.new_rows(parts.df, not_empty=True).quantile("x", alpha=0.5, interpolation="linear")])[0]
    for g in range(3):
        x = sorted((i * 7919) % 5000 for i in range(5000) if i % 3 == g)
        k = (len(x) - 1) * 0.5
        assert got[(str(g),)] == [(x[math.floor(k)] + x[math.ceil(k)]) / 2]
    assert math.isnan(got[("9",)][0])


def test_ranks_of_wide_and_tied_values(spark):
    wide = [-math.inf, -1.7e308, -1e-320, 0.0, 5e-324, 1e-310, 1.0, 1.0, 1.0, 1e200, 1.7e308, math.inf, math.inf]
    df = spark.createDataFrame([(float(v),) for v in wide], "x double").repartition(3)
    n, got = R.ask(df, [(F.col("x"), None)], [], [()], [(0, lambda first: R.at_places(first, range))])[0][()]
    assert n == len(wide)
    assert [got[i] for i in range(len(wide))] == sorted(wide)


@pytest.mark.parametrize(("leaf", "cells"), [(20_000, 4096), (0, 2)])
def test_gaps_are_drawn_by_their_weight(spark, monkeypatch, leaf, cells):
    """Shares of 4,000 draws against the weights of all gaps, with and without cells that are narrowed."""
    x = sorted([0.5, 1.0, 1.0, 1.0, 2.5, 2.75, 4.0, 4.5, 7.0, 7.0])
    z, epsilon = [0.0, *x, 10.0], 0.7
    weights = {}
    for i in range(1, len(z)):
        if z[i] > z[i - 1]:
            weights[z[i - 1], z[i]] = (z[i] - z[i - 1]) * math.exp(-epsilon / 2 * math.ceil(abs(i - len(z) / 2)))
    total, draws = sum(weights.values()), 4000

    def counted(c):  # the cells that a job would count
        inside = [v for v in x if c.low <= v <= c.high]
        parts = {v: v for v in inside} if c.count <= leaf else {v: min(int((v - c.low) / (c.high - c.low) * cells), cells - 1) for v in inside}
        out, before = [], c.before
        for p in sorted(set(parts.values())):
            own = [v for v in inside if parts[v] == p]
            out.append(R.Cell(min(own), max(own), len(own), before))
            before += len(own)
        return out

    rng, seen = N.Seeded(f"gaps{leaf}"), collections.Counter()
    for _ in range(draws):
        g = R.drawn_gap([R.Cell(0.5, 7.0, 10, 0)], 0.0, 10.0, epsilon, rng)
        try:
            asked = next(g)
            while True:
                asked = g.send(list(map(counted, asked)))
        except StopIteration as e:
            seen[e.value] += 1
    assert set(seen) <= set(weights)
    for gap, w in weights.items():
        p = w / total
        assert abs(seen[gap] - draws * p) <= 5 * math.sqrt(draws * p * (1 - p)) + 1
    df = spark.createDataFrame([(v, "a") for v in x] + [(float("nan"), "b"), (3.0, "b")], "x double, g string")
    monkeypatch.setattr(R, "LEAF_ROWS", leaf)
    monkeypatch.setattr(R, "KEY_CELLS", cells)
    rng = N.Seeded("keys")
    got = R.ask(df, [(F.col("x"), (0.0, 10.0))], ["g"], [("a",), ("b",), ("c",)], [(0, lambda first: R.drawn_gap(first, 0.0, 10.0, 50.0, rng))])[0]
    assert got["a",] in weights and got["b",] in {(0.0, 3.0), (3.0, 10.0)} and got["c",] == (0.0, 10.0)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_numbers_over_partitions(spark, tmp_path, coalesce):
    """A million rows in eight files: all places differ, parts are even, and matchings are whole."""
    path = str(tmp_path / "rows")
    spark.range(0, 1_000_000, 1, 8).selectExpr("cast(id % 1000 as double) as x", "cast(id % 7 as double) as y", "cast(id as string) as pad").write.parquet(path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        f = readers.read_parquet(spark, path, definition=Definition(protect_floating_point=False, neighboring=SUBSTITUTE)).clamp(["x", "y"], [0.0, 0.0], [1000.0, 10.0]).impute(["x", "y"])
        f = f.new_rows(f.df, n=1_000_000)
        placed = structure.numbering(f.df, ["x"])
        r = placed.agg(F.count_distinct("__n").alias("n"), F.min("__n").alias("low"), F.max("__n").alias("high")).first()
        assert (r["n"], r["low"], r["high"]) == (1_000_000, 0, 999_999)
        parts = f.partition_even(7, "x").df.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("z")).orderBy("part").collect()
        assert [p["n"] for p in parts] == structure.even_lengths(1_000_000, 7) and all(p["z"] <= q["a"] for p, q in zip(parts, parts[1:]))
        for seed in range(3):
            assert f.theil_sen("x", "y", k=2, rng=N.Seeded(f"r{seed}")).df.count() == 2 * 500_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("n", [0, 1, 2, 9, 10])
def test_matchings(spark, n):
    """In each round every point has one partner (but one of an odd number), and no pair comes twice."""
    definition = Definition(protect_floating_point=False, neighboring=SUBSTITUTE)
    f = readers.from_dataframe(spark.range(n).selectExpr("cast(id as double) as x", "cast(id * id as double) as y"), definition).clamp(["x", "y"], [0.0, 0.0], [100.0, 1000.0]).impute(["x", "y"])
    k = 3
    lines = [r["slope"] for r in f.theil_sen("x", "y", k=k).df.collect()]
    assert len(lines) == k * (n // 2)
    if n > 4:  # the slope of points i and j is i + j
        assert len(set(map(round, lines))) >= k and set(map(round, lines)) <= {i + j for i in range(n) for j in range(i)}


def test_resize_keeps_partitions(spark):
    f = readers.from_dataframe(spark.range(0, 200_000, 1, 8).selectExpr("cast(id as double) as x"), SOFT).clamp("x", 0.0, 1e6).impute("x")
    g = f.resize(number_rows=100_000, seed=3)
    assert g.df.count() == 100_000 == g.df.distinct().count() and g.df.rdd.getNumPartitions() > 1
    assert abs(g.df.agg(F.avg("x")).first()[0] - 100_000) < 2000 and f.resize(number_rows=0 + 1).df.count() == 1
    counts = {preprocess.sampled_count(0.3, 1000, SOFT) for _ in range(30)}
    assert len(counts) > 1 and all(200 < c < 400 for c in counts) and preprocess.sampled_count(0.3, 1000, Definition(neighboring=SUBSTITUTE)) == 300


def test_inverse_normal(spark):
    from statistics import NormalDist

    p = [1e-300, 1e-12, 0.001, 0.02, 0.3, 0.5, 0.7, 0.98, 0.999999, 1 - 1e-15]
    got = spark.createDataFrame([(x,) for x in p], "p double").select(C.inverse_normal(F.col("p"))).collect()
    assert all(math.isclose(r[0], NormalDist().inv_cdf(x), rel_tol=1e-8, abs_tol=1e-8) for r, x in zip(got, p))


def test_columns_bound(spark, small):
    a = small.clamp("x", 0.0, 2.0).index("x").to_dataframe(["x2"])
    b = small.multiply("y", "y", 2.0).index("y")
    c = small.index("y").to_dataframe(["old"])
    both = a.column_bind(b, c)
    assert both.df.columns == ["x2", "y", "old"] and both.of("x2").upper == 2.0
    assert sorted(map(tuple, both.df.collect())) == [(1.0, 20.0, 10.0), (2.0, 40.0, 20.0), (2.0, 60.0, 30.0)]
    nested = both.index("old").column_bind(small.index("g"), both.index("x2"))
    assert sorted(map(tuple, nested.df.collect())) == [(10.0, "a", 1.0), (20.0, "b", 2.0), (30.0, "a", 2.0)]
    assert value(both.sum(["x2", "y"])) == [5.0, 120.0]
    for other in (small.index("x").new_rows(small.df), small.greater_than("m", "x", 1.0).filter("m").index("y")):
        with pytest.raises(PrivacyError):
            small.index("g").column_bind(other)


def test_theil_sen_and_gumbel(spark):
    f = readers.from_dataframe(spark.range(100).selectExpr("cast(id as double) as x", "2.0D * id as y"), SOFT).clamp(["x", "y"], [0.0, 0.0], [100.0, 200.0]).impute(["x", "y"])
    f = f.new_rows(f.df, n=100)
    assert f.theil_sen("x", "y", "theil-sen").df.count() == 4950
    lines = f.theil_sen("x", "y", k=4)
    assert lines.df.count() == 200 and lines.stability == 4 and {round(r[0], 6) for r in lines.df.select("slope").collect()} == {2.0}
    slope, intercept = planner.release([f.dp_linear_regression(50.0, "x", "y", -10, 10, -5, 5, implementation="theil-sen-match")])[0]
    assert -10 <= slope <= 10 and -5 <= intercept <= 5
    m = [planner.release([f.dp_gumbel_median("x", 20.0, 0.0, 100.0)])[0] for _ in range(3)]
    assert all(40 < x < 60 for x in m)


def test_all_pairs_in_blocks(spark, monkeypatch):
    """Each pair once, whatever the blocks; and over 20,000 rows, whose steepest lines go through neighbours."""
    from hushframe.operators import aggregates

    def framed(n):
        f = readers.from_dataframe(spark.range(0, n, 1, 3).selectExpr("cast(id as double) as x", "cast(pmod(hash(id), 1000) as double) as y"), SOFT).clamp(["x", "y"], [0.0, 0.0], [1e6, 1000.0]).impute(["x", "y"])
        return f.new_rows(f.df, n=n)

    large = framed(20_500)
    y = [r["y"] for r in large.df.orderBy("x").collect()]
    steps = [b - a for a, b in zip(y, y[1:])]
    found = large.theil_sen("x", "y", "theil-sen").df.agg(F.count(F.lit(1)), F.min("slope"), F.max("slope")).first()
    assert tuple(found) == (20_500 * 20_499 // 2, min(steps), max(steps))
    monkeypatch.setattr(aggregates, "PAIR_ROWS", 30)
    f = framed(200)
    p = sorted((r["x"], r["y"]) for r in f.df.collect())
    want = sorted(((d - b) / (c - a), (b + d) / 2 - (d - b) / (c - a) * (a + c) / 2) for i, (a, b) in enumerate(p) for c, d in p[i + 1 :])
    got = sorted(map(tuple, f.theil_sen("x", "y", "theil-sen").df.select("slope", "intercept").collect()))
    assert len(got) == 19_900 and all(math.isclose(a, b, abs_tol=1e-6) for g, w in zip(got, want) for a, b in zip(g, w))


def test_graph(spark, small):
    a = graph.Analysis(spark, SOFT, Usage(2.0))
    x = a.dataframe(small.df).clamp("x", 0.0, 5.0).impute("x").index("x").resize(number_rows=50)
    m = x.dp_mean(1.0)
    later = m.multiply(2.0)
    a.submit()
    n = x.dp_count(0.5)
    assert a.privacy_usage() == Usage(1.5)
    first = a.release()
    assert a.release(m)[m.id] == first[m.id] and math.isclose(float(first[later.id][0]), 2 * first[m.id][0]) and first[n.id] == [50]
    assert a.ledger.by_submission() == {0: Usage(1.0), 1: Usage(0.5)}
    x.dp_mean(1.0)
    with pytest.raises(PrivacyError):
        a.release()
    assert graph.privacy_usage_to_accuracy(a._built[m.id], 0.05)[0] > 0


def test_stream(spark, tmp_path):
    spark.range(200).selectExpr("cast(id as double) as x").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen, ledger = {}, Ledger(Usage(2.0))
    q = release_stream(stream, lambda f: [f.dp_count(1.0, upper=1000)], seen.__setitem__, ledger, SOFT, checkpoint=str(tmp_path / "cp"))
    q.awaitTermination()
    assert len(seen) == 2 and ledger.spent == Usage(2.0) and sum(v[0][0] for v in seen.values()) > 100


def test_stream_after_a_restart(spark, tmp_path):
    """A batch whose sink failed is handed on with the same values, and is paid for once; a new process' ledger knows the cost."""
    spark.range(100).selectExpr("cast(id as double) as x").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double").parquet(str(tmp_path / "in"))
    first, second, folder = {}, {}, str(tmp_path / "cp")
    plan = lambda f: [f.dp_count(1.0, upper=10_000, mechanism="laplace"), f.clamp("x", 0.0, 100.0).impute("x").dp_sum(0.5, "x")]

    def fails(number, values):
        first[number] = values
        raise RuntimeError("no sink")

    q = release_stream(stream, plan, fails, Ledger(Usage(2.0)), SOFT, checkpoint=folder)
    with pytest.raises(Exception, match="no sink"):
        q.awaitTermination()
    ledger = Ledger(Usage(2.0))
    release_stream(stream, plan, second.__setitem__, ledger, SOFT, checkpoint=folder).awaitTermination()
    assert first == second and len(first) == 1 and ledger.spent == Usage(1.5)
    release_stream(stream, plan, second.__setitem__, ledger, SOFT, checkpoint=folder).awaitTermination()
    assert ledger.spent == Usage(1.5)
    with pytest.raises(PrivacyError):
        ledger.spend("more", Usage(1.0))


def test_empty_tables(spark):
    f = readers.literal(spark, {"x": [1.0]}, SOFT).clamp("x", 0.0, 2.0).impute("x")
    e = f.new_rows(f.df.where("false"))
    assert value(e.count()) == [0] and value(e.sum("x")) == [0] and math.isnan(value(e.mean("x"))[0]) and math.isnan(value(e.median("x"))[0])
    assert 0 <= planner.release([e.dp_gumbel_median("x", 1.0, 0.0, 2.0)])[0] <= 2
