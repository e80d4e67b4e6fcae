import math
import random

import duckdb
import numpy as np
import pytest

from hushframe.llm import negatives
from hushframe.llm.common import Work

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=100, best=5):
    """Brute force in whole numbers."""
    good = {}
    for i, v, y in rows:
        if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * float(np.float32(x))) for x in v]
            good[i] = min(good.get(i, (y, q)), (y, q))
    out, top = [], 2**63 - 1
    for i, (y, q) in good.items():
        if i % every:
            continue
        scored = [(-max(-top - 1, min(top, sum(a * b for a, b in zip(q, p)))), j, z == y) for j, (z, p) in good.items() if j != i]
        for p, j, _ in sorted(s for s in scored if s[2])[:best]:
            held = sorted((n, k) for n, k, same in scored if not same and 80 * -p <= 100 * -n <= 100 * -p)[:best]
            out += [(i, j, r + 1, k, -p, -n) for r, (n, k) in enumerate(held)]
    return sorted(out)


def got(spark, rows, **more):
    df = negatives.mine(Work(spark, "n"), spark.createDataFrame(rows, SCHEMA).repartition(3), **more)
    return sorted(tuple(r) for r in df.collect())


def vectors(n, dim, seed, spread=1.0, labels=3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [c + r.gauss(0, spread) for c in r.choice(centres)], r.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_against_all_pairs(spark, spread):
    """Clustered and unclustered vectors."""
    rows = vectors(1500, 8, 1, spread)
    want = plain(rows)
    assert len(want) > 100 and got(spark, rows) == want


def test_odd_rows(spark):
    """Nulls, NaN, infinities, repeated rows and ids, other lengths, no components, ties, a third of one vector, negative ids and scores."""
    r = random.Random(2)
    rows = [(i - 300, [float(r.randrange(-2, 3)) for _ in range(4)], r.randrange(3)) for i in range(900)]
    rows = [(i, [1.0, 1.0, 0.0, 0.0], y) if i % 3 == 0 else (i, v, y) for i, v, y in rows]
    rows += [(None, [1.0] * 4, 1), (7000, None, 1), (7001, [1.0] * 4, None), (7100, [1.0, None, 0.0, 0.0], 1), (7200, [math.nan] * 4, 1), (7300, [math.inf] * 4, 1), (7400, [], 0), (7500, [2.0], 1), (7600, [1.0] * 6, 2), (100, [1.0, 1.0, 0.0, 0.0], 0)]
    rows += [rows[5], rows[400], rows[400]]
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("scale", [300.0, 1e16])
def test_exact_at_any_size(spark, scale):
    """Whole numbers of 32 and 64 bits, and products beyond 24 bits and beyond 64."""
    rows = [(i, [x * scale for x in v], y) for i, v, y in vectors(250, 5, 3)]
    assert got(spark, rows) == plain(rows)


def test_few_rows_and_zeros(spark):
    assert got(spark, []) == [] and got(spark, [(1, [1.0], 0)]) == [] and got(spark, [(0, [1.0], 0), (1, [1.0], 1)]) == []
    rows = [(i, [0.0, 0.0], i // 50 % 2) for i in range(0, 500, 50)]
    assert got(spark, rows) == plain(rows) != []


def test_small_blocks_and_radius(spark, monkeypatch):
    """Many rounds, groups and blocks."""
    for name, value in {"FIRST": 1 / 4096, "TOGETHER": 1}.items():
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(2500, 6, 4, 0.3)
    assert got(spark, rows) == plain(rows)


def test_columns_of_any_name(spark):
    rows = vectors(300, 4, 5)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", id int, pivot int, rank int")
    assert sorted(tuple(r) for r in negatives.mine(Work(spark, "n"), df).collect()) == plain(rows)


def test_query_and_sql(spark):
    d = "/root/testdata/sf0.1"
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    assert sorted(c.sql(negatives.ORACLE).fetchall()) == sorted(tuple(r) for r in negatives.op12_hard_negatives(spark, d).collect())
