import duckdb
import pytest

import __spark_entry__ as entry
from hushframe.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(catalogue.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    rel = duck.sql(catalogue.oracle_sql()[name])
    want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    got = [r.asDict() for r in catalogue.queries()[name](spark, FOLDER).collect()]
    order = lambda rows: sorted((tuple((k, r[k]) for k in sorted(r)) for r in rows), key=repr)
    assert order(got) == order(want)


def test_segments_are_not_cut(spark, tmp_path):
    """Over 100 segments are an error, not a silent cut."""
    import pytest

    from hushframe.plans import catalogue

    d = f"file://{tmp_path}"
    spark.createDataFrame([(i, f"s{i}", 1.0) for i in range(101)], "c_custkey long, c_mktsegment string, c_acctbal double").write.parquet(f"{d}/customer.parquet")
    with pytest.raises(ValueError, match="over 100 segments"):
        catalogue.queries()["map_sum_by_segment"](spark, d)
