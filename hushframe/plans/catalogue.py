"""The query catalogue: a query for each operator, with SQL that gives the same rows where SQL can.

Exact operators return values. Releases are random, so their queries return what must hold of every draw: the budget paid,
the proved sensitivity, and that the value lies within bounds or (but for odds of e^-40) near the exact one.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.operators import accuracy, noise, preprocess, sensitivity
from hushframe.operators.ranks import ask, at_places
from hushframe.operators.slopes import Slopes
from hushframe.operators.structure import reshape
from hushframe.plans import planner
from hushframe.plans.frame import PrivateFrame
from hushframe.plans.graph import Analysis, privacy_usage_to_accuracy
from hushframe.plans.registry import OPERATORS
from hushframe.plans.shared import own_dir, written
from hushframe.privacy import ADD_REMOVE, SUBSTITUTE, Definition, Usage, actual, composed, each_of, effective, parallel, sequential
from hushframe.sources import readers

SOFT = Definition(protect_floating_point=False)
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
NEAR = 40.0


def query(name: str, sql: str | None = None):
    def keep(f):
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, d: str, name: str, definition: Definition = SOFT, **more) -> PrivateFrame:
    return readers.read_parquet(spark, f"{d}/{name}.parquet", definition=definition, **more)


def items(spark: SparkSession, d: str, definition: Definition = SOFT) -> PrivateFrame:
    """lineitem with declared bounds, and no missing values after imputation."""
    f = table(spark, d, "lineitem", definition).clamp(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], [1.0, 900.0, 0.0, 0.0], [50.0, 105000.0, 0.1, 0.08])
    return f.impute(["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def known(frame: PrivateFrame) -> PrivateFrame:
    """The frame with its number of records declared (public in these tables)."""
    return frame.new_rows(frame.df, n=frame.df.count())


def rows(spark: SparkSession, schema: str, values: list[tuple]) -> DataFrame:
    return spark.createDataFrame(values, schema)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Private mean quantity and count by return flag, with the budget of each."""
    f = items(spark, d).clamp("l_returnflag", categories=["A", "N", "R"], null_value="?").partition("l_returnflag")
    counts, sums = f.dp_count(Usage(0.5), upper=10_000_000), f.dp_sum(Usage(0.5), "l_quantity")
    c, s = planner.release([counts, sums])
    return rows(spark, "flag string, released_count long, released_mean double, epsilon double", [(k[0], int(c[k][0]), s[k][0] / max(c[k][0], 1), 1.0) for k in c])


# ---------------------------------------------------------------- sources and structure


@query("materialize_scan", "SELECT r_regionkey::VARCHAR AS key, r_name AS name FROM region")
def _(spark, d):
    path = f"{own_dir(spark)}/csv-{uuid.uuid4().hex[:8]}"
    spark.read.parquet(f"{d}/region.parquet").write.option("header", True).csv(path)
    return readers.materialize(spark, path, ["key", "name"]).df


@query("literal_bind", "SELECT r_name AS v, r_regionkey::BIGINT AS k FROM region UNION ALL SELECT * FROM (VALUES ('none', -1::BIGINT), ('other', NULL)) AS t(v, k)")
def _(spark, d):
    """A table of given values, bound to the rows of another."""
    f = table(spark, d, "region", columns=["r_name", "r_regionkey"]).to_dataframe(["k", "v"])
    return f.union(readers.literal(spark, {"k": [-1, None], "v": ["none", "other"]}, SOFT)).df


@query("to_dataframe", "SELECT c_custkey AS id, c_acctbal AS balance FROM customer")
def _(spark, d):
    return table(spark, d, "customer").index(["c_custkey", "c_acctbal"]).to_dataframe(["id", "balance"]).df


@query("index_names", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, d):
    return table(spark, d, "orders").index(["o_orderkey", "o_orderstatus"]).df


@query("index_positions", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def _(spark, d):
    f = table(spark, d, "nation", columns=["n_nationkey", "n_name"])
    return f.index(indices=[list(f.props).index(n) for n in ("n_nationkey", "n_name")]).df


@query("index_mask", "SELECT c_name FROM customer")
def _(spark, d):
    return table(spark, d, "customer", columns=["c_custkey", "c_name"]).index(mask=[False, True]).df


@query("column_bind", "SELECT l_quantity, l_tax FROM lineitem")
def _(spark, d):
    f = table(spark, d, "lineitem", columns=["l_quantity", "l_tax"])
    return f.index("l_quantity").column_bind(f.index("l_tax")).df


@query("column_bind_derived", "SELECT least(greatest(l_quantity, 10.0), 20.0) AS l_quantity, l_quantity AS q, round(l_tax + 1.0, 6) AS more FROM lineitem")
def _(spark, d):
    """Columns derived apart from the same rows, one of them under a name that another frame changed."""
    f = table(spark, d, "lineitem", columns=["l_quantity", "l_tax"])
    a, b = f.clamp("l_quantity", 10.0, 20.0).index("l_quantity"), f.index("l_quantity").to_dataframe(["q"])
    return a.column_bind(b).column_bind(f.add("more", "l_tax", 1.0).index("more")).df.select("l_quantity", "q", F.round("more", 6).alias("more"))


_MEASURES = ["l_quantity", "l_discount", "l_tax"]


@query("reshape_symmetric", f"WITH m(i, c) AS (SELECT unnest(range(3)), unnest({_MEASURES})), c AS (UNPIVOT (SELECT row_number() OVER () AS r, {', '.join(_MEASURES)} FROM lineitem) ON {', '.join(_MEASURES)} INTO NAME c VALUE v) SELECT a.i::BIGINT AS i, b.i::BIGINT AS j, round(covar_samp(x.v, y.v), 6) AS v FROM m a, m b JOIN c x ON x.c = a.c JOIN c y ON y.c = b.c AND y.r = x.r GROUP BY ALL")
def _(spark, d):
    """A covariance matrix from its upper triangle."""
    m = reshape(planner.evaluate([items(spark, d).covariance(_MEASURES)])[0][()], (3, 3), symmetric=True)
    return rows(spark, "i long, j long, v double", [(i, j, round(float(m[i, j]), 6)) for i in range(3) for j in range(3)])


@query("reshape_rows", "WITH g AS (SELECT l_returnflag AS f, sum(l_quantity) AS a, sum(l_discount) AS b, sum(l_tax) AS c, sum(l_extendedprice) AS e FROM lineitem GROUP BY 1), k AS (SELECT (row_number() OVER (ORDER BY f) - 1) AS k, [[a, b], [c, e]] AS m FROM g) SELECT k::BIGINT AS k, i::BIGINT AS i, j::BIGINT AS j, round(m[i + 1][j + 1], 2) AS v FROM k, range(2) x(i), range(2) y(j)")
def _(spark, d):
    """A matrix of the sums of each flag, from a row each."""
    f = items(spark, d).clamp("l_returnflag", categories=["A", "N", "R"], null_value="?").partition("l_returnflag")
    found = planner.evaluate([f.sum([*_MEASURES, "l_extendedprice"])])[0]
    m = reshape([found[k,] for k in "ANR"], (2, 2))
    return rows(spark, "k long, i long, j long, v double", [(k, i, j, round(float(m[k][i, j]), 2)) for k in m for i in range(2) for j in range(2)])


@query("union_flatten", "SELECT l_quantity FROM lineitem UNION ALL SELECT l_quantity FROM lineitem")
def _(spark, d):
    f = table(spark, d, "lineitem", columns=["l_quantity"])
    return f.union(f).df


@query("union_of_counts", "WITH n AS (SELECT k, count(l_returnflag) AS n FROM (VALUES ('A'), ('N'), ('R')) v(k) LEFT JOIN lineitem ON l_returnflag = k GROUP BY k), s AS (SELECT sum(n) AS n FROM n) SELECT k AS part, n::BIGINT AS n, 1.0::DOUBLE AS sensitivity, e AS epsilon FROM n, (VALUES ('apart', 0.6::DOUBLE), ('twice', 0.3)) t(how, e) WHERE how = 'apart' UNION ALL SELECT 'A again', n, 1.0, 0.3 FROM n WHERE k = 'A' UNION ALL SELECT 'all', s.n, 1.0, 0.3 FROM s")
def _(spark, d):
    """Counts of parts as one aggregate, with what a mechanism of 0.6 may use for each: all of it where the parts are apart, half where a part comes twice or stands beside the whole."""
    whole = table(spark, d, "lineitem").clamp("l_returnflag", categories=["A", "N", "R"], null_value="?")
    parts = whole.partition("l_returnflag")
    a, n, r = (parts.index(key=k).count() for k in "ANR")
    out = []
    for names, some in ((("A", "N", "R"), (a, n, r)), (("", "A again"), (a, a)), (("", "all"), (a, whole.count()))):
        united = OPERATORS["union"](*some)
        planned = OPERATORS["laplace_mechanism"](united, Usage(0.6))
        values, used = planner.evaluate([united])[0][()], planned.arguments["epsilon"]
        out += [(k, int(v), s, round(e, 9)) for k, v, s, e in zip(names, values, united.sensitivity(1), used) if k]
        planner.release([planned])
    return rows(spark, "part string, n long, sensitivity double, epsilon double", out)


@query("parts_apart", "SELECT * FROM (VALUES ('apart', 1.0::DOUBLE, true), ('nested', 1.0, true), ('beside the whole', 1.25, true), ('all parts and one', 1.5, true), ('two partitions', 1.75, true)) t(released, epsilon, holds)")
def _(spark, d):
    """What releases of parts cost together: ledger and graph agree, and every count is near the exact one."""
    out = []
    for name in ("apart", "nested", "beside the whole", "all parts and one", "two partitions"):
        a = Analysis(spark, SOFT)
        x = a.parquet(f"{d}/lineitem.parquet").clamp("l_returnflag", categories=["A", "N", "R"], null_value="?").clamp("l_linestatus", categories=["F", "O"], null_value="?")
        p = x.partition("l_returnflag")
        count = lambda node, e: (node, node.dp_count(Usage(e), upper=10**9))
        some = {
            "apart": lambda: [count(p.index(key="A"), 1.0), count(p.index(key="R"), 0.5)],
            "nested": lambda: [count(p.index(key="A"), 0.25), *[count((q := p.index(key="N").partition("l_linestatus")).index(key=k), 0.75) for k in "F"], count(p.index(key="N"), 0.25)],
            "beside the whole": lambda: [count(p.index(key="A"), 1.0), count(x, 0.25)],
            "all parts and one": lambda: [count(p.index(key="A"), 1.0), (None, p.dp_count(Usage(0.5), upper=10**9))],
            "two partitions": lambda: [count(p.index(key="A"), 1.0), count(x.partition("l_linestatus").index(key="O"), 0.75)],
        }[name]()
        exact = planner.evaluate([a._build(node).count() for node, _ in some if node is not None])
        planned, got = a.privacy_usage(), a.release(*[r for _, r in some])
        near = all(abs(got[r.id][0] - e[()][0]) <= NEAR / 0.25 for (_, r), e in zip([s for s in some if s[0] is not None], exact))
        out.append((name, round(a.ledger.spent.epsilon, 9), near and abs(planned.epsilon - a.ledger.spent.epsilon) < 1e-9))
    return rows(spark, "released string, epsilon double, holds boolean", out)


@query("advanced_composition", "WITH k AS (SELECT count(DISTINCT l_quantity) AS k FROM lineitem), s AS (SELECT k, 0.05 * k AS plain, 0.05 * k * (exp(0.05) - 1) / (exp(0.05) + 1) + sqrt(2 * k * 0.0025 * least(ln(1e6), ln(exp(1) + sqrt(k * 0.0025) / 1e-6))) AS better FROM k) SELECT k::BIGINT AS releases, round(plain, 9) AS plain, round(least(plain, better), 9) AS epsilon, round(CASE WHEN better < plain THEN 1 - (1 - 1e-6) * pow(1 - 1e-9, k) ELSE k * 1e-9 END, 12) AS delta, true AS holds FROM s")
def _(spark, d):
    """What as many sums as there are quantities cost together, by the better of plain sums and advanced composition; and a budget that is shared out by it fits."""
    f = items(spark, d)
    k = int(planner.evaluate([f.count("l_quantity", distinct=True)])[0][()][0])
    planned = [f.dp_sum(Usage(0.05, 1e-9), "l_tax") for _ in range(k)]
    got, plain = composed([x.charge for x in planned], 1e-6), composed([x.charge for x in planned])
    one = each_of(Usage(2.0, 1e-5), k, 1e-6)
    fits = composed([((), one)] * k, 1e-6)
    return rows(spark, "releases long, plain double, epsilon double, delta double, holds boolean", [(k, round(plain.epsilon, 9), round(got.epsilon, 9), round(got.delta, 12), fits.epsilon <= 2.0 + 1e-9 and one.epsilon >= 2.0 / k and got.epsilon <= plain.epsilon)])


@query("partition_by_flag", "SELECT k AS flag, count(l_returnflag)::BIGINT AS n FROM (VALUES ('A'), ('N'), ('R'), ('Z'), ('?')) v(k) LEFT JOIN lineitem ON l_returnflag = k GROUP BY k")
def _(spark, d):
    f = table(spark, d, "lineitem").clamp("l_returnflag", categories=["A", "N", "R", "Z"], null_value="?").partition("l_returnflag")
    return rows(spark, "flag string, n long", [(k[0], v[0]) for k, v in planner.evaluate([f.count()])[0].items()])


@query("partition_even", "SELECT part, count(*)::BIGINT AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT ntile(7) OVER (ORDER BY o_orderkey) - 1 AS part, o_orderkey FROM orders) GROUP BY part")
def _(spark, d):
    f = known(table(spark, d, "orders", columns=["o_orderkey"])).partition_even(7, "o_orderkey")
    return f.df.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("map_sum_by_segment", "SELECT c_mktsegment AS segment, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def _(spark, d):
    f = table(spark, d, "customer")
    cats = sorted(r[0] for r in spark.read.parquet(f"{d}/customer.parquet").select("c_mktsegment").distinct().limit(101).collect())
    if len(cats) > 100:
        raise ValueError("over 100 segments")
    f = f.clamp("c_acctbal", -1000.0, 10000.0).impute("c_acctbal").clamp("c_mktsegment", categories=cats, null_value="?").partition("c_mktsegment")
    found = planner.evaluate([f.map(lambda part: part.sum("c_acctbal"))])[0]
    return rows(spark, "segment string, total double", [(k[0], round(float(v[0]), 2)) for k, v in found.items() if k[0] != "?"])


@query("index_part", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def _(spark, d):
    f = table(spark, d, "lineitem").clamp("l_returnflag", categories=["A", "N", "R"], null_value="?").partition("l_returnflag")
    return f.index(key="R").index(["l_orderkey", "l_linenumber"]).df


# ---------------------------------------------------------------- preparation

_NAN = "CASE WHEN l_linenumber = 3 THEN 'NaN'::DOUBLE ELSE l_quantity END"


def holes(spark, d) -> PrivateFrame:
    """Quantities with missing values on every third line."""
    f = table(spark, d, "lineitem", columns=["l_orderkey", "l_linenumber", "l_quantity"])
    return f.derive({"l_quantity": F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_quantity"))}, f.props)


@query("filter_mask", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")
def _(spark, d):
    return table(spark, d, "orders").greater_than("big", "o_totalprice", 100000.0).filter("big").index("o_orderkey").df


@query("clamp_numeric", f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE least(greatest(l_quantity, 10.0), 20.0) END AS q FROM lineitem")
def _(spark, d):
    return holes(spark, d).clamp("l_quantity", 10.0, 20.0).df.select("l_orderkey", "l_linenumber", F.when(~F.isnan("l_quantity"), F.col("l_quantity")).alias("q"))


@query("clamp_categorical", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_returnflag IN ('A', 'N') THEN l_returnflag ELSE 'other' END AS flag FROM lineitem")
def _(spark, d):
    f = table(spark, d, "lineitem").clamp("l_returnflag", categories=["A", "N"], null_value="other")
    return f.df.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"))


for _side, _op in (("left", "<"), ("right", "<=")):
    _edges = [0.0, 10.0, 20.0, 30.0, 40.0]
    _low = (lambda a, b: f"l_quantity >= {a} AND l_quantity < {b}") if _side == "left" else (lambda a, b: f"l_quantity > {a} AND l_quantity <= {b}")
    _case = " ".join(f"WHEN {_low(a, b)} THEN {i}" for i, (a, b) in enumerate(zip(_edges, _edges[1:])))

    @query(f"digitize_{_side}", f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (CASE WHEN l_linenumber = 3 THEN -1 {_case} ELSE -1 END)::BIGINT AS bin FROM lineitem")
    def _(spark, d, side=_side, edges=tuple(_edges)):
        return holes(spark, d).digitize("l_quantity", edges, inclusive_left=side == "left", out="bin").df.select("l_orderkey", "l_linenumber", "bin")


@query("bin_midpoint", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_quantity >= 0 AND l_quantity < 25 THEN 12.5 WHEN l_quantity >= 25 AND l_quantity < 40 THEN 32.5 ELSE -1.0 END::DOUBLE AS mid FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").bin("l_quantity", [0.0, 25.0, 40.0], -1.0, out="mid").df.select("l_orderkey", "l_linenumber", "mid")


@query("cast_bool", "SELECT o_orderkey, o_orderstatus = 'F' AS done FROM orders")
def _(spark, d):
    return table(spark, d, "orders").to_bool("o_orderstatus", "F").df.select("o_orderkey", F.col("o_orderstatus").alias("done"))


@query("cast_float", "SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN NULL ELSE s_nationkey::DOUBLE / 4 END AS x FROM supplier")
def _(spark, d):
    f = table(spark, d, "supplier")
    text = F.when(F.col("s_nationkey") == 3, F.lit("n/a")).otherwise((F.col("s_nationkey") / 4).cast("string"))
    g = readers.from_dataframe(f.df.select("s_suppkey", text.alias("x"))).to_float("x")
    return g.df.select("s_suppkey", F.when(~F.isnan("x"), F.col("x")).alias("x"))


@query("cast_int", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, floor(l_extendedprice + 0.5)::BIGINT AS price FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").to_int("l_extendedprice", 0, 200000).df.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))


@query("cast_int_text", "SELECT p_partkey, p_size::BIGINT AS size FROM part")
def _(spark, d):
    f = readers.from_dataframe(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").cast("string").alias("size")))
    return f.to_int("size", 0, 100).df


@query("cast_string", "SELECT p_partkey, p_size::VARCHAR AS size FROM part")
def _(spark, d):
    return table(spark, d, "part", columns=["p_partkey", "p_size"]).to_string("p_size").df.select("p_partkey", F.col("p_size").alias("size"))


@query("impute_uniform", "SELECT count(*)::BIGINT AS n, 0::BIGINT AS missing, true AS within FROM lineitem")
def _(spark, d):
    df = holes(spark, d).clamp("l_quantity", 1.0, 50.0).impute("l_quantity").df
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.isnan("l_quantity").cast("long")).alias("missing"), F.every((F.col("l_quantity") >= 1) & (F.col("l_quantity") <= 50)).alias("within"))


@query("impute_gaussian", "SELECT count(*)::BIGINT AS n, 0::BIGINT AS missing, true AS within FROM lineitem")
def _(spark, d):
    df = holes(spark, d).clamp("l_quantity", 1.0, 50.0).impute("l_quantity", 1.0, 50.0, distribution="gaussian", shift=25.0, scale=30.0).df
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.isnan("l_quantity").cast("long")).alias("missing"), F.every((F.col("l_quantity") >= 1) & (F.col("l_quantity") <= 50)).alias("within"))


@query("impute_categorical", "SELECT l_returnflag AS was, CASE WHEN l_returnflag = 'N' THEN true ELSE false END AS drawn, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def _(spark, d):
    f = table(spark, d, "lineitem", columns=["l_returnflag"])
    g = f.derive({"was": F.col("l_returnflag")}, f.props).impute("l_returnflag", categories=["A", "R"], null_values=["N"], weights=[1.0, 3.0])
    return g.df.groupBy("was", (F.col("was") != F.col("l_returnflag")).alias("drawn")).agg(F.count(F.lit(1)).alias("n"))


@query("impute_whole_numbers", "SELECT count(*)::BIGINT AS n, 0::BIGINT AS missing, true AS within, true AS drawn FROM lineitem")
def _(spark, d):
    """Whole numbers that are missing become whole draws within known bounds."""
    f = table(spark, d, "lineitem", columns=["l_linenumber"])
    f = f.derive({"l_linenumber": F.when(F.col("l_linenumber") != 3, F.col("l_linenumber"))}, f.props).clamp("l_linenumber", 1, 7).impute("l_linenumber")
    x = F.col("l_linenumber")
    return f.df.agg(F.count(F.lit(1)).alias("n"), F.sum(x.isNull().cast("long")).alias("missing"), F.every(x.between(1, 7)).alias("within"), (F.sum((x == 3).cast("long")) > 0).alias("drawn"))


@query("weighted_subset", "SELECT count(*)::BIGINT // 3 AS n, count(*)::BIGINT // 3 AS distinct_n, true AS holds FROM orders")
def _(spark, d):
    """A third of the orders, finished ones with twice the odds: of n draws, as many have a weight w as have the key -ln(u) / w up when n keys are."""
    f = table(spark, d, "orders", columns=["o_orderkey", "o_orderstatus"])
    f = f.to_bool("o_orderstatus", "F")
    f = f.derive({"w": F.when(F.col("o_orderstatus"), 2.0).otherwise(1.0)}, f.props | {"w": f.of("o_orderkey")})
    by = {r["w"]: r["n"] for r in f.df.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    light, heavy = by.get(1.0, 0), by.get(2.0, 0)
    n = (light + heavy) // 3
    g = f.subset(n, "w")
    q = (-light + math.sqrt(light**2 + 4 * heavy * (light + heavy - n))) / (2 * heavy)
    r = g.df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("d"), F.sum((F.col("w") == 2).cast("long")).alias("h")).first()
    return rows(spark, "n long, distinct_n long, holds boolean", [(r["n"], r["d"], abs(r["h"] - heavy * (1 - q * q)) <= 8 * math.sqrt(heavy * (1 - q * q) * q * q))])


@query("resize_sample", "SELECT 1000::BIGINT AS n, true AS within, least(1000, count(*))::BIGINT AS at_most FROM lineitem")
def _(spark, d):
    f = items(spark, d).index("l_quantity").resize(number_rows=1000)
    return f.df.agg(F.count(F.lit(1)).alias("n"), F.every(F.col("l_quantity").between(1, 50)).alias("within"), F.lit(f.n).cast("long").alias("at_most"))


@query("resize_pad", "SELECT count(*)::BIGINT + 500 AS n, true AS within FROM lineitem")
def _(spark, d):
    f = items(spark, d).index("l_quantity")
    return f.resize(number_rows=f.df.count() + 500).df.agg(F.count(F.lit(1)).alias("n"), F.every(F.col("l_quantity").between(1, 50)).alias("within"))


@query("resize_minimum_rows", "SELECT greatest(count(*), 2000)::BIGINT AS n FROM orders")
def _(spark, d):
    f = table(spark, d, "orders", columns=["o_totalprice"]).clamp("o_totalprice", 0.0, 600000.0).impute("o_totalprice").resize(minimum_rows=2000)
    return f.df.agg(F.count(F.lit(1)).alias("n"))


@query("resize_proportion", "SELECT floor(0.75 * 2 * count(*))::BIGINT AS n, 2::BIGINT AS stability, 0.75::DOUBLE AS rate FROM orders")
def _(spark, d):
    """Under substitution: exactly the share of the rows."""
    f = table(spark, d, "orders", Definition(neighboring=SUBSTITUTE), columns=["o_totalprice"]).clamp("o_totalprice", 0.0, 600000.0).impute("o_totalprice")
    g = f.resize(number_rows=math.floor(1.5 * f.df.count()), sample_proportion=1.5)
    return g.df.agg(F.count(F.lit(1)).alias("n"), F.lit(g.stability).cast("long").alias("stability"), F.lit(g.sample).alias("rate"))


@query("resize_proportion_add_remove", "SELECT count(*)::BIGINT AS n, true AS holds, true AS differ FROM orders")
def _(spark, d):
    """Under add/remove: a Binomial number of the rows is kept, the others up to the asked number are made up within the bounds."""
    f = table(spark, d, "orders", columns=["o_totalprice"]).clamp("o_totalprice", 0.0, 600000.0).impute("o_totalprice")
    n = f.df.count()
    kept = [preprocess.sampled_count(0.75, n, f.definition) for _ in range(40)]
    g = f.resize(number_rows=n, sample_proportion=0.75)
    holds = all(abs(k - 0.75 * n) <= 8 * math.sqrt(0.1875 * n) for k in kept)
    return g.df.agg(F.count(F.lit(1)).alias("n"), F.lit(holds).alias("holds"), F.lit(len(set(kept)) > 1).alias("differ"))


# ---------------------------------------------------------------- element-wise functions

_KEYS = "l_orderkey, l_linenumber::BIGINT AS l_linenumber"
_MADE = f"(SELECT l_orderkey, l_linenumber, l_extendedprice, l_tax, {_NAN} AS q FROM lineitem)"
_TRANSFORMS = {
    # operator: (arguments, SQL of a value that is null where ours is NaN)
    "abs": (("signed",), "abs(l_tax - 0.04)"),
    "add": (("l_extendedprice", "l_tax"), "l_extendedprice + l_tax"),
    "subtract": (("l_extendedprice", "l_tax"), "l_extendedprice - l_tax"),
    "multiply": (("l_extendedprice", "l_tax"), "l_extendedprice * l_tax"),
    "divide": (("l_extendedprice", "shifted"), "l_extendedprice / (l_tax + 1.0)"),
    "modulo": (("l_extendedprice", 7.0), "l_extendedprice % 7.0"),
    "power": (("shifted", 3.0), "pow(l_tax + 1.0, 3.0)"),
    "log": (("l_extendedprice",), "ln(l_extendedprice) / ln(2.71828)"),
    "negative": (("l_tax",), "0 - l_tax"),
    "row_max": (("q", "l_tax"), "CASE WHEN isnan(q) THEN l_tax ELSE greatest(q, l_tax) END"),
    "row_min": (("q", 20.0), "CASE WHEN isnan(q) THEN 20.0 ELSE least(q, 20.0) END"),
    "equal": (("q", 17.0), "NOT isnan(q) AND q = 17"),
    "greater_than": (("q", 17.0), "NOT isnan(q) AND q > 17"),
    "less_than": (("q", 17.0), "NOT isnan(q) AND q < 17"),
    "logical_and": (("high", "low"), "(NOT isnan(q) AND q > 10) AND (NOT isnan(q) AND q < 30)"),
    "logical_or": (("high", "low"), "(NOT isnan(q) AND q > 10) OR (NOT isnan(q) AND q < 30)"),
    "negate": (("high",), "NOT (NOT isnan(q) AND q > 10)"),
}


def _made(spark, d) -> PrivateFrame:
    f = table(spark, d, "lineitem", columns=["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax"]).clamp(["l_extendedprice", "l_tax"], [1.0, 0.0], [1000000.0, 0.1])
    g = f.derive({"q": F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_quantity"))}, f.props | {"q": f.of("l_quantity")})
    return g.subtract("signed", "l_tax", 0.04).add("shifted", "l_tax", 1.0).greater_than("high", "q", 10.0).less_than("low", "q", 30.0)


def _transform_query(op: str, args: tuple):
    def run(spark, d):
        f = getattr(_made(spark, d), op)("out", *args)
        out = F.col("out") if f.of("out").kind == "bool" else F.round("out", 6)
        return f.df.select("l_orderkey", "l_linenumber", out.alias("out"))

    return run


for _op, (_args, _sql) in _TRANSFORMS.items():
    _logical = _op in ("equal", "greater_than", "less_than", "logical_and", "logical_or", "negate")
    query(f"transform_{_op}", f"SELECT {_KEYS}, {_sql if _logical else f'round({_sql}, 6)'} AS out FROM {_MADE}")(_transform_query(_op, _args))


@query("transform_columns_by_one", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(l_extendedprice + 1.0, 6) AS more_l_extendedprice, round(l_tax + 1.0, 6) AS more_l_tax FROM lineitem")
def _(spark, d):
    """Several columns with one number."""
    f = _made(spark, d).add("more", ["l_extendedprice", "l_tax"], 1.0)
    return f.df.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in ("more_l_extendedprice", "more_l_tax")])


@query("transform_columns_by_columns", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(l_extendedprice * (l_tax - 0.04), 6) AS a, round(l_tax * (l_tax + 1.0), 6) AS b FROM lineitem")
def _(spark, d):
    """Pair by pair."""
    f = _made(spark, d).multiply(["a", "b"], ["l_extendedprice", "l_tax"], ["signed", "shifted"])
    return f.df.select("l_orderkey", "l_linenumber", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("transform_columns_by_row", f"SELECT {_KEYS}, NOT isnan(q) AND q > 17 AS a, l_tax > 0.03 AS b, l_extendedprice > 50000 AS c FROM {_MADE}")
def _(spark, d):
    """Columns with a row of numbers, one for each."""
    f = _made(spark, d).greater_than(["a", "b", "c"], ["q", "l_tax", "l_extendedprice"], [17.0, 0.03, 50000.0])
    return f.df.select("l_orderkey", "l_linenumber", "a", "b", "c")


@query("transform_divide_integers", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (l_orderkey // l_linenumber)::BIGINT AS out FROM lineitem")
def _(spark, d):
    f = table(spark, d, "lineitem", columns=["l_orderkey", "l_linenumber"])
    return f.divide("out", "l_orderkey", "l_linenumber").df


@query("transform_concat", "SELECT n_name || '!' AS out FROM nation")
def _(spark, d):
    f = table(spark, d, "nation", columns=["n_name"])
    g = f.derive({"mark": F.lit("!")}, f.props | {"mark": f.of("n_name")})
    return g.add("out", "n_name", "mark").df.select("out")


# ---------------------------------------------------------------- aggregates


def _exact(aggregate, digits: int = 6) -> list:
    return [round(float(v), digits) if aggregate.kind == "float" else int(v) for v in planner.evaluate([aggregate])[0][()]]


def _aggregate_query(name: str, sql: str, build: Callable, columns: list[str], kind: str = "double", digits: int = 4):
    @query(name, sql)
    def run(spark, d):
        return rows(spark, ", ".join(f"{c} {kind}" for c in columns), [tuple(_exact(build(items(spark, d)), digits))])


_QP = ["l_quantity", "l_discount"]
_aggregate_query("count", "SELECT count(*)::BIGINT AS n FROM lineitem", lambda f: f.count(), ["n"], "long")
_aggregate_query("count_distinct", "SELECT count(DISTINCT l_quantity)::BIGINT AS a, count(DISTINCT l_discount)::BIGINT AS b FROM lineitem", lambda f: f.count(_QP, distinct=True), ["a", "b"], "long")
_aggregate_query("sum", "SELECT round(sum(l_quantity), 4) AS a, round(sum(l_discount), 4) AS b FROM lineitem", lambda f: f.sum(_QP), ["a", "b"])
_aggregate_query("mean", "SELECT round(avg(l_quantity), 6) AS a, round(avg(l_discount), 6) AS b FROM lineitem", lambda f: f.mean(_QP), ["a", "b"], digits=6)
_aggregate_query("variance", "SELECT round(var_samp(l_quantity), 6) AS a, round(var_samp(l_discount), 6) AS b FROM lineitem", lambda f: f.variance(_QP), ["a", "b"], digits=6)
_aggregate_query("variance_pop", "SELECT round(var_pop(l_quantity), 6) AS a FROM lineitem", lambda f: f.variance("l_quantity", finite_sample_correction=False), ["a"], digits=6)
_aggregate_query("covariance", "SELECT round(var_samp(l_quantity), 6) AS a, round(covar_samp(l_quantity, l_discount), 6) AS b, round(var_samp(l_discount), 6) AS c FROM lineitem", lambda f: f.covariance(_QP), ["a", "b", "c"], digits=6)
_aggregate_query("cross_covariance", "SELECT round(covar_samp(l_quantity, l_extendedprice), 3) AS a, round(covar_samp(l_quantity, l_tax), 3) AS b FROM lineitem", lambda f: f.covariance(left=["l_quantity"], right=["l_extendedprice", "l_tax"]), ["a", "b"], digits=3)
_aggregate_query("raw_moment", "SELECT round(avg(l_quantity ** 3), 3) AS a FROM lineitem", lambda f: f.raw_moment("l_quantity", order=3), ["a"], digits=3)
_aggregate_query("minimum", "SELECT min(l_extendedprice) AS a FROM lineitem", lambda f: f.minimum("l_extendedprice"), ["a"])
_aggregate_query("maximum", "SELECT max(l_extendedprice) AS a FROM lineitem", lambda f: f.maximum("l_extendedprice"), ["a"])
_aggregate_query("median", "SELECT round(median(l_extendedprice), 4) AS a FROM lineitem", lambda f: f.median("l_extendedprice"), ["a"])
_SORTED = "WITH s AS (SELECT list_sort(list(l_extendedprice)) AS l, (count(*) - 1) * 0.3 AS pos FROM lineitem)"
for _how, _value in {
    "lower": "l[floor(pos)::BIGINT + 1]", "upper": "l[ceil(pos)::BIGINT + 1]", "nearest": "l[floor(pos + 0.5)::BIGINT + 1]", "midpoint": "(l[floor(pos)::BIGINT + 1] + l[ceil(pos)::BIGINT + 1]) / 2",
    "linear": "l[floor(pos)::BIGINT + 1] * (1 - (pos - floor(pos))) + l[ceil(pos)::BIGINT + 1] * (pos - floor(pos))",
}.items():
    _aggregate_query(f"quantile_{_how}", f"{_SORTED} SELECT round({_value}, 4)::DOUBLE AS a FROM s", lambda f, how=_how: f.quantile("l_extendedprice", alpha=0.3, interpolation=how), ["a"])
_CANDIDATES = [0.0, 10.0, 17.0, 25.0, 40.0, 60.0]
_aggregate_query("quantile_utilities", "SELECT " + ", ".join(f"round(count(*) * 0.7 - abs(0.7 * count(*) FILTER (l_quantity < {c}) - 0.3 * count(*) FILTER (l_quantity > {c})), 4)::DOUBLE AS c{i}" for i, c in enumerate(_CANDIDATES)) + " FROM lineitem", lambda f: f.quantile("l_quantity", alpha=0.3, candidates=_CANDIDATES), [f"c{i}" for i in range(6)])
_QUANTITIES, _TAXES = [10.0, 25.0], [0.02, 0.03, 0.05]
_utility = lambda x, c, n="count(*)": f"{n} * 0.7 - abs(0.7 * count(*) FILTER ({x} < {c}) - 0.3 * count(*) FILTER ({x} > {c}))"
_aggregate_query("quantile_utilities_columns", "SELECT " + ", ".join(f"round({_utility(x, c)}, 4)::DOUBLE AS {x[2]}{i}" for x, own in (("l_quantity", _QUANTITIES), ("l_tax", _TAXES)) for i, c in enumerate(own)) + " FROM lineitem", lambda f: f.quantile(["l_quantity", "l_tax"], alpha=0.3, candidates=[_QUANTITIES, _TAXES]), ["q0", "q1", "t0", "t1", "t2"])


@query("quantile_columns", "SELECT " + ", ".join(f"round(quantile_cont({x}, {a}), 4)::DOUBLE AS {x[2]}{int(a * 100)}" for x in ("l_quantity", "l_extendedprice") for a in (0.1, 0.25, 0.5, 0.9)) + " FROM lineitem")
def _(spark, d):
    """Four quantiles of two columns, in shared rounds."""
    f, alphas = items(spark, d), (0.1, 0.25, 0.5, 0.9)
    found = planner.evaluate([f.quantile(["l_quantity", "l_extendedprice"], alpha=a, interpolation="linear") for a in alphas])
    names = [f"{x}{int(a * 100)}" for x in "qe" for a in alphas]
    return rows(spark, ", ".join(f"{n} double" for n in names), [tuple(round(v[()][i], 4) for i in range(2) for v in found)])


_FAR = "abs(0.7 * (count(*) FILTER (q < {c}) + m) - 0.3 * count(*) FILTER (q > {c})), abs(0.7 * count(*) FILTER (q < {c}) - 0.3 * (count(*) FILTER (q > {c}) + m))"


@query("quantile_utilities_missing", f"WITH t AS (SELECT CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS q FROM lineitem), m AS (SELECT count(*) FILTER (q IS NULL) AS m FROM t) SELECT " + ", ".join(f"round(count(*) * 0.7 - greatest({_FAR.format(c=c)}), 4)::DOUBLE AS c{i}" for i, c in enumerate(_CANDIDATES)) + ", 0.7::DOUBLE AS sensitivity FROM t, m GROUP BY m")
def _(spark, d):
    """Utilities where every third line's quantity may lie anywhere."""
    a = holes(spark, d).quantile("l_quantity", alpha=0.3, candidates=_CANDIDATES, missing="interval")
    return rows(spark, ", ".join(f"c{i} double" for i in range(6)) + ", sensitivity double", [(*_exact(a, 4), a.sensitivity(0)[0])])


@query("affine_sums", "SELECT round(sum(l_quantity) * 0.5, 4) AS half, round(100 - 2 * sum(l_discount), 4) AS turned, round(sum(l_quantity) + 10 * sum(l_discount), 4) AS mixed, 25.0::DOUBLE AS half_l1, 0.2::DOUBLE AS turned_l1, 51.0::DOUBLE AS mixed_l1, 25.0::DOUBLE AS half_l2, 0.2::DOUBLE AS turned_l2, 51.0::DOUBLE AS mixed_l2 FROM lineitem")
def _(spark, d):
    """Scales, shifts and mixes of sums before noise, with their sensitivities in both norms."""
    f = items(spark, d)
    some = [f.sum("l_quantity").multiply(0.5), f.sum("l_discount").multiply(-2).add(100), f.sum(["l_quantity", "l_discount"]).mix([[1, 10]])]
    values = [round(float(v[()][0]), 4) for v in planner.evaluate(some)]
    return rows(spark, ", ".join(f"{n}{s} double" for s in ("", "_l1", "_l2") for n in ("half", "turned", "mixed")), [(*values, *[round(a.sensitivity(norm)[0], 9) for norm in (1, 2) for a in some])])


@query("affine_histogram", "WITH c AS (SELECT count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag NOT IN ('A', 'R')) AS o FROM lineitem) SELECT 0::BIGINT AS i, a::BIGINT AS v, 6.0::DOUBLE AS l1, round(sqrt(2) / (2 * sin(pi() / 14)), 9) AS l2 FROM c UNION ALL SELECT 1, a + r, 6.0, round(sqrt(2) / (2 * sin(pi() / 14)), 9) FROM c UNION ALL SELECT 2, a + r + o, 6.0, round(sqrt(2) / (2 * sin(pi() / 14)), 9) FROM c")
def _(spark, d):
    """Running sums of a histogram under substitution: its norms times the norms of the triangle matrix."""
    f = items(spark, d, Definition(protect_floating_point=False, neighboring=SUBSTITUTE))
    a = f.histogram("l_returnflag", categories=["A", "R"], null_value="?").mix([[1, 0, 0], [1, 1, 0], [1, 1, 1]])
    values, l1, l2 = planner.evaluate([a])[0][()], a.sensitivity(1), a.sensitivity(2)
    return rows(spark, "i long, v long, l1 double, l2 double", [(i, int(v), x, round(y, 9)) for i, (v, x, y) in enumerate(zip(values, l1, l2))])


_MANY = [float(c) for c in range(1, 100_000, 250)]


@query("quantile_utilities_many", "SELECT c.range::DOUBLE AS candidate, round(count(*) * 0.7 - abs(0.7 * count(*) FILTER (l_extendedprice < c.range) - 0.3 * count(*) FILTER (l_extendedprice > c.range)), 4)::DOUBLE AS utility FROM lineitem, range(1, 100000, 250) c GROUP BY 1")
def _(spark, d):
    """400 candidates, counted as groups."""
    return rows(spark, "candidate double, utility double", list(zip(_MANY, _exact(items(spark, d).quantile("l_extendedprice", alpha=0.3, candidates=_MANY), 4))))


@query("histogram_many", "SELECT b.range::BIGINT AS bin, count(l_extendedprice)::BIGINT AS n FROM range(0, 200) b LEFT JOIN lineitem ON floor(l_extendedprice / 525) = b.range GROUP BY 1")
def _(spark, d):
    """200 bins, counted as groups."""
    return rows(spark, "bin long, n long", list(enumerate(_exact(items(spark, d).histogram("l_extendedprice", edges=[525.0 * i for i in range(201)]))[:200])))


_aggregate_query("histogram_edges", "SELECT " + ", ".join(f"count(*) FILTER (l_quantity >= {a} AND l_quantity < {a + 10})::BIGINT AS b{i}" for i, a in enumerate(range(0, 50, 10))) + ", count(*) FILTER (l_quantity >= 50)::BIGINT AS rest FROM lineitem", lambda f: f.histogram("l_quantity", edges=[0.0, 10.0, 20.0, 30.0, 40.0, 50.0]), [*[f"b{i}" for i in range(5)], "rest"], "long")
_aggregate_query("histogram_categories", "SELECT count(*) FILTER (l_returnflag = 'A')::BIGINT AS a, count(*) FILTER (l_returnflag = 'R')::BIGINT AS r, count(*) FILTER (l_returnflag NOT IN ('A', 'R'))::BIGINT AS other FROM lineitem", lambda f: f.histogram("l_returnflag", categories=["A", "R"], null_value="?"), ["a", "r", "other"], "long")


@query("quantile_by_key", "SELECT l_returnflag AS flag, round(median(l_extendedprice), 4) AS m FROM lineitem GROUP BY 1")
def _(spark, d):
    f = items(spark, d).clamp("l_returnflag", categories=["A", "N", "R"], null_value="?").partition("l_returnflag")
    a = f.new_rows(f.df, not_empty=True, keys=f.keys).median("l_extendedprice")
    return rows(spark, "flag string, m double", [(k[0], round(v[0], 4)) for k, v in planner.evaluate([a])[0].items() if not math.isnan(v[0])])


@query("theil_sen_pairs", "WITH p AS (SELECT row_number() OVER () AS i, s_suppkey::DOUBLE AS x, s_acctbal AS y FROM supplier) SELECT count(*)::BIGINT AS n, round(min((b.y - a.y) / (b.x - a.x)), 6) AS low, round(max((b.y - a.y) / (b.x - a.x)), 6) AS high FROM p a JOIN p b ON a.x < b.x")
def _(spark, d):
    f = known(table(spark, d, "supplier").clamp(["s_suppkey", "s_acctbal"], [0, -1000.0], [10000000, 10000.0]).impute(["s_suppkey", "s_acctbal"]))
    return f.theil_sen("s_suppkey", "s_acctbal", "theil-sen").df.agg(F.count(F.lit(1)).alias("n"), F.round(F.min("slope"), 6).alias("low"), F.round(F.max("slope"), 6).alias("high"))


@query("theil_sen_median", "WITH s AS (SELECT (b.o_totalprice - a.o_totalprice) / (b.o_orderkey - a.o_orderkey) AS s FROM orders a JOIN orders b ON a.o_orderkey < b.o_orderkey) SELECT count(*)::BIGINT AS pairs, round(median(s), 6) AS slope FROM s")
def _(spark, d):
    """The median slope of the lines through all pairs of orders, which are never formed."""
    f = table(spark, d, "orders").clamp(["o_orderkey", "o_totalprice"], [0, 0.0], [10**12, 1e9]).impute(["o_orderkey", "o_totalprice"])
    slopes = Slopes(f.df, F.col("o_orderkey"), F.col("o_totalprice"))
    n, found = slopes.ask(lambda first: at_places(first, lambda n: [(n - 1) // 2, n // 2]))
    return rows(spark, "pairs long, slope double", [(n, round((found[(n - 1) // 2] + found[n // 2]) / 2, 6))])


@query("theil_sen_k_match", "SELECT 5 * (count(*) // 2)::BIGINT AS n FROM supplier")
def _(spark, d):
    f = known(table(spark, d, "supplier", Definition(neighboring=SUBSTITUTE)).clamp(["s_suppkey", "s_acctbal"], [0, -1000.0], [10000000, 10000.0]).impute(["s_suppkey", "s_acctbal"]))
    return f.theil_sen("s_suppkey", "s_acctbal", k=5).df.agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- closed forms


@query("sensitivities", """WITH t AS (SELECT count(*)::DOUBLE AS n FROM lineitem) SELECT what, round(ar, 9) AS add_remove, round(sub, 9) AS substitute FROM (
SELECT 'count' AS what, 1.0::DOUBLE AS ar, 1.0::DOUBLE AS sub UNION ALL SELECT 'count_known', 0, 0 UNION ALL SELECT 'sum', 50, 60 UNION ALL SELECT 'mean', 60 / n, 60 / n FROM t
UNION ALL SELECT 'variance', 3600 * n / (n + 1) / (n - 1), 3600 * (n - 1) / n / (n - 1) FROM t UNION ALL SELECT 'covariance', 3600 * n / (n + 1) / (n - 1), 3600 * 2 * (n - 1) / n / (n - 1) FROM t
UNION ALL SELECT 'raw_moment', 2500 / n, 2500 / n FROM t UNION ALL SELECT 'quantile', 60, 60 UNION ALL SELECT 'utility', 0.7, 1 UNION ALL SELECT 'histogram', 1, 2 UNION ALL SELECT 'histogram_l2', 1, sqrt(2))""")
def _(spark, d):
    n, b = spark.read.parquet(f"{d}/lineitem.parquet").count(), (-10.0, 50.0)
    s = sensitivity
    forms = {
        "count": lambda nb: s.count(None, nb), "count_known": lambda nb: s.count(n, nb), "sum": lambda nb: s.total(b, nb), "mean": lambda nb: s.mean(b, n, nb), "variance": lambda nb: s.variance(b, n, nb), "covariance": lambda nb: s.covariance(b, b, n, nb),
        "raw_moment": lambda nb: s.raw_moment(b, 2, n, nb), "quantile": lambda nb: s.quantile(b), "utility": lambda nb: s.quantile_utility(0.3, nb), "histogram": lambda nb: s.histogram(5, n, nb), "histogram_l2": lambda nb: s.histogram(5, n, nb, 2),
    }
    return rows(spark, "what string, add_remove double, substitute double", [(k, round(f(ADD_REMOVE), 9), round(f(SUBSTITUTE), 9)) for k, f in forms.items()])


_BOUNDED = {"abs": (0.0, 3.0), "add": (0.0, 8.0), "subtract": (-7.0, 1.0), "multiply": (-10.0, 15.0), "divide": (-1.0, 1.5), "negative": (-3.0, 2.0), "modulo": (0.0, 4.0), "row_max": (2.0, 5.0), "row_min": (-2.0, 3.0)}
_X, _Y = "least(greatest(l_quantity - 25.0, -2.0), 3.0)", "least(greatest(l_linenumber::DOUBLE, 2.0), 5.0)"
_VALUE = {"abs": f"abs({_X})", "add": f"{_X} + {_Y}", "subtract": f"{_X} - {_Y}", "multiply": f"{_X} * {_Y}", "divide": f"{_X} / {_Y}", "negative": f"0 - {_X}", "modulo": f"({_X} % 4.0 + 4.0) % 4.0", "row_max": f"greatest({_X}, {_Y})", "row_min": f"least({_X}, {_Y})"}


@query("propagated_bounds", " UNION ALL ".join(f"SELECT '{op}' AS op, {low}::DOUBLE AS low, {high}::DOUBLE AS high, round(min({_VALUE[op]}), 6) AS least, round(max({_VALUE[op]}), 6) AS most FROM lineitem" for op, (low, high) in _BOUNDED.items()))
def _(spark, d):
    """What is proved of functions of two bounded columns, and the least and greatest values that occur, in one job."""
    f = table(spark, d, "lineitem", columns=["l_quantity", "l_linenumber"]).to_float("l_linenumber").subtract("x", "l_quantity", 25.0)
    f = f.clamp(["x", "l_linenumber"], [-2.0, 2.0], [3.0, 5.0]).impute(["x", "l_linenumber"])
    for op in _BOUNDED:
        f = getattr(f, op)(op, *(("x",) if op in ("abs", "negative") else ("x", 4.0) if op == "modulo" else ("x", "l_linenumber")))
    low, high = (v[()] for v in planner.evaluate([f.minimum(list(_BOUNDED)), f.maximum(list(_BOUNDED))]))
    return rows(spark, "op string, low double, high double, least double, most double", [(op, float(f.of(op).lower), float(f.of(op).upper), round(a, 6), round(b, 6)) for op, a, b in zip(_BOUNDED, low, high)])


@query("accuracies", "WITH t AS (SELECT count(*)::DOUBLE AS n FROM lineitem) SELECT what, round(v, 9) AS v FROM (SELECT 'laplace' AS what, ln(20) * 49 / n / 0.5 AS v FROM t UNION ALL SELECT 'laplace_epsilon', ln(20) * 49 / n / 3e-3 FROM t UNION ALL SELECT 'geometric', ceil(ln(20) * 2 / 0.5) UNION ALL SELECT 'gaussian_sigma', 49 / n * sqrt(2 * ln(1.25 * 20 * n)) / 0.5 FROM t UNION ALL SELECT 'snapping_grid', 2.0)")
def _(spark, d):
    """Accuracies of planned releases of the lines' mean quantity, and of counts under a multiple of their sensitivity."""
    f = known(items(spark, d))
    s, n = f.mean("l_quantity").sensitivity(1)[0], f.n
    count = OPERATORS["simple_geometric_mechanism"](f.new_rows(f.df, n=None, definition=Definition(protect_sensitivity=False)).count(), Usage(0.5), 0, 10**9, sensitivity=2.0)
    values = {
        "laplace": privacy_usage_to_accuracy(f.dp_mean(Usage(0.5), "l_quantity"), 0.05)[0], "laplace_epsilon": accuracy.laplace_usage(s, 3e-3, 0.05).epsilon, "geometric": privacy_usage_to_accuracy(count, 0.05)[0],
        "gaussian_sigma": noise.gaussian_sigma(s, 0.5, 1 / (20 * n), analytic=False), "snapping_grid": noise.snapping_parameters(0.5, 25.0)[1],
    }
    return rows(spark, "what string, v double", [(k, round(float(v), 9)) for k, v in values.items()])


_WEIGHED = [10.0, 25.0, 40.0]
_CHOICES = "t AS (SELECT count(*)::DOUBLE AS n, " + ", ".join(f"0.5 * count(*) - abs(0.5 * count(*) FILTER (l_quantity < {c}) - 0.5 * count(*) FILTER (l_quantity > {c})) AS u{i}" for i, c in enumerate(_WEIGHED)) + " FROM lineitem), u AS (" + " UNION ALL ".join(f"SELECT {i}::BIGINT AS i, u{i} AS u, n FROM t" for i in range(3)) + "), w AS (SELECT i, exp(10 / n * (u - max(u) OVER ())) AS w FROM u)"


def _utilities(spark, d) -> tuple[list[float], float]:
    """Utilities of three candidates for the median quantity, and an epsilon that tells them apart, but not too well."""
    a = items(spark, d).quantile("l_quantity", alpha=0.5, candidates=_WEIGHED)
    n, u = (v[()] for v in planner.evaluate([items(spark, d).count(), a]))
    return u, 10 / n[0]


@query("exponential_weights", f"WITH {_CHOICES} SELECT i, round(w / sum(w) OVER (), 9) AS w FROM w")
def _(spark, d):
    u, epsilon = _utilities(spark, d)
    return rows(spark, "i long, w double", [(i, round(w, 9)) for i, w in enumerate(noise.exponential_weights(u, 0.5, epsilon))])


@query("privacy_usages", """WITH t AS (SELECT 0.1 / count(*) AS dl FROM lineitem) SELECT what, round(e, 9) AS epsilon, round(d, 12) AS delta FROM (SELECT 'sequential' AS what, 0.75 AS e, 2 * dl AS d FROM t UNION ALL SELECT 'parallel', 0.5, dl FROM t UNION ALL SELECT 'spread', 0.25, dl / 2 FROM t
UNION ALL SELECT 'stability', 0.5 / 3, dl / (1 + exp(0.5) + exp(1.0)) FROM t UNION ALL SELECT 'sampled', ln((exp(0.5) - 1) / 0.25 + 1), dl / 0.25 FROM t UNION ALL SELECT 'round_trip', 0.5, dl FROM t)""")
def _(spark, d):
    """Budgets whose delta is a tenth of one over the number of lines."""
    delta = 0.1 / known(table(spark, d, "lineitem")).n
    u, v = Usage(0.5, delta), Usage(0.25, delta)
    values = {"sequential": sequential([u, v]), "parallel": parallel([u, v]), "spread": u.spread(2)[0], "stability": effective(u, 3), "sampled": effective(u, sample=0.25), "round_trip": actual(effective(u, 2, 2, 0.5), 2, 2, 0.5)}
    return rows(spark, "what string, epsilon double, delta double", [(k, round(x.epsilon, 9), round(x.delta, 12)) for k, x in values.items()])


#: SQL of the source noise.Seeded: draw c of a seed that ends with a flag and i. hex: 16 digits; u: a uniform number.
_HEX, _UNIFORM = "substr(md5('{s}' || f || {i} || '|' || ({c})), 1, 16)", "((('0x' || substr(md5('{s}' || f || {i} || '|' || ({c})), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"
_u = lambda s, c: _UNIFORM.format(s=s, i="i", c=c)
#: A Bernoulli draw is the bit of p at the place of the first one among 64 fair bits.
_bit = lambda s, c, p: f"(floor({p} * pow(2, 65 - length(ltrim(bin(('0x' || {_HEX.format(s=s, i='i', c=c)})::UBIGINT), '0')))) % 2 = 1)"
_FLAGS = "s AS (SELECT l_returnflag AS f, sum(l_quantity) AS v, count(*) AS n, avg(l_quantity) AS m FROM lineitem GROUP BY 1), r AS (SELECT *, i FROM s, range(20) t(i))"


def _seeded(name: str, sql: str, kind: str, build: Callable, draw: Callable):
    """Twenty seeded draws of a mechanism's noise on an exact value of each flag of lineitem."""

    @query(name, sql)
    def run(spark, d):
        f = items(spark, d).clamp("l_returnflag", categories=["A", "N", "R"], null_value="?").partition("l_returnflag")
        found = planner.evaluate([build(f.new_rows(f.df, not_empty=True))])[0]
        return rows(spark, f"f string, i long, v {kind}", [(k, i, draw(found[k,][0], f"{k}{i}")) for k in "ANR" for i in range(20)])


_seeded("laplace_seeded", f"WITH {_FLAGS} SELECT f, i::BIGINT AS i, round(v - 100.0 * sign({_u('demo', 0)} - 0.5) * ln(1 - 2 * abs({_u('demo', 0)} - 0.5)), 6) AS v FROM r", "double", lambda f: f.sum("l_quantity"), lambda v, s: round(noise.laplace(v, 50.0, 0.5, noise.Seeded(f"demo{s}")), 6))
_seeded("gaussian_seeded", f"WITH {_FLAGS} SELECT f, i::BIGINT AS i, round(v + 50 * sqrt(2 * ln(1.25 / 1e-5)) / 0.5 * sqrt(-2 * ln({_u('normal', 0)})) * cos(2 * pi() * {_u('normal', 1)}), 5) AS v FROM r", "double", lambda f: f.sum("l_quantity"), lambda v, s: round(noise.gaussian(v, 50.0, 0.5, 1e-5, noise.Seeded(f"normal{s}"), analytic=False), 5))
_seeded("geometric_seeded", f"""WITH {_FLAGS}, p AS (SELECT exp(-0.5) AS alpha), z AS (SELECT f, i, n, {_bit('whole', 0, '((1 - alpha) / (1 + alpha))')} AS zero, CASE WHEN {_HEX.format(s='whole', i='i', c=1)} >= '8' THEN 1 ELSE -1 END AS sign FROM r, p),
t AS (SELECT f, i, min(k) AS size FROM r, range(1, 90) s(k), p WHERE {_bit('whole', 'k + 1', '(1 - alpha)')} GROUP BY f, i)
SELECT f, i::BIGINT AS i, least(greatest(CASE WHEN zero THEN n ELSE n + sign * size END, 0), 1000000000)::BIGINT AS v FROM z JOIN t USING (f, i)""", "long", lambda f: f.count(), lambda v, s: noise.simple_geometric(v, 1.0, 0.5, 0, 10**9, noise.Seeded(f"whole{s}")))
_seeded("snapping_seeded", f"""WITH {_FLAGS} SELECT f, i::BIGINT AS i, (least(greatest(2 * floor(abs(x) / 2 + 0.5) * sign(x), -25), 25) * 1.0 + 25)::DOUBLE AS v FROM (
SELECT f, i, m - 25 + ln({_u('grid', 0)}) / 0.6 * CASE WHEN {_HEX.format(s='grid', i='i', c=1)} >= '8' THEN 1 ELSE -1 END AS x FROM r)""", "double", lambda f: f.mean("l_quantity"), lambda v, s: noise.snapping(v, 1.0, 0.6, 0.0, 50.0, noise.Seeded(f"grid{s}")))  # fmt: skip


@query("exponential_seeded", f"WITH {_CHOICES}, c AS (SELECT i AS k, sum(w) OVER (ORDER BY i) / sum(w) OVER () AS reached FROM w), r AS (SELECT i, '' AS f FROM range(40) t(i)) SELECT i::BIGINT AS i, min(k)::BIGINT AS choice FROM r, c WHERE {_u('choice', 0)} < reached GROUP BY i")
def _(spark, d):
    u, epsilon = _utilities(spark, d)
    return rows(spark, "i long, choice long", [(i, noise.exponential(u, [0, 1, 2], 0.5, epsilon, noise.Seeded(f"choice{i}"))) for i in range(40)])


# ---------------------------------------------------------------- releases


#: Draws by which the spread of a mechanism's noise is judged.
DRAWS = 40


def _release_query(name: str, build: Callable, epsilon: float = 1.0, near: Callable | None = None, definition: Definition = SOFT, n_known: bool = True, differ: bool = True):
    """One row: the budget, and whether the release holds: its values are near the exact ones, and DRAWS more draws of its
    noise have the spread that their scale asks for (odds against: below e^-20). With near: the released values pass it,
    and further draws are not all the same."""

    @query(name, f"SELECT '{name}' AS statistic, {epsilon}::DOUBLE AS epsilon, true AS holds")
    def run(spark, d):
        f = items(spark, d, definition)
        planned = build(known(f) if n_known else f)
        value = planner.release([planned])[0]
        flat = [float(v) for v in (value.ravel().tolist() if hasattr(value, "ravel") else value if isinstance(value, (list, tuple)) else [value])]
        aggregate, draw = planned.parts[0]
        if aggregate.name != "gumbel_median":
            exact = planner.evaluate([aggregate])[0][()]
            more = [draw(exact) for _ in range(DRAWS)]
            holds = not differ or len({str(m) for m in more}) > 1
        else:
            holds = True
        if near is None:
            scale = [max(s, 1e-12) * max(1, len(exact)) / epsilon for s in planned.arguments["sensitivity"]]
            if name == "dp_histogram":
                scale = [s / epsilon for s in planned.arguments["sensitivity"]]
            if hasattr(value, "ravel"):
                flat = [float(value[i, j]) for i in range(value.shape[0]) for j in range(i, value.shape[1])]
            holds &= all(abs(a - b) <= NEAR * s + 1e-9 for a, b, s in zip(flat, exact, scale, strict=True))
            spread = [sum(abs(float(m[i]) - float(exact[i])) for m in more) / DRAWS for i in range(len(exact))]
            inside = [float(x) != float(b) for x, b in zip(exact, planned.arguments.get("lower") or [math.nan] * len(exact))]  # at a bound, half the noise is cut
            holds &= all(s / 5 <= w <= 5 * s for w, s, i in zip(spread, scale, inside) if i)
        else:
            holds &= near(flat, f) if name == "dp_linear_regression" else near(flat)
        return rows(spark, "statistic string, epsilon double, holds boolean", [(name, round(planned.usage.epsilon, 9), holds)])


def _lined(f: PrivateFrame) -> PrivateFrame:
    """With y, a line of the quantity about which the discount scatters."""
    return f.multiply("y", "l_quantity", 40.0).multiply("far", "l_discount", 1000.0).add("y", "y", "far")


def _plain_line(f: PrivateFrame) -> list[float]:
    """The medians of slopes and intercepts of other, seeded matchings, without noise."""
    lines = _lined(known(f)).theil_sen("l_quantity", "y", k=5, rng=noise.Seeded("plain"))
    middle = lambda first: at_places(first, lambda n: [n // 2])
    return [next(iter(found[()][1].values())) for found in ask(lines.df, [("slope", None), ("intercept", None)], [], [()], [(0, middle), (1, middle)])]


_inside = lambda low, high: lambda v: all(low <= x <= high for x in v)
_release_query("laplace_mechanism", lambda f: _mech("laplace_mechanism", f.mean("l_quantity"), Usage(1.0)))
_release_query("gaussian_mechanism", lambda f: _mech("gaussian_mechanism", f.mean("l_quantity"), Usage(1.0, 1e-7)), near=_inside(20, 31))
_release_query("simple_geometric_mechanism", lambda f: _mech("simple_geometric_mechanism", f.count(), Usage(1.0), lower=0, upper=10**9), n_known=False)
_release_query("snapping_mechanism", lambda f: _mech("snapping_mechanism", f.mean("l_quantity"), Usage(1.0), lower=1.0, upper=50.0), near=_inside(20, 31), definition=Definition())
_release_query("exponential_mechanism", lambda f: _mech("exponential_mechanism", f.quantile("l_quantity", alpha=0.5, candidates=[1.0, 25.0, 26.0, 49.0]), Usage(1.0)), near=_inside(25, 26), differ=False)
_release_query("dp_gumbel_median", lambda f: f.dp_gumbel_median("l_quantity", Usage(1.0), 1.0, 50.0), near=_inside(24, 27))
_release_query("dp_count", lambda f: f.dp_count(Usage(1.0), upper=10**9), n_known=False)
_release_query("dp_sum", lambda f: f.dp_sum(Usage(1.0), "l_quantity"))
_release_query("dp_mean", lambda f: f.dp_mean(Usage(1.0), _QP))
_release_query("dp_mean_snapping", lambda f: f.dp_mean(Usage(1.0), "l_quantity"), near=_inside(20, 31), definition=Definition())
_release_query("dp_mean_plugin", lambda f: f.dp_mean(Usage(1.0), "l_quantity", implementation="plug-in", count_upper=10**9), near=_inside(20, 31), n_known=False)
_release_query("dp_variance", lambda f: f.dp_variance(Usage(1.0), "l_quantity"))
_release_query("dp_covariance", lambda f: f.dp_covariance(Usage(1.0), _QP))
_release_query("dp_raw_moment", lambda f: f.dp_raw_moment(Usage(1.0), "l_quantity", order=2))
_release_query("dp_quantile", lambda f: f.dp_quantile(Usage(1.0), "l_quantity", alpha=0.3))
_release_query("dp_median", lambda f: f.dp_median(Usage(1.0), "l_quantity", candidates=[1.0, 25.0, 26.0, 49.0]), near=_inside(25, 26), differ=False)
_release_query("dp_median_gumbel", lambda f: f.dp_median(Usage(1.0), "l_quantity", lower=1.0, upper=50.0, mechanism="gumbel"), near=_inside(24, 27))
_release_query("dp_median_columns", lambda f: f.dp_median(Usage(1.0), ["l_quantity", "l_discount"], candidates=[[1.0, 25.0, 26.0, 49.0], [0.0, 0.05, 0.1]]), near=lambda v: v[0] in (25.0, 26.0) and v[1] == 0.05, differ=False)
_release_query("dp_median_gumbel_columns", lambda f: f.dp_median(Usage(1.0), ["l_quantity", "l_discount"], lower=[1.0, 0.0], upper=[50.0, 0.1], mechanism="gumbel"), near=lambda v: 24 <= v[0] <= 27 and 0.03 <= v[1] <= 0.07)
_release_query("dp_median_constant_time", lambda f: f.dp_gumbel_median("l_quantity", Usage(1.0), 1.0, 50.0, enforce_constant_time=True), near=_inside(24, 27))
_release_query("dp_minimum", lambda f: f.dp_minimum(Usage(1.0), "l_quantity"))
_release_query("dp_maximum", lambda f: f.dp_maximum(Usage(1.0), "l_quantity"))
_release_query("dp_histogram", lambda f: f.dp_histogram(Usage(1.0), "l_returnflag", categories=["A", "N", "R"], null_value="?", upper=10**9), n_known=False)
_release_query("dp_linear_regression", lambda f: _lined(f).dp_linear_regression(Usage(1.0), "l_quantity", "y", 0.0, 200.0, -100.0, 400.0), near=lambda v, f: all(abs(a - b) <= 0.05 * abs(b) for a, b in zip(v, _plain_line(f))) and abs(v[0] - 40) < 2)


def _mech(name: str, aggregate, usage, **more):
    from hushframe.plans.registry import OPERATORS

    return OPERATORS[name](aggregate, usage, **more)


@query("noisy_stats_regression", "SELECT 2::BIGINT AS n, true AS holds")
def _(spark, d):
    """A budget of 100, so that the values at 0.25 and 0.75 must lie near the mean of an unrelated column."""
    f = table(spark, d, "lineitem").clamp(["l_discount", "l_tax"], 0.0, 1.0).impute(["l_discount", "l_tax"])
    v = planner.release([known(f).noisy_stats_regression(Usage(100.0), "l_discount", "l_tax")])[0]
    return rows(spark, "n long, holds boolean", [(len(v), all(abs(x - 0.04) < 0.2 for x in v))])


@query("analysis_report", "SELECT 'dp_mean' AS statistic, 'l_quantity' AS variable, 'Laplace' AS mechanism, 0.4::DOUBLE AS epsilon UNION ALL SELECT 'dp_count', '', 'SimpleGeometric', 0.3")
def _(spark, d):
    a = Analysis(spark, SOFT)
    x = a.parquet(f"{d}/lineitem.parquet").clamp("l_quantity", 1.0, 50.0).impute("l_quantity").index("l_quantity").resize(number_rows=500)
    x.dp_mean(Usage(0.4))
    x.dp_count(Usage(0.3))
    a.release()
    return rows(spark, "statistic string, variable string, mechanism string, epsilon double", [(r["statistic"], ",".join(r["variables"]), r["mechanism"], r["privacyLoss"]["epsilon"]) for r in json.loads(a.report())])


@query("public_release", "SELECT count(*)::BIGINT AS n, round(avg(r_regionkey), 6) AS mean, count(*)::BIGINT AS records FROM region")
def _(spark, d):
    """Public data leaves as it is, and costs nothing."""
    a = Analysis(spark, SOFT)
    x = a.parquet(f"{d}/region.parquet", public=True).to_float("r_regionkey").clamp("r_regionkey", 0.0, 100.0).impute("r_regionkey")
    n, m = x.count(), x.mean("r_regionkey")
    got = a.release(n, m, x)
    assert a.privacy_usage() == Usage(0.0)
    return rows(spark, "n long, mean double, records long", [(got[n.id][0], round(got[m.id][0], 6), got[x.id].count())])


@query("expansion", "SELECT * FROM (VALUES ('count', 'Laplace', 1.0::DOUBLE, 0.25::DOUBLE), ('sum', 'Laplace', 50.0, 0.25)) t(aggregate, mechanism, sensitivity, epsilon)")
def _(spark, d):
    """What a private statistic is made of: a plug-in mean of rows of which an individual may have two."""
    a = Analysis(spark, SOFT)
    x = a.parquet(f"{d}/lineitem.parquet", rows_per_individual=2).clamp("l_quantity", 1.0, 50.0).impute("l_quantity")
    parts = a.expand(x.dp_mean(Usage(1.0), "l_quantity", implementation="plug-in", count_upper=10**7))
    return rows(spark, "aggregate string, mechanism string, sensitivity double, epsilon double", [(p["aggregate"], p["mechanism"], p["sensitivity"][0], p["epsilon"][0]) for p in parts])


@query("partitioned_release", "SELECT k AS flag, 0.5::DOUBLE AS epsilon, true AS holds FROM (VALUES ('A'), ('N'), ('R'), ('?')) v(k)")
def _(spark, d):
    f = items(spark, d).clamp("l_returnflag", categories=["A", "N", "R"], null_value="?").partition("l_returnflag")
    planned = f.dp_count(Usage(0.5), upper=10**9)
    exact = planner.evaluate([f.count()])[0]
    return rows(spark, "flag string, epsilon double, holds boolean", [(k[0], planned.usage.epsilon, abs(v[0] - exact[k][0]) <= NEAR / 0.5) for k, v in planner.release([planned])[0].items()])


@query("weighted_draw", "SELECT true AS holds")
def _(spark, d):
    """Shares of a weighted draw over all lines."""
    df = spark.read.parquet(f"{d}/lineitem.parquet").select(preprocess.weighted(["a", "b"], [1.0, 3.0], F.rand(7)).alias("c"))
    r = df.agg(F.avg((F.col("c") == "b").cast("double")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    return rows(spark, "holds boolean", [(abs(r["p"] - 0.75) < 8 * math.sqrt(0.1875 / r["n"]),)])
