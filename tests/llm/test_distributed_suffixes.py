"""The difference cover as a plain distributed sort: every suffix a row, every step a shuffle of all rows.

It checks the operator's suffix sorting on whole tables, and is what the README's figures of that form were measured on.
Triples at places 1 and 2 modulo 3 are named by a distributed sort of the distinct ones, the names' string is sorted in the
same way while it stands for fewer bytes than are asked for, places 0 modulo 3 follow from a symbol and a rank, and all are
merged by running numbers of sorted unions.
"""

import json
import time
import urllib.request

import pytest
from pyspark.sql import functions as F

from hushframe.llm import substrings
from hushframe.operators.structure import numbering
from hushframe.plans.shared import written


def dense(df, key):
    """df with name: the dense rank (from 1) of columns key."""
    names = numbering(df.select(*key).distinct(), key).withColumn("name", F.col("__n") + 1).drop("__n")
    return df.join(names, key)


def suffix_ranks(symbols, depth, covered=1):
    """(i, rank) of a string (i, s: symbols over 0), in order of at least depth bytes; ties in any order."""
    at = {k: symbols.select((F.col("i") - k).alias("i"), F.col("s").alias(f"s{k}")) for k in (1, 2)}
    rows = symbols.join(at[1], "i", "left").join(at[2], "i", "left").fillna(0, ["s1", "s2"]).withColumn("m", F.col("i") % 3)
    rows = written(rows, "triples")
    sample = written(dense(rows.where("m > 0"), ["s", "s1", "s2"]).select("i", "m", "name"), "named")
    n, kinds = sample.count(), sample.agg(F.max("name")).first()[0] or 0
    if kinds < n and 3 * covered < depth:
        ones = sample.where("m = 1").count()  # the names of places 1, a zero, those of places 2
        place = F.when(F.col("m") == 1, F.floor(F.col("i") / 3)).otherwise(F.floor(F.col("i") / 3) + ones + 1)
        deeper = suffix_ranks(sample.select(place.alias("i"), F.col("name").alias("s")), depth, 3 * covered)
        sample = sample.withColumn("j", place).drop("name").join(deeper.select(F.col("i").alias("j"), (F.col("rank") + 1).alias("name")), "j").drop("j")
    ranks = written(numbering(sample, ["name"]).select("i", "m", F.col("__n").alias("r")), "ranks")  # of the sample
    # ties get the same key in what follows, so that merges agree with each other
    after = ranks.join(sample.select("i", F.col("name").alias("k")), "i")
    zeros = rows.where("m = 0").join(after.select((F.col("i") - 1).alias("i"), F.col("k").alias("k1")), "i", "left").join(after.select((F.col("i") - 2).alias("i"), F.col("k").alias("k2")), "i", "left").fillna(0, ["k1", "k2"])
    zeros = written(numbering(zeros, ["s", "k1"]).withColumnRenamed("__n", "own"), "zeros")
    ones = rows.where("m = 1").join(after.select((F.col("i") - 1).alias("i"), F.col("k").alias("k1")), "i", "left").join(ranks.select("i", "r"), "i").fillna(0, ["k1"])
    twos = rows.where("m = 2").join(after.select((F.col("i") - 2).alias("i"), F.col("k").alias("k2")), "i", "left").join(ranks.select("i", "r"), "i").fillna(0, ["k2"])
    before = []
    for others, key in ((ones, ["s", "k1"]), (twos, ["s", "s1", "k2"])):
        both = others.select("i", *key, F.col("r").alias("own"), F.lit(0).alias("z")).unionByName(zeros.select("i", *key, "own", F.lit(1).alias("z")))
        before.append(numbering(both, [*key, "z", "own"]))
    sums = [numbering(b.where("z = 1").drop("__n"), ["own"]).select("i", "own", F.col("__n").alias("k")).join(b.where("z = 1").select("i", F.col("__n").alias("all")), "i").select("i", "own", (F.col("all") - F.col("k")).alias(f"b{j}")) for j, b in enumerate(before)]
    placed = sums[0].join(sums[1].drop("own"), "i").withColumn("at", F.col("own") + F.col("b0") + F.col("b1"))
    rest = numbering(placed.select("i", "at", F.lit(0).alias("z")).unionByName(ranks.select("i", F.col("r").alias("at"), F.lit(1).alias("z"))).where("z = 1").drop("z"), ["at"])
    # places that zeros leave free, in order, are the sample's
    total = symbols.count()
    free = symbols.sparkSession.range(total).join(placed.select(F.col("at").alias("id")), "id", "left_anti")
    free = numbering(free, ["id"])
    others = rest.select("i", F.col("__n").alias("k")).join(free.select(F.col("__n").alias("k"), "id"), "k").select("i", F.col("id").alias("rank"))
    return written(placed.select("i", F.col("at").alias("rank")).unionByName(others), "order")


@pytest.mark.parametrize("text", ["abracadabra abracadabra", "aaaaaaaaaaaaa"])
def test_distributed_difference_cover(spark, text):
    import numpy as np

    s = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
    df = spark.createDataFrame([(i, int(c)) for i, c in enumerate(s)], "i long, s long")
    order = [r["i"] for r in suffix_ranks(df, 10**9).orderBy("rank").collect()]
    assert order == sorted(range(len(s)), key=lambda i: text[i:]) == substrings.suffix_array(s, 10**9).tolist()


if __name__ == "__main__":  # figures of this form: python -m tests.llm.test_distributed_suffixes BYTES
    import sys

    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[8]").config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "16").getOrCreate()
    docs = session.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    whole = "\n".join(r["text"] or "" for r in docs).encode()[: int(sys.argv[1])]
    began = time.time()
    frame = session.createDataFrame([(i, c + 1) for i, c in enumerate(whole)], "i long, s long").repartition(16)
    print("rows", suffix_ranks(frame, 50).count(), "seconds", round(time.time() - began, 1))
    port = session.sparkContext.uiWebUrl.rsplit(":", 1)[1]
    with urllib.request.urlopen(f"http://localhost:{port}/api/v1/applications/{session.sparkContext.applicationId}/stages") as f:
        stages = json.load(f)
    print("bytes in", len(whole), "shuffled", sum(s["shuffleWriteBytes"] for s in stages), "written", sum(s["outputBytes"] for s in stages), "task CPU seconds", round(sum(s["executorCpuTime"] for s in stages) / 1e9, 1))
