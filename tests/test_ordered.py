import random

import pytest
from pyspark.sql import functions as F

from vecquarry.operators.ordered import positions, prefix_sums


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    groups = ["hot"] * 700 + [None] * 90 + [f"g{i}" for i in range(40)] * 5
    return [(g, rng.randrange(30), i, rng.randrange(5)) for i, g in enumerate(groups)]


def _expected(rows):
    out, seen = {}, {}
    for g, v, i, w in sorted(rows, key=lambda r: (r[0] or "", -r[1], r[2])):
        n, s = seen.get(g, (0, 0))
        seen[g] = out[i] = (n + 1, s + w)
    return out


def test_positions_and_sums_span_partitions(spark, rows):
    df = spark.createDataFrame(rows, "g string, v int, i int, w int").repartition(7)
    got = prefix_sums(df, ["g"], [F.col("v").desc(), F.col("i").asc()], {"n": F.lit(1).cast("bigint"), "s": F.col("w").cast("bigint")}, partitions=9)
    assert {r["i"]: (r["n"], r["s"]) for r in got.collect()} == _expected(rows)


def test_kept_positions_are_exact(spark, rows):
    df = spark.createDataFrame(rows, "g string, v int, i int, w int")
    got = positions(df, ["g"], [F.col("v").desc(), F.col("i").asc()], keep=4, partitions=9).filter("position <= 4")
    assert {r["i"]: r["position"] for r in got.collect()} == {i: n for i, (n, _) in _expected(rows).items() if n <= 4}


def test_no_group_and_no_rows(spark):
    df = spark.range(100).repartition(5)
    assert [r["position"] for r in positions(df, [], [F.col("id").asc()], partitions=6).orderBy("id").collect()] == list(range(1, 101))
    assert positions(df.filter("id < 0"), ["id"], [F.col("id").asc()]).count() == 0


@pytest.mark.parametrize("partitions", [1, 9, 60])
def test_sums_before_ties_span_partitions(spark, rows, partitions):
    df = spark.createDataFrame(rows, "g string, v int, i int, w int").repartition(7)
    alike = df.withColumn("v", F.when(F.col("g") == "hot", F.col("v") % 2).otherwise(F.col("v"))).withColumn("v", F.nullif("v", F.lit(1)))
    got = prefix_sums(alike, ["g"], [F.col("v").desc_nulls_last(), F.col("i").asc()], {"n": F.lit(1).cast("bigint"), "s": F.col("w").cast("bigint")}, ties=["v"], partitions=partitions).collect()
    assert len(got) == len(rows)
    below = lambda v: (v is None, 0 if v is None else -v)
    for g in {r["g"] for r in got}:
        own = [r for r in got if r["g"] == g]
        for r in own:
            before = [x for x in own if below(x["v"]) < below(r["v"])]
            assert (r["n"], r["s"]) == (len(before), sum(x["w"] for x in before))
