import random

import pytest
from pyspark.sql import functions as F

from vecquarry.llm import summaries
from vecquarry.llm.leximin import leximin
from vecquarry.llm.topn import top_n

SCHEMA = "g string, k int, item string, fast double, small double, extra string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    number = lambda: rng.choice([None, float("nan"), float("inf"), 0.0, -0.0, *map(float, range(20))])
    groups = ["hot"] * 300 + ["a", "b"] * 40 + [None] * 5
    return [(g, rng.choice([1, None]) if g == "b" else 1, f"i{i:03}", number(), number(), "x") for i, g in enumerate(groups)]


def brute(rows):
    out, groups = {}, {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            groups.setdefault(r[:2], []).append(r)
    for members in groups.values():
        value = lambda v, s: -float("inf") if v is None or v != v else s * v
        none = lambda v: v is None or v != v
        better = {}
        for r in members:
            better[r[2]] = [sum((not none(o[c])) and (none(r[c]) or value(o[c], s) > value(r[c], s)) for o in members) for c, s in ((3, 1), (4, -1))]
        for place, i in enumerate(sorted(better, key=lambda i: (sorted(better[i], reverse=True), i)), 1):
            out[i] = (place, better[i], len(members))
    return out


def test_leximin(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = leximin(df, ["g", "k"], {"fast": 1, "small": -1}, ["item"])
    assert got.columns[:6] == df.columns
    assert {r["item"]: (r["rank"], list(r["better"]), r["n"]) for r in got.collect()} == brute(rows)
    for r in got.limit(20).collect():
        assert r["percentiles"] == sorted(1 - b / r["n"] for b in r["better"])


def test_leximin_is_not_led_by_the_largest_range(spark):
    rows = [("g", 1, "even", 50.0, 2.0, ""), ("g", 1, "lopsided", 1e9, 9.0, ""), ("g", 1, "poor", 1.0, 3.0, "")]
    got = leximin(spark.createDataFrame(rows, SCHEMA), ["g", "k"], {"fast": 1, "small": -1}, ["item"])
    assert [r["item"] for r in got.orderBy("rank").collect()][0] == "even"


def test_leximin_repeats_empty_and_clashes(spark, rows):
    df = spark.createDataFrame(rows[:1] * 3, SCHEMA)
    assert sorted(r["rank"] for r in leximin(df, ["g"], {"fast": 1}, ["item"]).collect()) == [1, 2, 3]
    assert leximin(df.limit(0), ["g"], {"fast": 1}, ["item"]).count() == 0
    with pytest.raises(ValueError):
        leximin(df.withColumn("rank", F.lit(1)), ["g"], {"fast": 1}, ["item"])


def test_top_n(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    order = [F.col("fast").desc_nulls_last(), F.col("item").asc()]
    got = {}
    for r in top_n(df, ["g"], order, 4).orderBy("position").collect():
        got.setdefault(r["g"], []).append(r["item"])
    # NaN is above every number, nulls come last
    key = lambda r: (r[3] is None, not (r[3] is not None and r[3] != r[3]), -(r[3] if r[3] is not None and r[3] == r[3] else 0), r[2])
    want = {}
    for r in sorted(rows, key=key):
        want.setdefault(r[0], []).append(r[2])
    assert got == {g: i[:4] for g, i in want.items()}
    assert top_n(df.limit(0), ["g"], order, 4).count() == 0 and top_n(df, ["item"], order, 9).count() == len(rows)
    for bad in (lambda: top_n(df, ["g"], order, 0), lambda: top_n(df, ["g"], order, 1, "item")):
        with pytest.raises(ValueError):
            bad()


def test_sound_configurations(spark):
    fields = "k int, dataset string, algorithm string, params string, qps double, recall double, build_time double, index_size double, run_at string, exported_at string"
    base = (10, "d", "a", "p", 1.0, 0.5, 1.0, 1.0, "r")
    bad = [(10, None, "a", "p", 1.0, 0.5), (10, "d", None, "p", 1.0, 0.5), *[(10, "d", "a", "p", q, 0.5) for q in (None, 0.0, -1.0, float("nan"), float("inf"))], *[(10, "d", "a", "p", 1.0, r) for r in (None, 95.0, -0.1, float("nan"))]]
    rows = [(*base, "e1"), (*base, "e2"), (*base, "e2"), *[(*b, 1.0, 1.0, "r", "e") for b in bad]]
    assert summaries.sound(spark.createDataFrame(rows, fields)).count() == 1
