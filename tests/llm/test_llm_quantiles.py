import math

import numpy as np
import pytest

from vecquarry.llm import quantiles as Q


@pytest.mark.parametrize("seed,shape", [(0, "uniform"), (1, "lognormal"), (2, "sorted"), (3, "falling"), (4, "steps")])
def test_relative_rank_error(seed, shape):
    rng = np.random.default_rng(seed)
    n = 400_000
    x = {"uniform": rng.random(n), "lognormal": rng.lognormal(0, 2, n), "sorted": np.arange(n) * 1.0, "falling": -np.arange(n) * 1.0, "steps": rng.integers(0, 50, n) * 1.0}[shape]
    parts = [Q.RelativeSketch().update(p) for p in np.array_split(x, 37)]
    whole = Q.RelativeSketch()
    for p in parts:
        whole.merge(Q.RelativeSketch.from_bytes(p.to_bytes()))
    assert whole.n == n and len(whole.to_bytes()) < 200_000
    x = np.sort(x)
    for p in (0.01, 0.25, 0.5, 0.9, 0.99, 0.999, 0.9999):
        v = whole.quantiles([p])[0]
        low, high = np.searchsorted(x, v, "left"), np.searchsorted(x, v, "right")
        off = max(0, low - p * n, p * n - high)
        assert off <= 0.005 * (1 - p) * n + 1, (shape, p, off)  # relative to the distance from the top


@pytest.mark.parametrize("parts,size", [(4000, 780), (2000, 1000), (300, 2500)])
def test_errors_of_many_parts_do_not_add_up(parts, size):
    x = np.random.default_rng(parts).lognormal(0, 2, parts * size)
    whole = Q.RelativeSketch()
    for p in x.reshape(parts, size):
        whole.merge(Q.RelativeSketch().update(p))
    x.sort()
    for p in (0.1, 0.5, 0.9, 0.99, 0.999):
        assert abs(np.searchsorted(x, whole.quantiles([p])[0], "right") - p * len(x)) <= 0.003 * (1 - p) * len(x) + 1


def test_small_sketches_are_exact():
    x = np.random.default_rng(1).random(300)
    s = Q.RelativeSketch().update(x[:100]).update(x[100:])
    for p in (0.0, 0.5, 0.99, 1.0):
        assert s.quantiles([p])[0] == np.sort(x)[max(0, math.ceil(p * 300 - 1e-9) - 1)]
    assert Q.RelativeSketch().quantiles([0.5]) == [None] and Q.RelativeSketch.from_bytes(Q.RelativeSketch().to_bytes()).n == 0


def test_days_combine(spark):
    rng = np.random.default_rng(2)
    rows = [(g, d, float(v)) for g, size in (("hot", 5000), ("b", 40), (None, 30)) for d in range(3) for v in rng.lognormal(0, 1, size)]
    odd = [("b", 0, None), ("b", 0, float("nan")), ("b", 0, float("inf")), ("none", 0, None)]
    df = spark.createDataFrame(rows + odd, "g string, day int, v double").repartition(5)
    days = Q.merge_sketches(Q.sketches(df, ["g", "day"], "v"), ["g", "day"])
    assert days.count() == 9
    got = {r["g"]: (r["n"], r["quantiles"]) for r in Q.sketch_quantiles(Q.merge_sketches(days, ["g"]), ["g"], [0.5, 0.99]).collect()}
    assert set(got) == {"hot", "b", None}
    for g, (n, q) in got.items():
        x = np.sort([v for h, _, v in rows if h == g])
        assert n == len(x)
        for p, v in zip((0.5, 0.99), q):
            assert abs(np.searchsorted(x, v) - p * n) <= 0.005 * n + 1
    assert Q.merge_sketches(Q.sketches(df.limit(0), ["g"], "v"), ["g"]).count() == 0


def test_repeats_count_once(spark):
    columns = "dataset string, query_index bigint, k int, algorithm string, params string, time float, recall double, build_time double, index_size double, measured_at timestamp_ntz"
    from datetime import datetime

    at = datetime(2025, 1, 1)
    one = ("d", 1, 10, "a", "p", 0.5, None, 5.0, 1.0, at)
    rows = [one, one, ("d", 1, 10, "a", "p", 0.5, 5.0, None, 1.0, at), ("d", 1, 10, "a", "p", -1.0, 5.0, None, 1.0, at), (None, *one[1:]), ("d", 1, 10, None, "p", 0.5, None, 5.0, 1.0, at), (*one[:5], None, *one[6:]), (*one[:5], float("nan"), *one[6:])]
    assert Q.measured_times(spark.createDataFrame(rows, columns)).count() == 3
