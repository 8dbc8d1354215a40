import random

import numpy as np
import pytest

from vecquarry.operators import ranks, significance, stats


@pytest.fixture(scope="module")
def summary(spark):
    rng = random.Random(1)
    rows = [(10, f"d{i % 3}{'-ip' if i % 3 == 0 else ''}", f"a{i % 4}", f"p{i}", float(rng.randrange(1, 40)), rng.randrange(80, 101) / 100, float(i)) for i in range(240)]
    return rows, spark.createDataFrame(rows, "k int, dataset string, algorithm string, params string, qps double, recall double, build_time double").cache()


def test_fastest_drops_shared_first_places(spark):
    df = spark.createDataFrame([(1, "d", "a", "x", 5.0, 0.9), (1, "d", "a", "y", 5.0, 0.9), (1, "d", "b", "z", 4.0, 0.9), (1, "d", "b", "w", 9.0, 0.1)], "k int, dataset string, algorithm string, params string, qps double, recall double")
    assert [r["params"] for r in ranks.fastest_at(df, 0.9, 1).collect()] == ["z"]


def test_front_equals_pairwise_definition(spark, summary):
    rows, df = summary
    beaten = lambda a: any(b[1:3] == a[1:3] and b[4] >= a[4] and b[5] >= a[5] and (b[4] > a[4] or b[5] > a[5]) for b in rows)
    assert {r["params"] for r in ranks.pareto_front(df, ["dataset", "algorithm"]).collect()} == {r[3] for r in rows if not beaten(r)}
    odd = spark.createDataFrame([("g", 1.0, 1.0), ("g", 1.0, 1.0), (None, 1.0, 0.5), ("g", float("nan"), 2.0), ("g", None, 2.0)], "g string, qps double, recall double")
    assert ranks.pareto_front(odd, ["g"]).count() == 3


def test_scores_and_tables(summary):
    rows, df = summary
    score = {r["algorithm"]: r["score"] for r in ranks.radar_score(df, 0.9, 10).collect()}
    assert set(score) == {"a0", "a1", "a2", "a3"} and all(0 <= s <= 1 for s in score.values())
    t = ranks.metric_table(df, "build_time", 0.8, 10, ["d1", "d2"]).collect()
    assert len(t) == 4 and sum(r["average_rank"] for r in t) == pytest.approx(10)
    places = [r["place"] for r in ranks.legend_order(df, 0.99).collect()]
    assert sorted(places) == [1, 2, 3, 4]


def test_difficulty_bands_are_uneven(spark):
    detail = spark.createDataFrame([("d", q, "a", "p", 0.5 + (q > 899) * 0.25, 0.1) for q in range(1000)], "dataset string, query_index bigint, algorithm string, params string, recall double, time double")
    contrast = spark.createDataFrame([("d", q, float(-q)) for q in range(1000)], "dataset string, query_index bigint, rc100 double")
    r = ranks.difficulty_split(detail, contrast, detail).first()
    assert r["easy"] == 0.5 and r["difficult"] == pytest.approx(0.5 + 0.25 * 100 / 101)


def test_holm(spark):
    df = spark.createDataFrame([("d", c, p) for c, p in zip("abcd", (0.01, 0.04, 0.03, 0.9))], "dataset string, x string, p_value double")
    got = {r["x"]: r["adjusted"] for r in significance.holm(df, ["dataset"], ["x"]).collect()}
    assert got == pytest.approx({"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.9})
    assert all(r["adjusted"] == 1 for r in significance.holm(df.selectExpr("dataset", "x", "0.7D AS p_value"), ["dataset"], ["x"]).collect())


def test_wilcoxon(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(1, 30, 60) / 10, rng.integers(5, 34, 60) / 10
    rows = [("d", n, q, float(v)) for n, x in (("a", a), ("b", b)) for q, v in enumerate(x)]
    r = significance.wilcoxon(spark.createDataFrame(rows, "dataset string, algorithm string, query_index bigint, time double")).first()
    d = a - b
    d = d[d != 0]
    rank = np.array([(np.abs(d) < abs(v)).sum() + ((np.abs(d) == abs(v)).sum() + 1) / 2 for v in d])
    assert (r["n"], r["w_plus"], r["w_minus"]) == (len(d), rank[d > 0].sum(), rank[d < 0].sum()) and 0 < r["p_value"] < 0.05
    same = significance.wilcoxon(spark.createDataFrame([("d", n, 0, 1.0) for n in "ab"], "dataset string, algorithm string, query_index bigint, time double")).first()
    assert same["n"] == 0 and same["p_value"] == 1.0


def test_cliques(spark):
    edges = [("d", *e) for e in (("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("e", "f"), ("d", "b"))]
    got = {tuple(r["members"]) for r in significance.cliques(spark.createDataFrame(edges, "dataset string, a string, b string")).collect()}
    assert got == {("a", "b", "c"), ("b", "c", "d"), ("e", "f")}


@pytest.fixture(scope="module")
def sets(spark):
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((300, 4)), rng.standard_normal((200, 4)) + 1
    frame = lambda m: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "vec_id bigint, embedding array<double>").repartition(3).cache()
    return x, y, frame(x), frame(y)


def test_moments_and_mahalanobis(spark, sets):
    x, _, a, _ = sets
    n, mean, cov = stats.covariance(a)
    assert n == 300 and mean == pytest.approx(x.mean(axis=0)) and cov == pytest.approx(np.cov(x.T))
    d = {r["vec_id"]: r["distance"] for r in stats.mahalanobis(a, mean, cov).collect()}
    diff = x[7] - mean
    assert d[7] == pytest.approx(np.sqrt(diff @ np.linalg.inv(cov) @ diff))
    flat = {r["vec_id"]: r["distance"] for r in stats.mahalanobis(spark.createDataFrame([(0, [2.0]), (1, [3.0])], "vec_id bigint, embedding array<double>"), np.array([2.0]), np.zeros((1, 1))).collect()}
    assert flat == {0: 0.0, 1: np.inf}
    with pytest.raises(ValueError):
        stats.mahalanobis(a, mean, np.zeros((2, 2)))
    diagonal = {r["vec_id"]: r["distance"] for r in stats.mahalanobis_diagonal(a, a).collect()}
    assert diagonal[7] == pytest.approx(np.sqrt((diff**2 / x.var(axis=0, ddof=1)).sum()))
    p = np.array([r["components"] for r in stats.pca(a, a).orderBy("vec_id").collect()])
    assert p.var(axis=0, ddof=1) == pytest.approx(np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1][:2])


def test_distances_between_sets(sets):
    x, y, a, b = sets
    assert stats.frechet(a, a) == pytest.approx(0, abs=1e-5) and stats.frechet(a, b) > 1.5
    width = stats.median_bandwidth(a)
    full = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert width == pytest.approx(np.median(full[full > 0]))
    assert abs(stats.mmd(a, a, width)) < 0.05 < stats.mmd(a, b, width)
    assert stats.sliced_wasserstein(a, a, 8) == pytest.approx(0) and 0.6 < stats.sliced_wasserstein(a, b, 16) < 1.6


def test_density(spark):
    v = [("g", 0.1), ("g", 0.5), ("h", 0.5), ("g", None)]
    k = {(r["g"], round(r["x"], 2)): r["density"] for r in stats.kde(spark.createDataFrame(v, "g string, v double"), "v", ["g"], 0, 1, 11, 0.1).collect()}
    assert k["h", 0.5] == pytest.approx(1 / (0.1 * np.sqrt(2 * np.pi))) and sum(k["h", round(i / 10, 2)] for i in range(11)) / 10 == pytest.approx(1, abs=0.01)


def test_ood_table_and_reports(spark, sets):
    from vecquarry.plans import report

    _, _, a, b = sets
    rows = {r["measure"]: r for r in stats.ood_table(a, b).collect()}
    assert set(rows) == {"mmd", "frechet", "sliced_wasserstein"} and all(r["distance"] > 2 * abs(r["null_distance"]) for r in rows.values())
    for bad in (b.limit(0), spark.createDataFrame([(1, [1.0])], "vec_id bigint, embedding array<double>")):
        with pytest.raises(ValueError):
            stats.ood_table(a, bad)
    df = spark.createDataFrame([("a_b", 1.234, None)], "name string, x double, y double")
    assert report.text_table(df) == "name  x     y\na_b   1.23  -" and r"a\_b & 1.23 & - \\" in report.latex_table(df)
