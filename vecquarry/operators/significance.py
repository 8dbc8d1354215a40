"""Paired tests between algorithms, their correction, and groups that do not differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecquarry.operators.ranks import equals
from vecquarry.session import materialize


def mean_times(detail: DataFrame, chosen: DataFrame) -> DataFrame:
    """(dataset, algorithm, query_index, time): mean time of the chosen configurations' queries."""
    rows = detail.filter(F.col("time").isNotNull() & ~F.isnan("time")).join(chosen.select("dataset", "algorithm", "params").distinct(), ["dataset", "algorithm", "params"])
    return rows.groupBy("dataset", "algorithm", "query_index").agg(F.avg(F.col("time").cast("double")).alias("time"))


def normal_tail(z):
    """Upper tail of the standard normal distribution, as a Column: a rational approximation with an error below 1e-7."""
    # Coefficients of the polynomial in 1 / (1 + 0.2316419 z).
    b = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    t = 1 / (1 + 0.2316419 * z)
    poly = F.lit(0.0)
    for c in reversed(b):
        poly = (poly + c) * t
    return F.exp(-z * z / 2) / F.lit(2.5066282746310002) * poly


def wilcoxon(times: DataFrame) -> DataFrame:
    """(dataset, algorithm_a, algorithm_b, n, w_plus, w_minus, latency_a, latency_b, p_value) for each pair of algorithms
    of a dataset over their common queries: the signed-rank test without zero differences, equal differences sharing
    ranks, with the normal approximation and the correction for ties. Pairs without differences have a p of 1."""
    a = times.select("dataset", F.col("algorithm").alias("algorithm_a"), "query_index", F.col("time").alias("a"))
    b = times.select("dataset", F.col("algorithm").alias("algorithm_b"), "query_index", F.col("time").alias("b"))
    pairs = a.join(b, ["dataset", "query_index"]).filter(F.col("algorithm_a") < F.col("algorithm_b"))
    key = ["dataset", "algorithm_a", "algorithm_b"]
    # one window and one aggregate of the same key: differences of zero, which come first by size, take no ranks
    w = Window.partitionBy(*key)
    d = pairs.withColumn("d", F.col("a") - F.col("b")).withColumn("size", F.abs("d"))
    by_size, zeros = w.orderBy("size"), F.count_if(F.col("d") == 0).over(w)
    t = equals(by_size)
    ranked = d.withColumns({"rank": F.rank().over(by_size) + (t - 1) / 2 - zeros, "t": t.cast("double")})
    of = lambda condition, value: F.sum(F.when(condition, value).otherwise(0.0))
    differs = F.col("d") != 0
    sums = ranked.groupBy(*key).agg(
        F.count_if(differs).alias("n"), of(F.col("d") > 0, F.col("rank")).alias("w_plus"), of(F.col("d") < 0, F.col("rank")).alias("w_minus"),
        of(differs, F.col("t") * F.col("t") - 1).alias("ties"), F.avg("a").alias("latency_a"), F.avg("b").alias("latency_b"),
    )
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = F.abs(F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(F.nullif(variance, F.lit(0.0)))
    p = F.coalesce(F.least(F.lit(1.0), 2 * normal_tail(z)), F.lit(1.0))
    return sums.select(*key, "n", "w_plus", "w_minus", "latency_a", "latency_b", p.alias("p_value"))


def holm(tests: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """tests with adjusted: the p values of each family, ascending, times the number of hypotheses left, as a running maximum of at most 1."""
    w = Window.partitionBy(*by)
    i = F.row_number().over(w.orderBy("p_value", *order))
    scaled = tests.withColumns({"__i": i, "__m": F.count("*").over(w)}).withColumn("__s", F.col("p_value") * (F.col("__m") - F.col("__i") + 1))
    run = F.max("__s").over(w.orderBy("__i").rowsBetween(Window.unboundedPreceding, 0))
    return scaled.withColumn("adjusted", F.least(F.lit(1.0), run)).drop("__i", "__m", "__s")


def indifferent(tests: DataFrame, level: float = 0.01) -> DataFrame:
    """(dataset, a, b): pairs whose adjusted p is at least the level."""
    return tests.filter(F.col("adjusted") >= level).select("dataset", F.col("algorithm_a").alias("a"), F.col("algorithm_b").alias("b"))


def cliques(edges: DataFrame) -> DataFrame:
    """(dataset, members): maximal sets of more than one algorithm all joined by edges. Grown level by level: every clique
    of n is joined to the edges of its last member; one that no algorithm extends is maximal."""
    e = edges.select("dataset", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    both = e.unionByName(e.select("dataset", F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("dataset", "a").agg(F.collect_set("b").alias("near"))
    level = e.join(near, ["dataset", "a"]).select("dataset", F.array("a", "b").alias("members"), "b", F.col("near").alias("na"))
    level = level.join(near.select("dataset", F.col("a").alias("b"), F.col("near").alias("nb")), ["dataset", "b"]).select("dataset", "members", F.array_intersect("na", "nb").alias("common"))
    out = None
    while True:
        level = materialize(level)
        done = level.filter(F.size("common") == 0).select("dataset", F.array_sort("members").alias("members"))
        out = done if out is None else out.unionByName(done)
        if level.filter(F.size("common") > 0).isEmpty():
            return out
        more = level.select("dataset", "members", "common", F.explode("common").alias("next")).filter(F.col("next") > F.array_max("members"))
        grown = more.join(near.select("dataset", F.col("a").alias("next"), "near"), ["dataset", "next"])
        level = grown.select("dataset", F.concat("members", F.array("next")).alias("members"), F.array_intersect("common", "near").alias("common"))
