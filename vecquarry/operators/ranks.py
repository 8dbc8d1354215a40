"""Ranks, the fastest configurations, Pareto fronts and rank tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def average_rank(partition: list[str], value: str, descending: bool = False) -> Column:
    """Rank in the partition, equal values sharing the mean of their ranks: two in first place have 1.5."""
    w = Window.partitionBy(*partition).orderBy(F.col(value).desc() if descending else F.col(value).asc())
    return F.rank().over(w) + (equals(w) - 1) / 2


def equals(w: WindowSpec) -> Column:
    """How many rows of an ordered window are equal to the current one in its order, itself included."""
    return F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow))


def fastest_at(summary: DataFrame, recall: float, k: int, by: list[str] | None = None) -> DataFrame:
    """The configuration with the largest qps of each (dataset, algorithm) among those of k and of at least that recall.
    Groups whose largest qps is shared by several rows have none. Null qps never wins. A group needs only its largest
    and second largest value, so it is aggregated and never sorted."""
    by = by or ["dataset", "algorithm"]
    rows = summary.filter((F.col("k") == k) & (F.col("recall") >= recall) & F.col("qps").isNotNull())
    best = rows.groupBy(*by).agg(F.max("qps").alias("__best"))
    same = [rows[c].eqNullSafe(best[c]) for c in by]
    at = rows.join(best, [*same, rows["qps"] == best["__best"]]).select(rows["*"])
    alone = at.groupBy(*by).agg(F.count("*").alias("__n"), F.first(F.struct(*rows.columns)).alias("r")).filter(F.col("__n") == 1)
    return alone.select("r.*")


def pareto_front(df: DataFrame, by: list[str], qps: str = "qps", recall: str = "recall") -> DataFrame:
    """The rows that no row of their group beats in both columns; equal rows stay together. Null or NaN in either is out.

    Each (group, qps) is first cut to its best recall; a running maximum from the largest qps down then tells what is
    beaten, so that no pairs are formed."""
    rows = df.filter(F.col(qps).isNotNull() & F.col(recall).isNotNull() & ~F.isnan(qps) & ~F.isnan(recall))
    steps = rows.groupBy(*by, qps).agg(F.max(recall).alias("__m"))
    faster = Window.partitionBy(*by).orderBy(F.col(qps).desc()).rowsBetween(Window.unboundedPreceding, -1)
    front = steps.withColumn("__prev", F.max("__m").over(faster)).filter(F.col("__prev").isNull() | (F.col("__m") > F.col("__prev"))).drop("__prev")
    keys = [rows[c].eqNullSafe(front[c]) for c in by]
    return rows.join(front, [*keys, rows[qps] == front[qps], rows[recall] == front["__m"]], "left_semi")


def radar_score(summary: DataFrame, recall: float, k: int) -> DataFrame:
    """(algorithm, score, score_ip, ...): qps of the fastest configuration against the best of the dataset, missing ones
    being 0, averaged over the datasets of each kind (inner product or not) and then over the kinds."""
    fast = fastest_at(summary, recall, k)
    share = fast.withColumn("share", F.col("qps") / F.max("qps").over(Window.partitionBy("dataset"))).select("dataset", "algorithm", "share")
    grid = summary.select("dataset").distinct().join(summary.select("algorithm").distinct())  # the complete table asked for: names only
    full = grid.join(share, ["dataset", "algorithm"], "left").na.fill(0.0, ["share"])
    kinds = full.groupBy("algorithm", F.col("dataset").contains("-ip").alias("is_ip")).agg(F.avg("share").alias("mean"), F.count_if(F.col("share") > 0).alias("met"))
    return kinds.groupBy("algorithm").agg(F.avg("mean").alias("score"), F.sum("met").alias("datasets_met"))


def difficulty_split(detail: DataFrame, stats: DataFrame, chosen: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """(algorithm, dataset, easy, difficult, mean_recall, qps): mean recall of the chosen configurations on the easiest and
    the most difficult queries of each dataset, by relative contrast (rc100, higher is easier; ties by query_index).
    Bands: rank < low * n is easy, rank >= high * n difficult, ranks from 1."""
    w = Window.partitionBy("dataset")
    ranked = stats.select("dataset", "query_index", "rc100").withColumns({"r": F.row_number().over(w.orderBy(F.col("rc100").desc(), "query_index")), "n": F.count("*").over(w)})
    band = F.when(F.col("r") < low * F.col("n"), "easy").when(F.col("r") >= high * F.col("n"), "difficult")
    bands = ranked.select("dataset", "query_index", band.alias("band"))
    rows = detail.join(chosen.select("dataset", "algorithm", "params").distinct(), ["dataset", "algorithm", "params"], "left_semi").join(bands, ["dataset", "query_index"])
    mean = lambda b: F.avg(F.when(F.col("band") == b, F.col("recall")))
    return rows.groupBy("algorithm", "dataset").agg(mean("easy").alias("easy"), mean("difficult").alias("difficult"), F.avg("recall").alias("mean_recall"), (1 / F.avg("time")).alias("qps"))


def performance_gap(summary: DataFrame, pairs: DataFrame, recall: float, k: int) -> DataFrame:
    """(inside_of, outside_of, algorithm, inside, outside): qps of the fastest configurations on the two datasets of each
    pair (inside_of, outside_of), where both exist."""
    fast = fastest_at(summary, recall, k)
    side = lambda name: fast.select(F.col("dataset").alias(f"{name}_of"), "algorithm", F.col("qps").alias(name))
    return pairs.join(side("inside"), "inside_of").join(side("outside"), ["outside_of", "algorithm"]).select("inside_of", "outside_of", "algorithm", "inside", "outside")


def metric_ranks(summary: DataFrame, metric: str, recall: float, k: int, smaller_is_better: bool = True) -> DataFrame:
    """(algorithm, dataset, value, rank, average_rank): the metric of the fastest configuration of each algorithm on each
    dataset (ties in qps by params), its rank there, equal values sharing ranks, and the algorithm's mean rank over all."""
    rows = summary.filter((F.col("k") == k) & (F.col("recall") >= recall) & F.col("qps").isNotNull())
    best = rows.groupBy("dataset", "algorithm").agg(F.min_by(F.col(metric), F.struct(-F.col("qps"), F.col("params"))).alias("value"))
    ranked = best.withColumn("rank", average_rank(["dataset"], "value", not smaller_is_better))
    return ranked.withColumn("average_rank", F.avg("rank").over(Window.partitionBy("algorithm")))


def metric_table(summary: DataFrame, metric: str, recall: float, k: int, datasets: list[str], smaller_is_better: bool = True) -> DataFrame:
    """(algorithm, a column per dataset, average_rank): metric_ranks with a column for each of the datasets named, over
    which the ranks are taken."""
    ranked = metric_ranks(summary.filter(F.col("dataset").isin(datasets)), metric, recall, k, smaller_is_better)
    return ranked.groupBy("algorithm", "average_rank").pivot("dataset", datasets).agg(F.first("value"))


def legend_order(front: DataFrame, threshold: float) -> DataFrame:
    """(algorithm, place): by the largest qps at a recall of at least the threshold, then those that never reach it, by name."""
    best = front.groupBy("algorithm").agg(F.max(F.when(F.col("recall") >= threshold, F.col("qps"))).alias("best"))
    return best.select("algorithm", F.row_number().over(Window.orderBy(F.col("best").desc_nulls_last(), "algorithm")).alias("place"))
