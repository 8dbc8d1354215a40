"""From raw runs and datasets to the tables of the analysis: summary, detail, stats, info, and points on the plane.

Everything is one Spark job per table over all runs. Recalls are kept beside the runs and computed only for those that
have none yet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecquarry.operators import stats
from vecquarry.operators.knn import query_stats
from vecquarry.plans.runner import tables
from vecquarry.session import materialize
from vecquarry.sources.datasets import read_results

#: What tells a run.
RUN = ["dataset", "k", "algorithm", "run"]
#: What a run must have for its rows to be exported.
NEEDED = ["params", "qid", "time", "distances", "build_time", "index_size"]


@dataclass
class Export:
    summary: DataFrame
    detail: DataFrame
    #: (dataset, k, algorithm, run, reason) of the runs that were left out.
    skipped: DataFrame


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def recalls(results: DataFrame, truth: DataFrame, cache: str) -> DataFrame:
    """(dataset, k, algorithm, run, qid, recall) of all results. Runs that `cache` has already are read from there, the
    others are computed and added to it."""
    spark = results.sparkSession
    known = _read(spark, cache)
    todo = results if known is None else results.join(known.select(*RUN).distinct(), RUN, "left_anti")
    limits = truth.select("dataset", "qid", F.col("rank").alias("k"), F.col("distance").alias("limit"))
    hits = F.size(F.filter(F.slice("distances", 1, F.col("k")), lambda d: (d <= F.col("limit") + 1e-3) & (d < float("inf"))))
    new = todo.join(limits, ["dataset", "qid", "k"]).select(*RUN, "qid", (hits / F.col("k")).alias("recall"))
    new.write.mode("append").parquet(cache)
    return spark.read.schema(new.schema).parquet(cache)


def export(spark: SparkSession, results_path: str, truth: DataFrame, out: str) -> Export:
    """Write summary and detail (by dataset) of all raw runs below results_path, and return them.

    truth: (dataset, qid, rank, distance). A run is left out, and reported, if a column it needs is null in all of its
    rows, if it has neither best_qps nor best_search_time, or if its dataset has no truth. The table of recalls in `out`
    is kept between exports."""
    raw = read_results(spark, results_path)
    for name, kind in (("best_qps", "double"), ("best_search_time", "double")):
        raw = raw if name in raw.columns else raw.withColumn(name, F.lit(None).cast(kind))
    missing = F.concat_ws(", ", *[F.when(F.count(c) == 0, F.lit(c)) for c in NEEDED], F.when(F.count(F.coalesce("best_qps", "best_search_time")) == 0, F.lit("best_qps or best_search_time")))
    runs = raw.groupBy(*RUN).agg(missing.alias("lacks")).join(truth.select("dataset").distinct().withColumn("known", F.lit(True)), "dataset", "left")
    reason = F.when(F.col("lacks") != "", F.concat(F.lit("no "), "lacks")).when(F.col("known").isNull(), "no such dataset")
    judged = materialize(runs.select(*RUN, reason.alias("reason")))
    good = raw.join(judged.filter("reason IS NULL").select(*RUN), RUN, "left_semi")
    summary, detail = tables(good.join(recalls(good, truth, f"{out}/recalls"), [*RUN, "qid"]))
    summary.write.mode("overwrite").parquet(f"{out}/summary")
    detail.write.mode("overwrite").partitionBy("dataset").parquet(f"{out}/detail")
    return Export(spark.read.parquet(f"{out}/summary"), spark.read.parquet(f"{out}/detail").select(detail.columns), judged.filter("reason IS NOT NULL"))


def dataset_stats(datasets: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(dataset, query_index, rc1, rc10, lid10, rc100, lid100) from the ground truth (qid, rank, vec_id, distance) and the
    mean distances (qid, avg_distance) of each dataset."""
    every = None
    for name, (near, means) in datasets.items():
        one = query_stats(near, means).withColumn("dataset", F.lit(name)).withColumnRenamed("qid", "query_index")
        every = one if every is None else every.unionByName(one)
    return every.select("dataset", "query_index", "rc1", "lid10", "rc10", "lid100", "rc100")


def info(vectors: DataFrame) -> DataFrame:
    """(dataset, n, dimensions) of the train rows of (dataset, part, embedding)."""
    train = vectors.filter((F.col("part") == "train") & F.col("embedding").isNotNull())
    return train.groupBy("dataset").agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("bigint").alias("dimensions"))


def plane(name: str, parts: dict[str, DataFrame]) -> DataFrame:
    """(dataset, part, vec_id, x, y, mahalanobis_distance_to_data): the rows of every part along the two principal axes of
    the train part, and their distance from its distribution."""
    train = parts["train"]
    _, mean, cov = stats.covariance(train)
    every = None
    for part, df in parts.items():
        at = stats.pca(df, train, 2).select("vec_id", F.col("components")[0].alias("x"), F.col("components")[1].alias("y"))
        one = at.join(stats.mahalanobis(df, mean, cov), "vec_id").select(F.lit(name).alias("dataset"), F.lit(part).alias("part"), "vec_id", "x", "y", F.col("distance").alias("mahalanobis_distance_to_data"))
        every = one if every is None else every.unionByName(one)
    return every
