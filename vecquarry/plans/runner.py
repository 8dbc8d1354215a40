"""Runs of an index over query arguments, their results and metrics.

Times are wall times of Spark jobs. They differ from run to run, so no result that is compared holds one.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecquarry.operators.index import Index
from vecquarry.operators.knn import nested, recall
from vecquarry.plans.registry import REGISTRY, instantiate
from vecquarry.session import materialize


@dataclass
class Run:
    build_time: float
    best_search_time: float
    qps: float
    results: DataFrame


def build(name: str, metric: str, arguments: dict, corpus: DataFrame, learn: DataFrame | None = None, learn_neighbours: DataFrame | None = None) -> tuple[Index, float]:
    """The fitted index and the seconds it took. Indexes that learn from queries get the sample if there is one."""
    began = time.perf_counter()
    index = instantiate(name, metric, arguments)
    if REGISTRY[name].ood and (learn is None or learn_neighbours is None):
        raise NotImplementedError(f"{name} needs a sample of queries with their neighbours")
    index = index.fit(corpus) if learn is None or learn_neighbours is None else index.fit_ood(corpus, learn, learn_neighbours)
    return index, time.perf_counter() - began


def run(index: Index, name: str, arguments: dict, queries: DataFrame, k: int, build_time: float = 0.0, repeats: int = 1) -> Run:
    """All queries as one batch, `repeats` times; the best mean time per query counts, the results are those of the last."""
    index.set_query_arguments(**REGISTRY[name].query(arguments))
    n, best, results = max(1, queries.count()), float("inf"), None
    for _ in range(repeats):
        began = time.perf_counter()
        results = materialize(index.query(queries, k))
        best = min(best, (time.perf_counter() - began) / n)
    return Run(build_time, best, 1 / best, results)


#: Queries that may be timed one by one.
MOST_QUERIES = 10_000


def run_each(index: Index, name: str, arguments: dict, queries: DataFrame, k: int) -> DataFrame:
    """(qid, time): seconds of each query answered alone, one after the other; of at most MOST_QUERIES queries."""
    index.set_query_arguments(**REGISTRY[name].query(arguments))
    ids = [r["qid"] for r in queries.select("qid").orderBy("qid").limit(MOST_QUERIES + 1).collect()]
    if len(ids) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries to time one by one")
    out = []
    for q in ids:
        one = queries.filter(F.col("qid") == q)
        began = time.perf_counter()
        index.query(one, k).collect()  # k rows
        out.append((q, time.perf_counter() - began))
    return queries.sparkSession.createDataFrame(out, "qid bigint, time double")


def index_size(index: Index) -> float:
    """KB of an index: the files of its tables, as Spark sizes them, and its learnt arrays."""
    held, todo, seen = 0, [index], set()
    while todo:
        at = todo.pop()
        if id(at) in seen:
            continue
        seen.add(id(at))
        for name, v in vars(at).items():
            if isinstance(v, DataFrame):
                held += 0 if name == "corpus" else int(str(v._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            elif isinstance(v, np.ndarray):
                held += v.nbytes
            elif hasattr(v, "__dict__") and not isinstance(v, type):
                todo.append(v)
    return held / 1024


def padded(results: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, neighbours, distances) of exactly k entries for every query; what is missing is -1 at an infinite distance."""
    lists = queries.select("qid").join(nested(results.filter(F.col("rank") <= k)), "qid", "left")
    fill = lambda c, kind, v: F.slice(F.concat(F.coalesce(c, F.array().cast(kind)), F.array_repeat(F.lit(v).cast(kind[6:-1]), k)), 1, k)
    return lists.select("qid", fill(F.col("neighbours"), "array<bigint>", -1).alias("neighbours"), fill(F.col("distances"), "array<double>", float("inf")).alias("distances"))


def summary(spark: SparkSession, dataset: str, algorithm: str, params: str, k: int, done: Run, truth: DataFrame, index_size: float = 0.0) -> DataFrame:
    """One row (k, dataset, algorithm, params, qps, recall, build_time, index_size)."""
    mean = recall(done.results, truth, k).agg(F.avg("recall").alias("recall"))
    return mean.select(
        F.lit(k).alias("k"), F.lit(dataset).alias("dataset"), F.lit(algorithm).alias("algorithm"), F.lit(params).alias("params"), F.lit(done.qps).alias("qps"), "recall", F.lit(done.build_time).alias("build_time"), F.lit(index_size).alias("index_size")
    )


def metrics(results: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, detail) of raw results (dataset, algorithm, params, k, qid, time, distances, best_qps, best_search_time,
    build_time, index_size) against truth (dataset, qid, rank, distance)."""
    limits = truth.select("dataset", "qid", F.col("rank").alias("k"), F.col("distance").alias("limit"))
    hits = F.size(F.filter(F.slice("distances", 1, F.col("k")), lambda d: (d <= F.col("limit") + 1e-3) & (d < float("inf"))))
    return tables(results.join(limits, ["dataset", "qid", "k"]).withColumn("recall", hits / F.col("k")))


def tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, detail) of raw results with their recalls."""
    detail = rows.select("dataset", F.col("qid").alias("query_index"), "k", "algorithm", "params", F.col("time").cast("float").alias("time"), "recall", "build_time", "index_size")
    qps = F.coalesce(F.col("best_qps"), 1 / F.col("best_search_time"))
    per_run = rows.groupBy("k", "dataset", "algorithm", "params").agg(F.first(qps).alias("qps"), F.avg("recall").alias("recall"), F.first("build_time").alias("build_time"), F.first("index_size").alias("index_size"))
    return per_run, detail
