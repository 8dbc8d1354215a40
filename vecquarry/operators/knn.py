"""Exact nearest neighbours of a query set, ground truth, and what is derived from it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecquarry.functions.kernels import distances, matrix, nearest, prepare

#: Distances are rounded to so many digits, so that order and equality do not hang on the order of sums.
DIGITS = 6
NEIGHBOURS = "qid bigint, rank int, vec_id bigint, distance double"


def knn(queries: DataFrame, corpus: DataFrame, metric: str, k: int, *, chunk: int = 50_000, block: int = 2_000) -> DataFrame:
    """(qid, rank, vec_id, distance): the k nearest rows of corpus (vec_id, embedding) to each query (qid, embedding).

    The stated queries meet all rows in blocks: a task holds one chunk of the corpus and one block of queries, computes
    their distances as matrix products of tiles and keeps k a query; the winners of all chunks are merged. Ties go to the smaller
    vec_id. Null vectors take no part; zero vectors have no cosine distance and come last with a null one.
    """
    q, c = queries.select("qid", "embedding").filter("embedding IS NOT NULL"), corpus.select("vec_id", "embedding").filter("embedding IS NOT NULL")
    chunks, blocks = max(1, -(-c.count() // chunk)), max(1, -(-q.count() // block))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("qid", "embedding", part("qid", blocks).alias("b"), every(chunks).alias("c"))
    right = c.select("vec_id", "embedding", part("vec_id", chunks).alias("rc"), every(blocks).alias("rb"))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"qid": [], "vec_id": [], "distance": []})
        x, y, ids = prepare(matrix(a["embedding"]), metric), prepare(matrix(b["embedding"]), metric), b["vec_id"].to_numpy()
        cols, near = nearest(x, y, ids, metric, k, DIGITS)
        return pd.DataFrame({"qid": np.repeat(a["qid"].to_numpy(), cols.shape[1]), "vec_id": ids[cols].ravel(), "distance": near.ravel()})

    found = left.groupBy("b", "c").cogroup(right.groupBy("rb", "rc")).applyInPandas(search, "qid bigint, vec_id bigint, distance double")
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of (qid, vec_id, distance) with their ranks."""
    w = Window.partitionBy("qid").orderBy(F.col("distance").asc_nulls_last(), F.col("vec_id").asc())
    d = F.when(~F.isnan("distance"), F.col("distance"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("qid", "rank", "vec_id", d.alias("distance"))


def mean_distance(queries: DataFrame, corpus: DataFrame, metric: str, *, chunk: int = 50_000, block: int = 2_000) -> DataFrame:
    """(qid, avg_distance) over the whole corpus."""
    q, c = queries.select("qid", "embedding").filter("embedding IS NOT NULL"), corpus.select("vec_id", "embedding").filter("embedding IS NOT NULL")
    chunks, blocks = max(1, -(-c.count() // chunk)), max(1, -(-q.count() // block))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("qid", "embedding", part("qid", blocks).alias("b"), every(chunks).alias("c"))
    right = c.select("vec_id", "embedding", part("vec_id", chunks).alias("rc"), every(blocks).alias("rb"))

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"qid": [], "s": [], "n": []})
        x, y = prepare(matrix(a["embedding"]), metric), prepare(matrix(b["embedding"]), metric)
        s, n = np.zeros(len(x)), np.zeros(len(x), np.int64)
        for at in range(0, len(y), 4096):
            d = distances(x, y[at : at + 4096], metric)
            s, n = s + np.nansum(d, axis=1), n + (~np.isnan(d)).sum(axis=1)
        return pd.DataFrame({"qid": a["qid"], "s": s, "n": n})

    parts = left.groupBy("b", "c").cogroup(right.groupBy("rb", "rc")).applyInPandas(sums, "qid bigint, s double, n bigint")
    return parts.groupBy("qid").agg(F.round(F.sum("s") / F.sum("n"), DIGITS).alias("avg_distance"))


def nested(neighbours: DataFrame) -> DataFrame:
    """(qid, neighbours, distances): lists in order of rank."""
    l = F.sort_array(F.collect_list(F.struct("rank", "vec_id", "distance")))  # noqa: E741
    return neighbours.groupBy("qid").agg(l.alias("l")).select("qid", F.transform("l", lambda x: x["vec_id"]).alias("neighbours"), F.transform("l", lambda x: x["distance"]).alias("distances"))


def gather(ids: DataFrame, corpus: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The vectors of returned ids: an equi-join on vec_id."""
    return ids.join(corpus.select("vec_id", *(columns or ["embedding"])), "vec_id")


def rescore(ids: DataFrame, queries: DataFrame, corpus: DataFrame, metric: str, k: int) -> DataFrame:
    """(qid, rank, vec_id, distance) of candidate pairs (qid, vec_id) by their exact distances."""
    pairs = ids.select("qid", "vec_id").distinct().join(queries.select("qid", F.col("embedding").alias("q")), "qid").join(corpus.select("vec_id", F.col("embedding").alias("v")), "vec_id")

    @F.pandas_udf("double")
    def exact(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=float)
        x, y = prepare(matrix(a), metric), prepare(matrix(b), metric)
        if metric == "euclidean":
            d = np.sqrt(((x - y) ** 2).sum(axis=1))
        elif metric == "hamming":
            d = np.bitwise_count(x ^ y).sum(axis=1).astype(float)
        else:
            p = np.einsum("ij,ij->i", x, y)
            d = -p if metric == "ip" else np.clip(1 - p, 0, 2)
        return pd.Series(np.round(d, DIGITS))

    return ranked(pairs.select("qid", "vec_id", exact("q", "v").alias("distance")), k)


def recall(found: DataFrame, truth: DataFrame, k: int, slack: float = 1e-3) -> DataFrame:
    """(qid, recall) of every query of truth: results at most as far as the true k-th plus slack, over k. Repeated results
    count as often as they come; padding (infinite distances) never counts."""
    limit = truth.filter(F.col("rank") == k).select("qid", F.col("distance").alias("limit"))
    hits = found.join(limit, "qid").filter((F.col("rank") <= k) & (F.col("distance") <= F.col("limit") + slack) & (F.col("distance") < float("inf")))
    n = hits.groupBy("qid").agg(F.count("*").alias("n"))
    return limit.join(n, "qid", "left").select("qid", (F.coalesce("n", F.lit(0)) / F.lit(k)).alias("recall"))


def recall_ids(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): share of the k true neighbours among the results, each once."""
    t = truth.filter(F.col("rank") <= k).select("qid", "vec_id")
    hits = t.join(found.filter(F.col("rank") <= k).select("qid", "vec_id").distinct(), ["qid", "vec_id"]).groupBy("qid").agg(F.count("*").alias("n"))
    return t.select("qid").distinct().join(hits, "qid", "left").select("qid", (F.coalesce("n", F.lit(0)) / F.lit(k)).alias("recall"))


def local_dimension(distances_: Column, k: int, least: float = 1e-5) -> Column:
    """Maximum-likelihood local intrinsic dimension from sorted distances; distances up to `least` are dropped. Null if
    none is left or all equal the k-th."""
    first = F.slice(distances_, 1, k)
    w = F.element_at(first, -1)
    used = F.filter(first, lambda d: d > least)
    logs = F.aggregate(F.transform(used, lambda d: F.log(d / w)), F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(used) > 0, -F.size(used) / F.nullif(logs, F.lit(0.0)))


def query_stats(neighbours: DataFrame, means: DataFrame, ks: tuple[int, ...] = (1, 10, 100)) -> DataFrame:
    """(qid, rc<k>, lid<k> for k > 1): relative contrast avg_distance / distance of the k-th, and local dimension."""
    lists = nested(neighbours).join(means, "qid")
    out = {}
    for k in ks:
        kth = F.element_at(F.slice("distances", 1, k), -1)
        out[f"rc{k}"] = F.col("avg_distance") / F.nullif(kth, F.lit(0.0))
        if k > 1:
            out[f"lid{k}"] = local_dimension(F.col("distances"), k)
    return lists.select("qid", *[c.alias(n) for n, c in out.items()])
