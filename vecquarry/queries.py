"""The queries of the core: name -> (spark, sf_dir) -> DataFrame, and the same results in SQL (oracle.py)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecquarry.functions import names as N
from vecquarry.functions import vector as V
from vecquarry.operators import derive, drift, index, knn, ranks, significance, stats
from vecquarry.operators.ordered import positions
from vecquarry.oracle import ORACLE  # noqa: F401
from vecquarry.plans import export, grid, report, runner, suite
from vecquarry.session import materialize, scratch, table
from vecquarry.sources import datasets, files, recipes
from vecquarry.sources.datasets import encoded, hashing_encoder, text_dataset
from vecquarry.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# Schemas that drift

RESULT_FIELDS = {"best_qps": "max", "best_search_time": "min", "recalls": "list"}


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.drift(table(spark, d, "results"), RESULT_FIELDS).changes.select("file_id", "field", "change")


@query
def p6_changes(spark: SparkSession, d: str) -> DataFrame:
    return drift.drift(table(spark, d, "results"), RESULT_FIELDS).changes


@query
def p6_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.drift(table(spark, d, "results"), RESULT_FIELDS).unified


@query
def p6_values(spark: SparkSession, d: str) -> DataFrame:
    """The asked fields of the consistent table, rounded."""
    u = drift.drift(table(spark, d, "results"), RESULT_FIELDS).unified
    return u.select("file_id", "dataset", "algorithm", "written_at", F.round("best_qps", 6).alias("best_qps"), F.round("best_search_time", 12).alias("best_search_time"), F.transform("recalls", lambda x: F.round(x, 6)).alias("recalls"))


@query
def p6_columns(spark: SparkSession, d: str) -> DataFrame:
    """Every name of every column, as put together between versions."""
    return drift.drift(table(spark, d, "results"), RESULT_FIELDS).columns


# Search: every row whose id is divisible by 20 asks, all rows answer


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def _asking(corpus: DataFrame) -> DataFrame:
    return corpus.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("qid"), "embedding")


def _knn(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = _corpus(spark, d)
        c = derive.quantize(c, "binary", distance="hamming") if metric == "hamming" else c
        return knn.knn(_asking(c), c, metric, 10)

    return run


for _m in V.METRICS:
    QUERIES[f"knn_{_m}"] = _knn(_m)


@query
def query_stats(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    q = _asking(c)
    s = knn.query_stats(knn.knn(q, c, "euclidean", 100), knn.mean_distance(q, c, "euclidean"))
    return s.select("qid", *[F.round(n, 3).alias(n) for n in s.columns if n != "qid"])


@query
def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return index.knn_graph(_corpus(spark, d), 5, "euclidean")


@query
def gather_rescore(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours under cosine, ranked anew by Euclidean distance."""
    c = _corpus(spark, d)
    q = _asking(c)
    return knn.rescore(knn.knn(q, c, "cosine", 20), q, c, "euclidean", 5)


CENTROIDS = list(range(16))


def _ivf(spark: SparkSession, d: str, probes: int) -> tuple[index.IVF, DataFrame]:
    c = _corpus(spark, d)
    return index.IVF(metric="euclidean", centroid_ids=CENTROIDS).fit(c).set_query_arguments(n_probe=probes), _asking(c)


@query
def ivf_assign(spark: SparkSession, d: str) -> DataFrame:
    return _ivf(spark, d, 1)[0].lists.select("vec_id", F.col("bucket").alias("cell"))


@query
def ivf_search(spark: SparkSession, d: str) -> DataFrame:
    i, q = _ivf(spark, d, 4)
    return i.query(q, 10)


@query
def ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    i, q = _ivf(spark, d, 4)
    return knn.recall(i.query(q, 10), knn.knn(q, i.corpus, "euclidean", 10), 10)


@query
def ivf_runs(spark: SparkSession, d: str) -> DataFrame:
    """A row per number of probes: mean recall, and a speed from the number of distances computed."""
    i, q = _ivf(spark, d, 1)
    truth = materialize(knn.knn(q, i.corpus, "euclidean", 10))
    rows = None
    for n in (1, 2, 4, 8):
        i.set_query_arguments(n_probe=n)
        r = knn.recall(i.query(q, 10), truth, 10).join(i.distance_computations(q), "qid")
        r = r.agg(F.lit(n).alias("n_probe"), F.round(F.avg("recall"), 6).alias("recall"), F.round(1e6 / F.avg("dist_comps"), 6).alias("qps"))
        rows = r if rows is None else rows.unionByName(r)
    return rows


def _approximate(make: Callable[[], index.Index], **arguments) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = _corpus(spark, d)
        return make().fit(c).set_query_arguments(**arguments).query(_asking(c), 10)

    return run


def _tuned(make: Callable[[], index.Index], lists: int, wide: str, first: int, unit: int) -> Callable[[SparkSession, str], DataFrame]:
    """The candidates ranked again (`wide`, in units of `unit` rows) double from `first` on until a sample of rows finds
    its neighbours, as a fixed number of them is an ever smaller share of more rows; in the end all rows are ranked."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        c = materialize(_corpus(spark, d))
        every = -(-c.count() // unit)
        steps = [{"n_probe": lists - lists // 8, wide: first << i} for i in range(max(0, (every // first).bit_length()))]
        return index.tuned(make().fit(c), c, 10, [*steps, {"n_probe": lists, wide: max(1, every)}]).query(_asking(c), 10)

    return run


QUERIES |= {
    "ivf_kmeans_search": _approximate(lambda: index.IVF(n_list=16), n_probe=13),
    "ivf_sq8_search": _approximate(lambda: index.IVF(n_list=16, codes=index.ScalarCodes()), n_probe=13, k_factor=2),
    "ivf_pq_search": _tuned(lambda: index.IVF(n_list=16, codes=index.ProductCodes(16, 16)), 16, "k_factor", 10, 10),
    "ivf_bits_search": _tuned(lambda: index.IVF(n_list=16, codes=index.SignCodes()), 16, "k_factor", 10, 10),
    "lsh_search": _approximate(lambda: index.Hashing(metric="cosine", tables=12, bits=5), probes=6),
    "tree_search": _approximate(lambda: index.Trees(trees=32, depth=4), votes=1),
    "graph_search": _approximate(lambda: index.Graph(degree=16), beam=40),
    "lowrank_search": _tuned(lambda: index.LowRank(rank=32, n_list=8), 8, "rerank", 120, 1),
}


@query
def tree_supervised_search(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    q = _asking(c)
    learn = c.select(F.col("vec_id").alias("qid"), "embedding")
    near = index.Graph(degree=16).fit(c).set_query_arguments(beam=40).query(learn, 10)
    return index.Trees(trees=8, depth=4, supervised=True).fit_ood(c, learn, near).query(q, 10)


@query
def nn_descent(spark: SparkSession, d: str) -> DataFrame:
    return index.nn_descent(_corpus(spark, d), 10, "euclidean")


@query
def graph_prune(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    found = index.Graph(degree=16).fit(c).set_query_arguments(beam=40)
    return index.prune(index.knn_graph(c, 16, "euclidean", found), c, 8, "euclidean", 1.0)


SEARCHES = ["ivf_kmeans_search", "ivf_sq8_search", "ivf_pq_search", "ivf_bits_search", "lsh_search", "tree_search", "tree_supervised_search", "graph_search", "lowrank_search"]


@query
def search_recalls(spark: SparkSession, d: str) -> DataFrame:
    """Whether each approximate search finds at least 0.9 of the ten true neighbours, and how many queries it answers."""
    c = materialize(_corpus(spark, d))
    truth = {m: materialize(knn.knn(_asking(c), c, m, 10)) for m in ("euclidean", "cosine")}
    rows = None
    for name in SEARCHES:
        found = QUERIES[name](spark, d)
        r = knn.recall_ids(found, truth["cosine" if name == "lsh_search" else "euclidean"], 10)
        one = r.agg(F.lit(name).alias("search"), F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("reached"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


# Deriving datasets


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select("vec_id", F.transform("embedding", lambda x: F.round(x, digits)).alias("embedding"))


@query
def normalize(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(derive.normalized(_corpus(spark, d)))


@query
def matryoshka(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(derive.reduced(_corpus(spark, d), 16))


@query
def layer_norm(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_corpus(spark, d).withColumn("embedding", V.layer_norm(F.col("embedding"))), 6)


def _ints(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.col("embedding").cast("array<int>").alias("embedding"))


@query
def quantize_uint8(spark: SparkSession, d: str) -> DataFrame:
    return _ints(derive.quantize(_corpus(spark, d), "uint8"))


@query
def quantize_int8(spark: SparkSession, d: str) -> DataFrame:
    return _ints(derive.quantize(_corpus(spark, d), "int8"))


@query
def quantize_binary(spark: SparkSession, d: str) -> DataFrame:
    return _ints(derive.quantize(_corpus(spark, d), "binary", distance="hamming"))


@query
def unpack_bits(spark: SparkSession, d: str) -> DataFrame:
    packed = derive.quantize(_corpus(spark, d), "binary", distance="hamming")
    return packed.select("vec_id", V.unpack_bits(F.col("embedding")).alias("embedding"))


@query
def dimension_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = derive.bounds(_corpus(spark, d))
    z = F.posexplode(F.arrays_zip("low", "high", "largest")).alias("j", "b")
    return b.select(z).select("j", F.col("b.low").alias("low"), F.col("b.high").alias("high"), F.col("b.largest").alias("largest"))


@query
def dimension_moments(spark: SparkSession, d: str) -> DataFrame:
    return stats.moments(_corpus(spark, d)).select("j", "n", F.round("mean", 9).alias("mean"), F.round("variance", 9).alias("variance"))


@query
def mahalanobis_diagonal(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    return stats.mahalanobis_diagonal(c, c).select("vec_id", F.round("distance", 6).alias("distance"))


@query
def mahalanobis_full(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    _, mean, cov = stats.covariance(c)
    return stats.mahalanobis(c, mean, cov)


@query
def mahalanobis_given(spark: SparkSession, d: str) -> DataFrame:
    """Distances under a given covariance, of 3 on the diagonal and 1 elsewhere."""
    import numpy as np

    return stats.mahalanobis(_corpus(spark, d), np.zeros(64), 2 * np.eye(64) + 1).select("vec_id", F.round("distance", 6).alias("distance"))


@query
def frechet_shift(spark: SparkSession, d: str) -> DataFrame:
    """Distance of the vectors from themselves moved by a quarter in every dimension."""
    c = _corpus(spark, d)
    moved = c.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.25)))
    return spark.createDataFrame([(round(stats.frechet(c.withColumn("embedding", F.col("embedding").cast("array<double>")), moved.withColumn("embedding", F.col("embedding").cast("array<double>"))), 4),)], "distance double")


@query
def covariance(spark: SparkSession, d: str) -> DataFrame:
    _, _, cov = stats.covariance(_corpus(spark, d))
    return spark.createDataFrame([(i, j, round(float(v), 9)) for i, row in enumerate(cov) for j, v in enumerate(row)], "i int, j int, covariance double")


@query
def pca_2d(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    return stats.pca(c, c, 2)


@query
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    return derive.split(_corpus(spark, d), 50).select("vec_id", "part")


@query
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    return derive.draw(_corpus(spark, d), 100).select("vec_id")


@query
def block_sample(spark: SparkSession, d: str) -> DataFrame:
    return derive.block_sample(_corpus(spark, d), 10, 5).select("vec_id")


@query
def multi_vector_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as the tokens of an order: where each order begins in the flat table."""
    return derive.offsets(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id")))


@query
def multi_vector_sketch(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("doc_id"), F.col("vec_id").alias("tok_id"), "embedding")
    return derive.multi_vector_sketch(c)


def _by_label(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e.filter("label < 5").select("vec_id", "embedding"), e.filter("label >= 5").select("vec_id", "embedding")


@query
def ood_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances of two distributions, and of halves of one as the null."""
    return stats.ood_table(*_by_label(spark, d))


# Configurations and their analysis


def _summary(spark: SparkSession, d: str) -> DataFrame:
    """Configurations with finite numbers, each once."""
    s = table(spark, d, "summary").drop("exported_at")
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return s.filter(F.col("dataset").isNotNull() & F.col("algorithm").isNotNull() & fine("qps") & (F.col("qps") > 0) & fine("recall") & F.col("recall").between(0, 1)).distinct()


@query
def fastest_at(spark: SparkSession, d: str) -> DataFrame:
    return ranks.fastest_at(_summary(spark, d), 0.9, 100).select("dataset", "algorithm", "params", "qps", "recall")


@query
def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    return ranks.pareto_front(_summary(spark, d).filter("k = 100"), ["dataset", "algorithm"]).select("dataset", "algorithm", "params", "qps", "recall")


@query
def radar_score(spark: SparkSession, d: str) -> DataFrame:
    return ranks.radar_score(_summary(spark, d), 0.9, 100).select("algorithm", F.round("score", 9).alias("score"), "datasets_met")


def _detail(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "detail").filter(F.col("dataset").isNotNull()).distinct()


@query
def difficulty_split(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the easier the higher their mean recall over all configurations."""
    detail = _detail(spark, d).filter("k = 100 AND recall IS NOT NULL AND recall BETWEEN 0 AND 1 AND time > 0 AND NOT isnan(time)")
    contrast = detail.groupBy("dataset", "query_index").agg(F.round(F.avg("recall"), 9).alias("rc100"))
    out = ranks.difficulty_split(detail, contrast, ranks.fastest_at(_summary(spark, d), 0.0, 100))
    return out.select("algorithm", "dataset", *[F.round(c, 6).alias(c) for c in ("easy", "difficult", "mean_recall")], F.round("qps", 3).alias("qps"))


@query
def performance_gap(spark: SparkSession, d: str) -> DataFrame:
    """Every dataset against the one that follows it in its distance by name."""
    follows = F.lead("dataset").over(Window.partitionBy("distance").orderBy("dataset"))
    pairs = table(spark, d, "dataset_info").filter("distance IS NOT NULL").select(F.col("dataset").alias("inside_of"), follows.alias("outside_of")).filter("outside_of IS NOT NULL")
    return ranks.performance_gap(_summary(spark, d), pairs, 0.5, 100)


@query
def metric_table(spark: SparkSession, d: str) -> DataFrame:
    t = ranks.metric_ranks(_summary(spark, d).filter("build_time > 0"), "build_time", 0.5, 100)
    return t.select("algorithm", "dataset", "value", "rank", F.round("average_rank", 9).alias("average_rank"))


@query
def legend_order(spark: SparkSession, d: str) -> DataFrame:
    return ranks.legend_order(_summary(spark, d).filter("k = 100"), 0.95)


@query
def average_rank(spark: SparkSession, d: str) -> DataFrame:
    s = _summary(spark, d).filter("k = 100")
    return s.select("dataset", "algorithm", "params", "qps", ranks.average_rank(["dataset"], "qps", True).alias("rank"))


@query
def dataset_mean_gap(spark: SparkSession, d: str) -> DataFrame:
    """qps against the largest and the mean of its dataset."""
    w = Window.partitionBy("dataset")
    return _summary(spark, d).filter("k = 100").select("dataset", "params", "qps", (F.col("qps") / F.max("qps").over(w)).alias("share"), F.round(F.col("qps") / F.avg("qps").over(w), 6).alias("against_mean"))


@query
def median_by_dataset(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d).groupBy("dataset").agg(F.median("qps").alias("median_qps"), F.max("recall").alias("best_recall"), F.count("*").alias("n"))


@query
def completeness_grid(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of dataset and algorithm without a configuration."""
    s = _summary(spark, d)
    names = s.select("dataset").distinct().join(s.select("algorithm").distinct())  # the complete table asked for: names only
    return names.join(s, ["dataset", "algorithm"], "left_anti")


def _times(spark: SparkSession, d: str) -> DataFrame:
    """Mean times of the fastest of those configurations that have an export per query."""
    detail = _detail(spark, d).filter("k = 100 AND time > 0 AND NOT isnan(time)")
    exported = _summary(spark, d).join(detail, ["dataset", "algorithm", "params", "k"], "left_semi")
    return significance.mean_times(detail, ranks.fastest_at(exported, 0.0, 100))


@query
def wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    w = significance.wilcoxon(_times(spark, d))
    return w.select("dataset", "algorithm_a", "algorithm_b", "n", "w_plus", "w_minus", F.round("latency_a", 9).alias("latency_a"), F.round("latency_b", 9).alias("latency_b"), F.round("p_value", 6).alias("p_value"))


@query
def holm(spark: SparkSession, d: str) -> DataFrame:
    h = significance.holm(wilcoxon(spark, d), ["dataset"], ["algorithm_a", "algorithm_b"])
    return h.select("dataset", "algorithm_a", "algorithm_b", "p_value", F.round("adjusted", 6).alias("adjusted"))


@query
def indifferent_pairs(spark: SparkSession, d: str) -> DataFrame:
    return significance.indifferent(significance.holm(wilcoxon(spark, d), ["dataset"], ["algorithm_a", "algorithm_b"]))


@query
def indifferent_groups(spark: SparkSession, d: str) -> DataFrame:
    return significance.cliques(indifferent_pairs(spark, d)).select("dataset", "members")


@query
def recall_density(spark: SparkSession, d: str) -> DataFrame:
    k = stats.kde(_summary(spark, d), "recall", ["dataset"], 0.0, 1.0, 51, 0.05)
    return k.select("dataset", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


@query
def contrast_ridge(spark: SparkSession, d: str) -> DataFrame:
    """Density of the logarithm of the relative contrast, of queries of a contrast of at least 1, by label."""
    e = table(spark, d, "embeddings")
    c = e.select("vec_id", "embedding")
    q = _asking(c)
    rc = knn.query_stats(knn.knn(q, c, "euclidean", 10), knn.mean_distance(q, c, "euclidean"), (10,)).select("qid", F.round("rc10", 3).alias("rc10"))
    logs = rc.filter("rc10 >= 1").join(e.select(F.col("vec_id").alias("qid"), F.col("label").cast("string").alias("dataset")), "qid").select("dataset", F.log("rc10").alias("contrast"))
    return stats.kde(logs, "contrast", ["dataset"], 0.0, 3.5, 1000, 0.05).select("dataset", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


@query
def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Summary of a raw run of inverted lists, whose speed is given by the distances computed."""
    i, q = _ivf(spark, d, 2)
    truth = knn.knn(q, i.corpus, "euclidean", 10).withColumn("dataset", F.lit("embeddings"))
    raw = runner.padded(i.query(q, 10), q, 10).join(i.distance_computations(q), "qid")
    raw = raw.join(F.broadcast(raw.agg(F.avg("dist_comps").alias("mean"))))  # one row
    raw = raw.select(
        F.lit("embeddings").alias("dataset"), F.lit("ivf(faiss)").alias("algorithm"), F.lit("2").alias("params"), F.lit(10).alias("k"), "qid", F.col("dist_comps").cast("float").alias("time"), "distances",
        F.lit(None).cast("double").alias("best_qps"), F.col("mean").alias("best_search_time"), F.lit(0.0).alias("build_time"), F.lit(0.0).alias("index_size"),
    )
    return runner.metrics(raw, truth)[0].select("k", "dataset", "algorithm", "params", F.round("qps", 9).alias("qps"), F.round("recall", 6).alias("recall"))


# Plans

DOCUMENTS = [
    {
        "float": {
            "any": [
                {"name": "lists", "image": "lists", "module": "ivf", "constructor": "IVF", "base_args": ["@metric"], "run_groups": {"a": {"args": {"n_list": [16, 32], "parts": "@dimension"}, "query_args": [[1, 2, 4]]}}},
                {"name": "graph", "image": "graph", "module": "graph", "constructor": "Graph", "ood": True, "run_groups": {"a": {"args": [[{"degree": 8, "alpha": 1.0}, {"degree": 16, "alpha": 1.2}]], "query_args": [[10, 20], [{"steps": 5}]]}}},
            ],
            "euclidean": [{"name": "graph", "image": "graph", "module": "graph", "constructor": "Graph", "disabled": True, "run_groups": {"a": {"args": [8, 16]}, "b": {"args": [[8, 16, 24], "@count"]}}}],
        }
    }
]


def _definitions(spark: SparkSession, metric: str) -> DataFrame:
    return grid.definitions(grid.specifications(spark, DOCUMENTS), "float", metric, 64, 10)


@query
def grid_expand(spark: SparkSession, d: str) -> DataFrame:
    e, c = _definitions(spark, "euclidean"), _definitions(spark, "cosine")
    both = e.withColumn("metric", F.lit("euclidean")).unionByName(c.withColumn("metric", F.lit("cosine")))
    return both.select("metric", "algorithm", "disabled", grid.json_list(F.col("arguments")).alias("arguments"), F.size("query_arguments").alias("evaluations"))


@query
def grid_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs that are enabled and not finished, of which one is."""
    done = spark.createDataFrame([("results/embeddings/10/lists/cosine_16_64", None)], "path string, marker string").withColumn("marker", N.marker(F.lit("2")))
    every = grid.runs(grid.chosen(_definitions(spark, "cosine")), "embeddings", 10)
    return grid.unfinished(every, done).select("algorithm", "path", "parameters")


@query
def grid_capabilities(spark: SparkSession, d: str) -> DataFrame:
    return grid.capabilities(grid.specifications(spark, DOCUMENTS))


@query
def grid_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Definitions and evaluations of the suite's grids."""
    return grid.evaluation_counts(grid.definitions(grid.specifications(spark, suite.documents()), "float", "euclidean", 64, 100))


@query
def dataset_recipes(spark: SparkSession, d: str) -> DataFrame:
    return recipes.recipes(spark).select("dataset", "kind", F.concat_ws(" ", "sources").alias("sources"), "dimension", "distance", "point_type")


@query
def dataset_builds(spark: SparkSession, d: str) -> DataFrame:
    """Datasets of three kinds built from the tables here: which row is in which part."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    source = {"agnews": texts, "llama-keys": e.filter("label < 7"), "llama-queries": e.filter("label >= 7"), "glove": e}
    rows = None
    for name, test in (("agnews-mxbai-1024-euclidean", 50), ("llama-128-ip", 20), ("glove-200-cosine", 30)):
        for part, df in recipes.parts_of(name, source.__getitem__, {"": hashing_encoder}, test).items():
            one = df.select(F.lit(name).alias("dataset"), F.lit(part).alias("part"), "vec_id")
            rows = one if rows is None else rows.unionByName(one)
    return rows


def _exported(spark: SparkSession, d: str) -> tuple[export.Export, DataFrame]:
    """Two raw runs of inverted lists, whose times are given by the distances computed, and one without a speed."""
    i, q = _ivf(spark, d, 1)
    path, truth = scratch(spark, "raw"), knn.knn(q, i.corpus, "euclidean", 10).withColumn("dataset", F.lit("embeddings"))
    for n in (1, 2):
        i.set_query_arguments(n_probe=n)
        raw = runner.padded(i.query(q, 10), q, 10).join(i.distance_computations(q), "qid")
        facts = {"dataset": "embeddings", "k": 10, "algorithm": "ivf(faiss)", "run": f"r{n}", "params": str(n), "build_time": 1.0, "index_size": 2.0}
        raw = raw.withColumns({c: F.lit(v) for c, v in facts.items()}).withColumn("time", F.col("dist_comps").cast("double"))
        datasets.write_results(raw.withColumns({"best_search_time": F.lit(float(n)), "best_qps": F.lit(None).cast("double")}).drop("dist_comps"), path)
        if n == 2:
            datasets.write_results(raw.withColumns({"best_search_time": F.lit(None).cast("double"), "best_qps": F.lit(None).cast("double"), "run": F.lit("bad")}).drop("dist_comps"), path)
    return export.export(spark, path, truth, scratch(spark, "export")), truth


@query
def export_summary(spark: SparkSession, d: str) -> DataFrame:
    return _exported(spark, d)[0].summary.select("k", "dataset", "algorithm", "params", "qps", F.round("recall", 6).alias("recall"), "build_time", "index_size")


@query
def export_detail(spark: SparkSession, d: str) -> DataFrame:
    return _exported(spark, d)[0].detail.select("dataset", "query_index", "k", "params", F.col("time").cast("double").alias("time"), F.round("recall", 6).alias("recall"))


@query
def export_skipped(spark: SparkSession, d: str) -> DataFrame:
    return _exported(spark, d)[0].skipped


@query
def export_stats(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    q = _asking(c)
    s = export.dataset_stats({"embeddings": (knn.knn(q, c, "euclidean", 100), knn.mean_distance(q, c, "euclidean"))})
    return s.select("dataset", "query_index", *[F.round(n, 3).alias(n) for n in s.columns[2:]])


@query
def export_info(spark: SparkSession, d: str) -> DataFrame:
    return export.info(table(spark, d, "vectors").dropDuplicates(["vec_id"]))


@query
def export_plane(spark: SparkSession, d: str) -> DataFrame:
    a, b = _by_label(spark, d)
    return export.plane("embeddings", {"train": a, "test": b})


# Names and texts


@query
def dataset_names(spark: SparkSession, d: str) -> DataFrame:
    p = N.parse_dataset(F.col("dataset"))
    return table(spark, d, "dataset_info").select("dataset", p["dimension"].alias("dimension"), p["distance"].alias("distance"), p["point_type"].alias("point_type"), N.title(F.col("dataset")).alias("title"))


@query
def parameter_slugs(spark: SparkSession, d: str) -> DataFrame:
    s = N.slug(F.col("params"))
    return table(spark, d, "summary").select("params").distinct().select("params", s.alias("slug"), N.marker(s).alias("marker"))


@query
def distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    return derive.distinct_texts(table(spark, d, "documents").select("doc_id", "text", "source")).select("doc_id", "source")


@query
def joined_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", derive.joined_text("source", "lang", "dataset").alias("text"))


@query
def first_text(spark: SparkSession, d: str) -> DataFrame:
    """The earliest document of each source."""
    docs = table(spark, d, "documents").withColumn("at", F.struct("created_at", "doc_id"))
    return derive.first_per(docs, "source", "doc_id", "at")


@query
def encoded_texts(spark: SparkSession, d: str) -> DataFrame:
    train, test = text_dataset(table(spark, d, "documents"), hashing_encoder, 100)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).select("vec_id", "part", F.size("embedding").alias("dimension"))


@query
def prefixed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a prefix, encoded and layer-normalized."""
    e = encoded(table(spark, d, "documents"), hashing_encoder, "passage")
    return e.withColumn("embedding", V.layer_norm(F.col("embedding")))


@query
def cpu_ranges(spark: SparkSession, d: str) -> DataFrame:
    given = spark.createDataFrame([("0-3,8",), ("5-2",), ("7",)], "given string")
    return given.select("given", N.cpu_range(F.col("given")).alias("cpus"))


# Files and folders, written to the shared folder and read again


@query
def fbin_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All vectors through one file of rows, dimension and numbers, whose row numbers are the ids."""
    path = scratch(spark, "fbin")
    files.write_fbin(_corpus(spark, d).coalesce(1).sortWithinPartitions("vec_id"), path)
    return files.read_fbin(spark, f"{path}/part-00000.fbin").withColumn("embedding", F.col("embedding").cast("array<double>"))


@query
def npy_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The same through a matrix as numpy saves it, without its first and its last two rows."""
    path = scratch(spark, "npy")
    files.write_npy(_corpus(spark, d).coalesce(1).sortWithinPartitions("vec_id"), path)
    return files.read_npy(spark, f"{path}/part-00000.npy", 1, 2).withColumn("embedding", F.col("embedding").cast("array<double>"))


@query
def corpus_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents through JSON lines of id, title and text."""
    path = scratch(spark, "lines") + "/json"
    table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("_id"), F.col("source").alias("title"), "text").write.json(path)
    return files.read_corpus(spark, path).select("id", F.md5("text").alias("text"))


@query
def first_captions(spark: SparkSession, d: str) -> DataFrame:
    """The fixed 25 nations as captions of their regions, in one JSON document: the first caption of each."""
    path = scratch(spark, "captions") + "/json"
    rows = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_regionkey", "n_name")))
    item = lambda x: F.struct(x["n_regionkey"].cast("bigint").alias("image_id"), x["n_name"].alias("caption"))
    table(spark, d, "nation").agg(rows.alias("l")).select(F.transform("l", item).alias("annotations")).write.json(path)
    return files.read_captions(spark, path)


@query
def learn_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of learn vectors, as written with their dataset."""
    path, c = scratch(spark, "learn"), _corpus(spark, d)
    learn = c.filter("vec_id % 20 = 7")
    datasets.write_dataset(spark, path, "embeddings-64-euclidean", c, _asking(c).withColumnRenamed("qid", "vec_id"), "euclidean", "float", 5, learn)
    vectors, near = datasets.read_learn(spark, path)
    return near.join(vectors.select(F.col("vec_id").alias("learn_id")), "learn_id").select("learn_id", "rank", "vec_id")


@query
def rows_in_range(spark: SparkSession, d: str) -> DataFrame:
    return datasets.row_range(_corpus(spark, d), 100, 50).select("vec_id")


@query
def resplit_parts(spark: SparkSession, d: str) -> DataFrame:
    """Test rows drawn anew from the train rows of all datasets."""
    return derive.resplit(table(spark, d, "vectors").dropDuplicates(["vec_id"]).select("vec_id", "part"), 100).select("vec_id", "part")


@query
def glove_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "glove") + "/lines"
    _corpus(spark, d).select(F.concat_ws(" ", F.concat(F.lit("w"), "vec_id"), F.array_join(F.col("embedding").cast("array<string>"), " ")).alias("value")).write.text(path)
    return files.read_glove(spark, path).withColumn("embedding", F.col("embedding").cast("array<double>"))


@query
def dataset_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Ground truth of a dataset with the asking vectors as its test part, as written with it."""
    path, c = scratch(spark, "dataset"), _corpus(spark, d)
    datasets.write_dataset(spark, path, "embeddings-64-euclidean", c, _asking(c).withColumnRenamed("qid", "vec_id"), "euclidean", "float", 10)
    train, test, _ = datasets.read_dataset(spark, path)
    near = spark.read.parquet(f"{path}/neighbours").join(spark.read.parquet(f"{path}/distances"), "qid")
    return near.select("qid", "rank", "vec_id", "distance", "avg_distance")


@query
def results_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Results of two runs, of which one is written twice."""
    path = scratch(spark, "results")
    o = table(spark, d, "orders").select(F.lit("d").alias("dataset"), F.lit(10).alias("k"), F.lit("a").alias("algorithm"), F.concat(F.lit("run"), "o_orderstatus").alias("run"), F.col("o_orderkey").alias("qid"), F.col("o_totalprice").alias("time"))
    datasets.write_results(o, path)
    datasets.write_results(o.filter("run = 'runO'").withColumn("time", F.col("time") * 2), path)
    return datasets.read_results(spark, path, "d", 10).select("run", "qid", "time")


@query
def front_points(spark: SparkSession, d: str) -> DataFrame:
    p = report.front_points(ranks.pareto_front(_summary(spark, d).filter("k = 100"), ["dataset", "algorithm"]))
    return p.select("dataset", "algorithm", F.size("points").alias("steps"), F.element_at("points", 1)["qps"].alias("fastest"), F.element_at("points", -1)["recall"].alias("best_recall"))


# Joins, aggregates, windows, sorts and sets on relational tables


@query
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    r: Callable[[Column], Column] = lambda c: F.round(c, 2)
    return li.groupBy("l_returnflag", "l_linestatus").agg(r(F.sum("l_quantity")).alias("quantity"), r(F.sum(net)).alias("net"), r(F.sum(net * (1 + F.col("l_tax")))).alias("gross"), r(F.avg("l_discount")).alias("discount"), F.count("*").alias("n"))


@query
def nation_revenue(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query
def dominated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order beaten by another one in quantity and discount: a self-join on the order with a residual."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    o = li.select("l_orderkey", F.col("l_quantity").alias("q"), F.col("l_discount").alias("s"))
    beats = (F.col("q") >= F.col("l_quantity")) & (F.col("s") >= F.col("l_discount")) & ((F.col("q") > F.col("l_quantity")) | (F.col("s") > F.col("l_discount")))
    return li.join(o, "l_orderkey").filter(beats).select("l_orderkey", "l_linenumber").distinct()


@query
def front_lines(spark: SparkSession, d: str) -> DataFrame:
    return ranks.pareto_front(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", "l_discount").select("l_orderkey", "l_linenumber")


@query
def customers_without_urgent_orders(spark: SparkSession, d: str) -> DataFrame:
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query
def customers_with_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query
def orders_per_customer(spark: SparkSession, d: str) -> DataFrame:
    """All customers, those without orders with 0."""
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    j = n.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right").na.fill({"n": 0, "total": 0.0})
    return j.select("c_custkey", "n", F.round("total", 2).alias("total"))


@query
def nation_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Unordered pairs of nations of a region."""
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_name").alias("a"), "n_regionkey"), n.select(F.col("n_name").alias("b"), "n_regionkey")
    return a.join(b, "n_regionkey").filter("a < b").select("a", "b")


@query
def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)


@query
def unpivoted_prices(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "kind", "value")


@query
def two_level_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the customers' mean order prices per segment."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    per = o.groupBy("c_mktsegment", "o_custkey").agg(F.avg("o_totalprice").alias("m"))
    return per.groupBy("c_mktsegment").agg(F.round(F.avg("m"), 4).alias("mean"), F.count_if(F.col("m") > 200000).alias("large"), F.count_distinct("o_custkey").alias("customers"))


@query
def largest_order(spark: SparkSession, d: str) -> DataFrame:
    best = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", "o_orderkey")).alias("o"))
    return best.select("o_custkey", "o.o_orderkey", "o.o_totalprice")


@query
def running_maximum(spark: SparkSession, d: str) -> DataFrame:
    return derive.running_max(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_totalprice", "so_far").select("o_orderkey", "so_far")


@query
def order_positions(spark: SparkSession, d: str) -> DataFrame:
    """The place of each order by price among those of its status, groups of any size."""
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    return positions(o, ["o_orderstatus"], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])


@query
def quantity_bands(spark: SparkSession, d: str) -> DataFrame:
    """Cases without a default, null where none holds, and their counts."""
    band = F.when(F.col("l_quantity") < 10, "small").when(F.col("l_quantity") >= 40, "large")
    return table(spark, d, "lineitem").select(band.alias("band"), "l_extendedprice").groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum(F.log("l_extendedprice")), 4).alias("logs"))


@query
def names_union(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n, c: table(spark, d, n).select(F.col(c).alias("nationkey"))
    return t("customer", "c_nationkey").unionAll(t("supplier", "s_nationkey")).distinct()


@query
def parts_not_in_large_lots(spark: SparkSession, d: str) -> DataFrame:
    large = table(spark, d, "lineitem").filter("l_quantity >= 45").select(F.col("l_partkey").alias("partkey")).distinct()
    return table(spark, d, "part").select(F.col("p_partkey").alias("partkey")).exceptAll(large)


# Windows over events


@query
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    w = windows.tumbling(table(spark, d, "events"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query
def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    w = windows.sliding(table(spark, d, "events"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    w = windows.sessions(table(spark, d, "events"))
    return w.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("total", 4).alias("total"))


@query
def events_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The tumbling windows of the events, read as a stream of files."""
    folder, events = scratch(spark, "stream"), table(spark, d, "events")
    events.repartition(4).write.parquet(f"{folder}/in")
    w = windows.streamed(spark, f"{folder}/in", events.schema, folder)
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query
def sessions_streamed(spark: SparkSession, d: str) -> DataFrame:
    folder, events = scratch(spark, "stream"), table(spark, d, "events")
    events.repartition(3).write.parquet(f"{folder}/in")
    w = windows.streamed(spark, f"{folder}/in", events.schema, folder, windows.sessions)
    return w.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("total", 4).alias("total"))
