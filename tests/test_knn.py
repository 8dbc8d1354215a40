import numpy as np
import pytest
from pyspark.sql import functions as F

from vecquarry.operators import index, knn
from vecquarry.plans import registry, runner


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((8, 12))
    x = centers[rng.integers(8, size=400)] + 0.4 * rng.standard_normal((400, 12))
    corpus = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>").cache()
    queries = corpus.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid").cache()
    return x, corpus, queries


def brute(x, metric, k):
    q = x[::20]
    if metric == "euclidean":
        d = np.linalg.norm(q[:, None] - x[None], axis=2)
    elif metric == "ip":
        d = -(q @ x.T)
    else:
        d = 1 - (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    return {(20 * i, int(j)) for i in range(len(q)) for j in np.argsort(d[i], kind="stable")[:k]}


def pairs(df):
    return {(r["qid"], r["vec_id"]) for r in df.collect()}


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "ip"])
def test_exact(data, metric):
    x, corpus, queries = data
    assert pairs(knn.knn(queries, corpus, metric, 7)) == brute(x, metric, 7)
    assert pairs(knn.knn(queries, corpus, metric, 7, chunk=90, block=6)) == brute(x, metric, 7)


def test_ties_nulls_and_few_rows(spark):
    corpus = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (7, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    queries = spark.createDataFrame([(0, [2.0, 0.0]), (1, None)], "qid bigint, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["distance"]) for r in knn.knn(queries, corpus, "cosine", 5).orderBy("rank").collect()]
    assert got == [(1, 1, 0.0), (2, 3, 0.0), (3, 7, None)]
    padded = runner.padded(knn.knn(queries, corpus, "euclidean", 2).filter("vec_id <> 7"), queries, 3).orderBy("qid").collect()
    assert padded[0]["neighbours"] == [1, 3, -1] and padded[0]["distances"][2] == float("inf") and padded[1]["neighbours"] == [-1] * 3
    assert knn.knn(queries, corpus.limit(0), "ip", 3).count() == 0


def test_recall_and_stats(spark, data):
    x, corpus, queries = data
    truth = knn.knn(queries, corpus, "euclidean", 10)
    assert {r["recall"] for r in knn.recall(truth, truth, 10).collect()} == {1.0}
    twice = truth.filter("rank = 1").unionAll(truth.filter("rank = 1"))
    assert {r["recall"] for r in knn.recall(twice, truth, 10).collect()} == {0.2}
    assert {r["recall"] for r in knn.recall_ids(twice, truth, 10).collect()} == {0.1}
    s = {r["qid"]: r for r in knn.query_stats(truth, knn.mean_distance(queries, corpus, "euclidean"), (1, 10)).collect()}
    d = np.sort(np.linalg.norm(x[0] - x, axis=1))
    assert s[0]["rc1"] is None and s[0]["rc10"] == pytest.approx(d.mean() / d[9], rel=1e-4)
    assert s[0]["lid10"] == pytest.approx(-9 / np.log(d[1:10] / d[9]).sum(), rel=1e-3)


FAMILIES = {
    "ivf": (lambda: index.IVF(n_list=8), {"n_probe": 3}),
    "sq": (lambda: index.IVF(n_list=8, codes=index.ScalarCodes(4, rotate=True)), {"n_probe": 3, "k_factor": 3}),
    "pq": (lambda: index.IVF(n_list=8, codes=index.ProductCodes(6, 16, rotate=True)), {"n_probe": 3, "k_factor": 5}),
    "bits": (lambda: index.IVF(n_list=8, codes=index.SignCodes()), {"n_probe": 3, "k_factor": 10}),
    "lsh": (lambda: index.Hashing(tables=8, bits=4), {"probes": 4}),
    "trees": (lambda: index.Trees(trees=10, depth=3), {"votes": 2}),
    "graph": (lambda: index.Graph(degree=10, descent=3, codes=index.ScalarCodes()), {"beam": 40}),
    "lowrank": (lambda: index.LowRank(rank=8, n_list=6), {"n_probe": 3, "rerank": 40}),
}


@pytest.mark.parametrize("family", FAMILIES)
def test_families_find_most(data, family):
    x, corpus, queries = data
    make, arguments = FAMILIES[family]
    got = pairs(make().fit(corpus).set_query_arguments(**arguments).query(queries, 5))
    want = brute(x, "euclidean", 5)
    assert len(got & want) >= 0.9 * len(want)


def test_all_lists_are_exact(data, monkeypatch):
    x, corpus, queries = data
    monkeypatch.setattr(index, "PIECE", 30)  # large buckets are split
    i = index.IVF(n_list=6).fit(corpus).set_query_arguments(n_probe=6)
    assert pairs(i.query(queries, 5)) == brute(x, "euclidean", 5)
    comps = {r["dist_comps"] for r in i.distance_computations(queries).collect()}
    assert comps == {406}


def test_learning_from_queries(data):
    x, corpus, queries = data
    learn = corpus.withColumnRenamed("vec_id", "qid")
    near = knn.knn(learn, corpus, "cosine", 10).cache()
    want = brute(x, "cosine", 5)
    trees = index.Trees(metric="cosine", trees=8, depth=3, supervised=True).fit_ood(corpus, learn, near)
    votes = trees.autotune(queries, knn.knn(queries, corpus, "cosine", 5), 5, 0.9)
    assert len(pairs(trees.set_query_arguments(votes=max(1, votes)).query(queries, 5)) & want) >= 0.85 * len(want)
    graph = index.Graph(metric="cosine", degree=10, bipartite=True).fit_ood(corpus, learn, near).set_query_arguments(beam=40)
    assert len(pairs(graph.query(queries, 5)) & want) >= 0.9 * len(want)
    for bad in (lambda: index.Trees(supervised=True).fit(corpus), lambda: index.Graph(bipartite=True).fit(corpus), lambda: index.Hashing(metric="hamming"), lambda: index.ScalarCodes(5).fit(x)):
        with pytest.raises(ValueError):
            bad()


def test_graph_tools(data):
    _, corpus, _ = data
    exact = index.knn_graph(corpus, 6, "euclidean")
    near = index.nn_descent(corpus, 6, "euclidean", 5)
    e, n = ({(r["src"], r["dst"]) for r in g.collect()} for g in (exact, near))
    assert len(e) == 2400 and len(e & n) >= 0.85 * len(e)
    kept = index.prune(exact, corpus, 4, "euclidean", 1.2)
    assert {(r["src"], r["dst"]) for r in kept.collect()} <= e and kept.groupBy("src").count().agg({"count": "max"}).first()[0] <= 4


def test_registry_and_runs(spark, data):
    _, corpus, queries = data
    assert len(registry.REGISTRY) >= 45 and {e.family for e in registry.REGISTRY.values()} == {"flat", "ivf", "graph", "trees", "hashing", "lowrank"}
    for name, entry in registry.REGISTRY.items():
        assert registry.instantiate(name, entry.metrics[0]).metric == entry.metrics[0]
    with pytest.raises(ValueError):
        registry.instantiate("ggnn", "ip")
    with pytest.raises(NotImplementedError):
        runner.build("roargraph", "cosine", {}, corpus)
    i, seconds = runner.build("ivf(faiss)", "euclidean", {"n_list": 4}, corpus)
    done = runner.run(i, "ivf(faiss)", {"n_probe": 4}, queries, 5, seconds, 2)
    row = runner.summary(spark, "d", "ivf(faiss)", "p", 5, done, knn.knn(queries, corpus, "euclidean", 5)).first()
    assert row["recall"] == 1.0 and row["qps"] > 0


def test_descent_in_memory_finds_neighbours():
    from vecquarry.functions import beams
    from vecquarry.functions.kernels import nearest, prepare

    rng = np.random.default_rng(4)
    for metric, raw in (("euclidean", rng.standard_normal((1500, 12))), ("cosine", rng.standard_normal((700, 8))), ("hamming", rng.integers(0, 256, (400, 4)).astype(float))):
        x = prepare(raw, metric)
        near, far = beams.descend(x, 20, metric)
        cols, d = nearest(x, x, np.arange(len(x)), metric, 9, 6)
        assert np.mean([far[i, 7] <= d[i, 8] + 1e-5 for i in range(len(x))]) >= 0.9
    assert beams.descend(x[:1], 5, "hamming")[0].tolist() == [[-1]]


@pytest.mark.parametrize("metric,descent", [("euclidean", 0), ("cosine", 1), ("ip", 0)])
def test_graphs_of_several_shards(spark, metric, descent):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 10))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None)], "vec_id bigint, embedding array<double>")
    queries = corpus.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")
    graph = index.Graph(metric=metric, degree=12, descent=descent, shard=200).fit(corpus).set_query_arguments(beam=40)
    found = graph.query(queries, 10)
    assert graph.shards == 5 and recall_of(found, knn.knn(queries, corpus, metric, 10)) >= 0.95
    assert graph.distance_computations(queries).count() == 45


def recall_of(found, truth):
    a, b = ({(r["qid"], r["vec_id"]) for r in df.collect()} for df in (found, truth))
    return len(a & b) / len(b)


def test_parameters_of_configurations(spark, data):
    x, corpus, queries = data[0], data[1], data[2]
    truth = knn.knn(queries, corpus, "euclidean", 5)
    trees = registry.instantiate("mrpt", "euclidean", {"n_trees": 24, "depth": 3}).fit(corpus).set_query_arguments(**registry.REGISTRY["mrpt"].query({"target_recall": 0.9}))
    assert recall_of(trees.query(queries, 5), truth) >= 0.85 and trees.arguments["votes"] >= 1
    hashed = registry.instantiate("puffinn", "cosine", {"bits": 6}).fit(corpus).set_query_arguments(**registry.REGISTRY["puffinn"].query({"recall": 0.9}))
    assert recall_of(hashed.query(queries, 5), knn.knn(queries, corpus, "cosine", 5)) >= 0.8 and "probes" in hashed.arguments
    lean = registry.instantiate("vamana-leanvec(svs)", "euclidean", {"degree": 12, "reduced_dimensions": 8, "L": 40}).fit(corpus).set_query_arguments(beam=60)
    assert lean.candidates == 40 and recall_of(lean.query(queries, 5), truth) >= 0.85
    codes = index.ProductCodes(words=8, block=2, threshold=0.3).fit(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    along = lambda c: np.abs(((x - c.decode(c.encode(x))) * unit).sum(axis=1)).mean()
    assert len(codes.cuts) == -(-x.shape[1] // 2) and along(codes) < along(index.ProductCodes(words=8, block=2).fit(x))


def test_bits(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 256, (12, 8))
    rows = [(i, [int(v) ^ int(rng.random() < 0.3) << int(rng.integers(8)) for v in base[i % 12]]) for i in range(240)]
    corpus = spark.createDataFrame(rows, "vec_id bigint, embedding array<int>")
    queries = corpus.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")
    truth = knn.knn(queries, corpus, "hamming", 5)
    for i, arguments in ((registry.instantiate("annoy", "hamming", {"n_trees": 16, "depth": 3}), {"votes": 1}), (index.IVF(metric="hamming", n_list=8), {"n_probe": 4}), (index.Graph(metric="hamming", degree=12), {"beam": 40})):
        got = i.fit(corpus).set_query_arguments(**arguments).query(queries, 5)
        far = truth.groupBy("qid").agg(F.max("distance").alias("far"))
        assert got.join(far, "qid").filter("distance <= far").count() >= 0.9 * truth.count()
