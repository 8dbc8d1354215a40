import os

import pytest

from vecquarry.operators import index, knn
from vecquarry.queries import QUERIES, _asking, _corpus

DATA = os.environ.get("TEST_LARGE_SF_DIR", "/root/testdata/sf0.1")


@pytest.fixture(scope="module")
def truth(spark):
    c = _corpus(spark, DATA)
    return {(r["qid"], r["vec_id"]) for r in knn.knn(_asking(c), c, "euclidean", 10).collect()}


@pytest.mark.parametrize("name", ["ivf_kmeans_search", "ivf_sq8_search", "ivf_pq_search", "ivf_bits_search", "tree_search", "graph_search", "lowrank_search"])
def test_registered_searches_find_most(spark, truth, name):
    got = {(r["qid"], r["vec_id"]) for r in QUERIES[name](spark, DATA).collect()}
    share = len(got & truth) / len(truth)
    print(name, share)
    assert share >= 0.9


def test_registered_descent_finds_most_edges(spark):
    exact = {(r["src"], r["dst"]) for r in index.knn_graph(_corpus(spark, DATA), 10, "euclidean").collect()}
    got = {(r["src"], r["dst"]) for r in QUERIES["nn_descent"](spark, DATA).collect()}
    share = len(got & exact) / len(exact)
    print("nn_descent", share)
    assert len(got) == len(exact) and share >= 0.9
