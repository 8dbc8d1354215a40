import numpy as np

from vecquarry.llm import neighbours as N


def test_recall_stays_as_a_dataset_grows(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((6000, 24)) + 0.3
    rows = [("d", "train", i, [float(v) for v in r]) for i, r in enumerate(x)]
    v = spark.createDataFrame(rows, "dataset string, part string, vec_id bigint, embedding array<double>")
    info = spark.createDataFrame([("d", 24)], "dataset string, dimension int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i, near in enumerate(np.argsort(-s, axis=1)[:, :5]) for j in near}
    # as many windows as a dataset of 186,000 train rows has
    got = {(r["vec_id"], r["neighbour"]) for r in N.neighbours(v, info, 5, cell=524, window=33).collect()}
    print("share", len(got & want) / len(want))
    assert len(got & want) >= 0.9 * len(want)
