import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecquarry.functions import names as N
from vecquarry.functions import vector as V
from vecquarry.operators import derive


def one(spark, expression, **columns):
    kinds = {list: "array<double>", str: "string", int: "int"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in columns.items())
    return spark.createDataFrame([tuple(columns.values())], schema).select(expression.alias("x")).first()["x"]


def test_metrics(spark):
    a, b = [0.5, -1.5, 2.0], [1.0, 0.25, -0.5]
    x, y = np.array(a), np.array(b)
    get = lambda f: one(spark, f(F.col("a"), F.col("b")), a=a, b=b)
    assert get(V.euclidean) == pytest.approx(np.linalg.norm(x - y))
    assert get(V.inner_product) == pytest.approx(-(x @ y))
    assert get(V.cosine) == pytest.approx(1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y))
    assert get(V.normalized) == pytest.approx(min(2, max(0, 1 - x @ y)))
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) is None
    with pytest.raises(ValueError):
        V.metric("manhattan")


def test_hamming_and_bits(spark):
    a = [0.5, -1, 0, 3, 1, -2, 0.1, 0.2, 7.0, -1]
    packed = one(spark, V.pack_bits(F.col("a")), a=[float(v) for v in a])
    assert packed == list(np.packbits(np.array(a) > 0))
    bits = spark.createDataFrame([(packed,)], "a array<int>").select(V.unpack_bits(F.col("a")).alias("x"), V.hamming(F.col("a"), F.transform("a", lambda v: v.bitwiseXOR(F.lit(3)))).alias("h")).first()
    assert bits["x"] == [float(v > 0) for v in a] + [0.0] * 6 and bits["h"] == 4.0


def test_normalize(spark):
    assert one(spark, V.normalize(F.col("a")), a=[0.0] * 4) == [0.5] * 4
    assert one(spark, V.normalize(F.col("a")), a=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert np.linalg.norm(one(spark, V.reduce_dimension(F.col("a"), 2), a=[1.0, 2.0, 3.0])) == pytest.approx(1)
    assert one(spark, V.l2_normalize(F.col("a")), a=[0.0, 0.0]) == [0.0, 0.0]
    ln = one(spark, V.layer_norm(F.col("a")), a=[1.0, 2.0, 3.0])
    assert np.mean(ln) == pytest.approx(0) and np.std(ln) == pytest.approx(1, abs=1e-4)


def test_quantize(spark):
    train = spark.createDataFrame([(0, [0.0, 5.0, -1.0]), (1, [255.0, 5.0, 2.54])], "vec_id bigint, embedding array<double>")
    test = spark.createDataFrame([(2, [300.0, 7.0, 0.02]), (3, [-4.0, 1.0, -9.0])], "vec_id bigint, embedding array<double>")
    assert [r["embedding"] for r in derive.quantize(test, "uint8", train).orderBy("vec_id").collect()] == [[255, 0, 73], [0, 0, 0]]
    assert [r["embedding"] for r in derive.quantize(test, "int8", train).orderBy("vec_id").collect()] == [[127, 127, 1], [-2, 25, -127]]
    for bad in (("uint8", "ip"), ("binary", "cosine")):
        with pytest.raises(ValueError):
            derive.quantize(test, bad[0], train, bad[1])


def test_names(spark):
    p = lambda s: tuple(one(spark, N.parse_dataset(F.col("s")), s=s))
    assert p("a-b-64") == (64, "normalized", "float") and p("a-64-ip") == (64, "ip", "float")
    assert p("a-b-64-hamming-binary") == (64, "hamming", "binary") and p("a-b") == (None, None, None)
    assert one(spark, N.slug(F.col("s")), s='["euclidean", 8.5]') == "euclidean_8_5"
    assert one(spark, N.cpu_range(F.col("s")), s="0-3, 8,6-5,1") == [0, 1, 2, 3, 5, 6, 8]
    assert one(spark, N.title(F.col("s")), s="a-b-64-ip") == "a-b" and one(spark, N.whole(F.col("s")), s=12) == "12"


def test_samples(spark):
    df = spark.range(1000).withColumnRenamed("id", "vec_id")
    parts = {r["part"]: r["count"] for r in derive.split(df, 100).groupBy("part").count().collect()}
    assert parts == {"test": 100, "train": 900}
    a, b = (sorted(r["vec_id"] for r in derive.draw(df.repartition(n), 50).collect()) for n in (3, 8))
    assert a == b and len(set(a)) == 50
    assert derive.draw(df, 5000).count() == 1000
    got = sorted(r["vec_id"] for r in derive.block_sample(df, 10, 5).collect())
    assert len(got) == 50 and all(len([g for g in got if g // 100 == i]) == 5 for i in range(10))


def test_multi_vector(spark):
    rows = [(d, t, [float(d + t), 1.0]) for d in range(3) for t in range(d + 1)]
    tokens = spark.createDataFrame(rows, "doc_id bigint, tok_id bigint, embedding array<double>")
    assert [(r["count"], r["start"]) for r in derive.offsets(tokens).orderBy("doc_id").collect()] == [(1, 0), (2, 1), (3, 3)]
    sketch = {r["doc_id"]: np.reshape(r["embedding"], (8, 2)) for r in derive.multi_vector_sketch(tokens).collect()}
    assert sketch[2].sum(axis=0) == pytest.approx([9.0, 3.0])


def test_functions_are_linear_in_the_dimension(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1000, 1024))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").coalesce(1).cache()
    df.count()
    for f in (V.normalize, V.layer_norm, V.l2_normalize, lambda a: V.reduce_dimension(a, 512)):
        col = F.aggregate(f(F.col("embedding")), F.lit(0.0), lambda a, b: a + b)
        df.limit(3).select(col).collect()
        began = time.perf_counter()
        df.agg(F.sum(col)).collect()
        assert time.perf_counter() - began < 3


def test_tiles_give_the_same_neighbours():
    from vecquarry.functions import kernels as K

    rng = np.random.default_rng(3)
    a, b, ids = rng.integers(0, 3, (20, 4)).astype(float), rng.integers(0, 3, (300, 4)).astype(float), rng.permutation(300)
    for metric in ("euclidean", "cosine", "ip", "hamming"):
        x, y = K.prepare(a, metric), K.prepare(b, metric)
        d = np.round(K.distances(x, y, metric), 6)
        want = [sorted(range(300), key=lambda j: (np.isnan(d[i, j]), d[i, j] if d[i, j] == d[i, j] else 0, ids[j]))[:7] for i in range(20)]
        for tile in (9, 64, 4096):
            cols, near = K.nearest(x, y, ids, metric, 7, 6, tile)
            assert cols.tolist() == want and np.array_equal(near, np.take_along_axis(d, cols, 1), equal_nan=True)
