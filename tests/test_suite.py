import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import vecquarry.__main__ as cli
from vecquarry.operators import index, knn
from vecquarry.plans import export, runner
from vecquarry.sources import datasets, recipes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small dataset under a name of the suite, and a quantized one made from it."""
    at = str(tmp_path_factory.mktemp("suite"))
    x = np.random.default_rng(0).standard_normal((300, 8)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    source = {"agnews": spark.createDataFrame([(i, f"text {i % 290}") for i in range(300)], "vec_id bigint, text string")}
    recipes.build(spark, at, "agnews-mxbai-1024-euclidean", source.__getitem__, {"": datasets.hashing_encoder}, count=10, test=20)
    recipes.build(spark, at, "agnews-mxbai-1024-euclidean-uint8", count=10)
    return at, table


def test_builds(spark, folder):
    at, _ = folder
    train, test, distance = datasets.read_dataset(spark, f"{at}/agnews-mxbai-1024-euclidean")
    assert (train.count(), test.count(), distance) == (270, 20, "euclidean")
    small = datasets.read_dataset(spark, f"{at}/agnews-mxbai-1024-euclidean-uint8")[0]
    assert small.schema["embedding"].dataType.elementType.typeName() == "short" and 0 <= small.select(F.min(F.array_min("embedding"))).first()[0]
    for bad in (lambda: recipes.build(spark, at, "nothing"), lambda: recipes.build(spark, at, "dpr-jina-768-hamming-binary"), lambda: recipes.build(spark, at, "dpr-jina-768-normalized"), lambda: recipes.shape("a-b")):
        with pytest.raises(ValueError):
            bad()


def test_parts_of_other_kinds(spark, folder):
    _, table = folder
    source = {"llama-keys": table, "llama-queries": table.filter("vec_id < 90"), "yandex": table, "yandex-queries": table.filter("vec_id < 40"), "yandex-learn": table.filter("vec_id > 200")}
    assert {p: d.count() for p, d in recipes.parts_of("llama-128-ip", source.__getitem__, {}, 30).items()} == {"train": 300, "test": 30, "learn": 60}
    assert {p: d.count() for p, d in recipes.parts_of("yandex-200-cosine", source.__getitem__, {}, 30).items()} == {"train": 300, "test": 30, "learn": 99}
    tokens = table.withColumns({"tok_id": F.col("vec_id"), "vec_id": F.col("vec_id") % 20, "part": F.when(F.col("vec_id") % 20 < 5, "test").otherwise("train")})
    parts = recipes.parts_of("cqadupstack-muvera-5120-ip", lambda _: tokens, {})
    assert {p: (d.count(), len(d.first()["embedding"])) for p, d in parts.items()} == {"train": (15, 64), "test": (5, 64)}
    assert len(recipes.RECIPES) == 35


def test_command_line(spark, folder, tmp_path, capsys):
    at, _ = folder
    definitions = tmp_path / "definitions" / "ivf"
    definitions.mkdir(parents=True)
    algorithm = {"name": "ivf(faiss)", "image": "i", "module": "m", "constructor": "C", "base_args": ["@metric"], "run_groups": {"g": {"args": {"n_list": [4]}, "query_args": {"n_probe": [1, 4]}}}}
    broken = algorithm | {"name": "unknown"}
    (definitions / "config.yml").write_text(json.dumps({"float": {"any": [algorithm, broken]}}))
    base = ["run", "--dataset", "agnews-mxbai-1024-euclidean", "--data", at, "--results", str(tmp_path / "results"), "-k", "5", "--runs", "1", "--definitions", str(tmp_path / "definitions")]
    assert cli.main([*base, "--dry"], spark) == 0
    assert cli.main(base, spark) == 1  # the algorithm that is not known
    args = cli.parser().parse_args(base)
    assert {r["algorithm"] for r in cli.planned(spark, args).collect()} == {"unknown"}
    assert cli.planned(spark, cli.parser().parse_args([*base, "--force"])).count() == 4
    assert cli.main(["export", "--results", str(tmp_path / "results"), "--data", at, "--datasets", "agnews-mxbai-1024-euclidean", "--output", str(tmp_path / "out")], spark) == 0
    summary = {r["params"]: r for r in spark.read.parquet(str(tmp_path / "out" / "summary")).collect()}
    assert summary["4"]["recall"] == 1.0 and summary["1"]["recall"] <= 1 and summary["1"]["index_size"] > 0 and summary["1"]["qps"] > 0
    assert cli.main(["list"], spark) == 0 and "hnswlib" in capsys.readouterr().out
    for bad in (["run"], [*base, "-k", "0"], ["fly"]):
        with pytest.raises(SystemExit):
            cli.main(bad, spark)


def test_recalls_are_kept(spark, folder, tmp_path):
    _, table = folder
    q = table.filter("vec_id < 10").withColumnRenamed("vec_id", "qid")
    truth = knn.knn(q, table, "euclidean", 3).withColumn("dataset", F.lit("d"))
    raw = runner.padded(truth, q, 3).withColumns({"dataset": F.lit("d"), "k": F.lit(3), "algorithm": F.lit("a"), "run": F.lit("r1")})
    first = export.recalls(raw, truth, str(tmp_path / "recalls"))
    assert first.agg(F.avg("recall"), F.count("*")).first()[:] == (1.0, 10)
    # a run that is there is not computed again, even if it has changed
    again = raw.withColumn("distances", F.array(F.lit(9.0))).unionByName(raw.withColumn("run", F.lit("r2")))
    assert {(r["run"], r["recall"], r["n"]) for r in export.recalls(again, truth, str(tmp_path / "recalls")).groupBy("run").agg(F.avg("recall").alias("recall"), F.count("*").alias("n")).collect()} == {("r1", 1.0, 10), ("r2", 1.0, 10)}


def test_single_queries_are_timed(spark, folder):
    _, table = folder
    flat = index.Flat().fit(table)
    times = runner.run_each(flat, "flat(faiss)", {}, table.filter("vec_id < 3").withColumnRenamed("vec_id", "qid"), 2)
    assert times.count() == 3 and times.filter("time <= 0").count() == 0
    assert runner.index_size(index.IVF(n_list=4).fit(table)) > 1


def test_points_on_the_plane(spark, folder):
    _, table = folder
    p = export.plane("d", {"train": table, "test": table.filter("vec_id < 5")}).collect()
    assert len(p) == 305 and abs(np.mean([r["x"] for r in p if r["part"] == "train"])) < 1e-9
    x = np.array([r["embedding"] for r in table.orderBy("vec_id").collect()])
    d = x - x.mean(axis=0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(x.T)), d))
    assert np.allclose([r["mahalanobis_distance_to_data"] for r in sorted(p, key=lambda r: (r["part"] != "train", r["vec_id"]))[:300]], want)
