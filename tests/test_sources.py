import io
import json
import struct
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecquarry.operators.knn import knn
from vecquarry.sources import datasets, files


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>")


def test_fbin(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(0).standard_normal((250, 3)).astype(np.float32)
    path = str(tmp_path / "x.fbin")
    with open(path, "wb") as f:
        f.write(struct.pack("<ii", *x.shape) + x.tobytes())
    monkeypatch.setattr(files, "ROWS", 60)
    got = files.read_fbin(spark, path).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in got] == list(range(250)) and np.array_equal(np.array([r["embedding"] for r in got], np.float32), x)
    assert [r["vec_id"] for r in files.read_fbin(spark, path, 10, 5).orderBy("vec_id").collect()] == list(range(10, 15))
    out = tmp_path / "out"
    files.write_fbin(vectors(spark, x).repartition(3), str(out))
    back = [r["embedding"] for p in sorted(out.glob("part-*.fbin")) for r in files.read_fbin(spark, str(p)).collect()]
    assert sorted(map(tuple, back)) == sorted(tuple(float(v) for v in r) for r in x)


def test_npy(spark, tmp_path):
    x = np.arange(40, dtype=np.float32).reshape(20, 2)
    np.save(tmp_path / "x.npy", x)
    got = files.read_npy(spark, str(tmp_path / "x.npy"), 1, 4).orderBy("vec_id").collect()
    assert [r["embedding"] for r in got] == x[1:-4].tolist()
    np.save(tmp_path / "y.npy", x.astype(np.float64))
    with pytest.raises(ValueError):
        files.read_npy(spark, str(tmp_path / "y.npy")).count()


def test_texts(spark, tmp_path):
    (tmp_path / "g.txt").write_text("the 0.5 -1\n\nof 2 3e-1\n")
    assert [(r["token"], r["embedding"]) for r in files.read_glove(spark, str(tmp_path / "g.txt")).collect()] == [("the", [0.5, -1.0]), ("of", [2.0, pytest.approx(0.3)])]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, [{"_id": "1", "title": "A", "text": "b"}, {"_id": "2", "text": "c"}])))
    assert [r["text"] for r in files.read_corpus(spark, str(tmp_path / "c.jsonl")).orderBy("id").collect()] == ["A b", "c"]
    (tmp_path / "a.json").write_text(json.dumps({"annotations": [{"image_id": 4, "caption": "z"}, {"image_id": 4, "caption": "a"}, {"image_id": 5, "caption": "b"}]}))
    assert {r["image_id"]: r["caption"] for r in files.read_captions(spark, str(tmp_path / "a.json")).collect()} == {4: "z", 5: "b"}


def test_images_and_archives(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("a.JPG", "d/b.jpeg", "c.png", "d/e.txt"):
        (tmp_path / n).write_bytes(n.encode())
    assert sorted(bytes(r["content"]).decode() for r in files.read_images(spark, str(tmp_path)).collect()) == ["a.JPG", "c.png", "d/b.jpeg"]
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("x/one")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("two", "de")
    assert {r["name"]: bytes(r["content"]) for r in files.read_archives(spark, str(tmp_path)).collect()} == {"x/one": b"abc", "two": b"de"}


@pytest.mark.parametrize("kind,distance", [("float", "normalized"), ("uint8", "euclidean"), ("binary", "hamming")])
def test_datasets(spark, tmp_path, kind, distance):
    x = np.random.default_rng(1).standard_normal((60, 8))
    v = vectors(spark, x)
    path = str(tmp_path / "d")
    datasets.write_dataset(spark, path, "d-8", v.filter("vec_id >= 20"), v.filter("vec_id < 10"), distance, kind, 5, v.filter("vec_id between 10 and 19") if kind == "float" else None)
    train, test, read = datasets.read_dataset(spark, path)
    assert (train.count(), test.count(), read) == (40, 10, distance) and datasets.row_range(train, 25, 5).count() == 5
    truth = {(r["qid"], r["rank"], r["vec_id"]) for r in spark.read.parquet(f"{path}/neighbours").collect()}
    assert truth == {(r["qid"], r["rank"], r["vec_id"]) for r in knn(test.withColumnRenamed("vec_id", "qid"), train, distance, 5).collect()}
    learn, near = datasets.read_learn(spark, path)
    assert (learn is None) == (kind != "float") and (near is None or near.count() == 50)
    with pytest.raises(ValueError):
        datasets.write_dataset(spark, path, "d", v, v, "manhattan")


def test_results_replace_their_own_run(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.createDataFrame([("d", 10, "a", "x", 1), ("d", 10, "a", "y", 2)], "dataset string, k int, algorithm string, run string, qid bigint")
    datasets.write_results(rows, path)
    datasets.write_results(rows.filter("run = 'x'").withColumn("qid", F.lit(7).cast("bigint")), path)
    assert {(r["run"], r["qid"]) for r in datasets.read_results(spark, path, "d", 10).collect()} == {("x", 7), ("y", 2)}
    once = str(tmp_path / "once")
    datasets.write_once(rows, once)
    datasets.write_once(rows.limit(0), once)
    assert spark.read.parquet(once).count() == 2


def test_text_dataset(spark):
    docs = spark.createDataFrame([(i, f"text {i % 30} words") for i in range(60)] + [(99, None)], "doc_id bigint, text string")
    train, test = datasets.text_dataset(docs, datasets.hashing_encoder, 5)
    assert train.count() == 25 and test.count() == 5 and len(test.first()["embedding"]) == 64


def test_unreadable_results_are_reported(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([("d", 10, "a", "r1", 1, 0.5)], "dataset string, k int, algorithm string, run string, qid bigint, time double")
    datasets.write_results(rows, path)
    (tmp_path / "results" / "dataset=d" / "k=10" / "algorithm=a" / "run=r2").mkdir()
    (tmp_path / "results" / "dataset=d" / "k=10" / "algorithm=a" / "run=r2" / "broken.parquet").write_bytes(b"PAR1 no table")
    assert datasets.read_results(spark, path, "d", 10).count() == 1
    bad = datasets.unreadable(spark, path).collect()
    assert len(bad) == 1 and bad[0]["path"].endswith("broken.parquet") and bad[0]["reason"]
