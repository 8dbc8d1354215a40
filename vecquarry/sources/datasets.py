"""Datasets and results as Parquet tables, and the way from texts to datasets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecquarry.functions.names import METRIC_NAMES, POINT_TYPES
from vecquarry.operators import derive
from vecquarry.operators.knn import knn, mean_distance
from vecquarry.session import materialize


def write_dataset(spark: SparkSession, path: str, name: str, train: DataFrame, test: DataFrame, distance: str, kind: str = "float", count: int = 100, learn: DataFrame | None = None) -> None:
    """Quantize and normalize the parts as distance and kind ask, and write vectors (by part), attributes, ground truth
    and the neighbours of learn vectors. train, test, learn: (vec_id, embedding)."""
    if distance not in METRIC_NAMES or kind not in POINT_TYPES:
        raise ValueError(f"no distance {distance} or point type {kind}")
    parts = {"train": train, "test": test} | ({"learn": learn} if learn is not None else {})
    if kind != "float":
        parts = {p: derive.quantize(df, kind, train, distance) for p, df in parts.items()}
    elif distance == "normalized":
        parts = {p: derive.normalized(df) for p, df in parts.items()}
    parts = {p: materialize(df.select("vec_id", "embedding")) for p, df in parts.items()}
    first = True
    for part, df in parts.items():
        df.withColumn("part", F.lit(part)).write.mode("overwrite" if first else "append").partitionBy("part").parquet(f"{path}/vectors")
        first = False
    head = parts["train"].first()
    spark.createDataFrame([(name, distance, len(head["embedding"]) if head else 0, kind)], "dataset string, distance string, dimension int, point_type string").write.mode("overwrite").parquet(f"{path}/attributes")
    queries = parts["test"].select(F.col("vec_id").alias("qid"), "embedding")
    knn(queries, parts["train"], distance, count).write.mode("overwrite").parquet(f"{path}/neighbours")
    mean_distance(queries, parts["train"], distance).write.mode("overwrite").parquet(f"{path}/distances")
    if learn is not None and kind == "float":
        knn(parts["learn"].select(F.col("vec_id").alias("qid"), "embedding"), parts["train"], distance, count).select(F.col("qid").alias("learn_id"), "rank", "vec_id").write.mode("overwrite").parquet(f"{path}/learn_neighbours")


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str]:
    """(train, test, distance)"""
    vectors = spark.read.parquet(f"{path}/vectors")
    part = lambda p: vectors.filter(F.col("part") == p).select("vec_id", "embedding")
    return part("train"), part("test"), spark.read.parquet(f"{path}/attributes").first()["distance"]


def read_learn(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(learn vectors, their neighbours), or (None, None) if there are none."""
    try:
        near = spark.read.parquet(f"{path}/learn_neighbours")
    except AnalysisException:
        return None, None
    return spark.read.parquet(f"{path}/vectors").filter("part = 'learn'").select("vec_id", "embedding"), near


def row_range(vectors: DataFrame, first: int, rows: int) -> DataFrame:
    return vectors.filter((F.col("vec_id") >= first) & (F.col("vec_id") < first + rows))


def write_results(results: DataFrame, path: str) -> None:
    """Raw results into their (dataset, k, algorithm, run) folders; a run written again replaces its own folder and no
    other, and is finished only with the folder's last file."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "k", "algorithm", "run").parquet(path)


def read_results(spark: SparkSession, path: str, dataset: str | None = None, k: int | None = None) -> DataFrame:
    """Raw results of a dataset and k (by folder); files that cannot be read are passed over: see unreadable."""
    rows = spark.read.option("ignoreCorruptFiles", True).option("recursiveFileLookup", False).parquet(path)
    rows = rows if dataset is None else rows.filter(F.col("dataset") == dataset)
    return rows if k is None else rows.filter(F.col("k") == k)


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """(path, reason) of the Parquet files below path that read_results passes over, as their ends cannot be read."""
    from vecquarry.sources.files import _place

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for b in batches:
            bad = []
            for p in b.column("path").to_pylist():
                system, own = _place(p)
                try:
                    pq.read_metadata(own, filesystem=system)
                except (pa.ArrowInvalid, OSError) as e:
                    bad.append((p, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in bad], pa.string()) for i in range(2)], names=["path", "reason"])

    return found.mapInArrow(run, "path string, reason string")


def write_once(df: DataFrame, path: str) -> None:
    """Write unless there is something already."""
    df.write.mode("ignore").parquet(path)


def hashing_encoder(dimension: int = 64) -> Callable[[list[str]], np.ndarray]:
    """An encoder that needs no model: signed counts of hashed words, of length 1. It stands in for those of models."""
    import re
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % dimension] += 1 if h >> 16 & 1 else -1
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.where(length > 0, out / np.maximum(length, 1e-12), 1 / np.sqrt(dimension)).astype(np.float32)

    return encode


def encoded(texts: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], prefix: str | None = None, key: str = "doc_id") -> DataFrame:
    """(vec_id, embedding) of (key, text) by batches; encoder() makes the encoder once a task. A prefix is put before every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for b in batches:
            if b.num_rows:
                x = encode(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(list(x), pa.list_(pa.float32()))], names=["vec_id", "embedding"])

    text = F.col("text") if prefix is None else F.concat(F.lit(f"{prefix}: "), F.col("text"))
    return texts.filter("text IS NOT NULL").select(F.col(key).cast("bigint").alias("vec_id"), text.alias("text")).mapInArrow(run, "vec_id bigint, embedding array<float>")


def text_dataset(texts: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], test: int = 1000, key: str = "doc_id", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) vectors of distinct texts, `test` of which are held out."""
    parts = derive.split(derive.distinct_texts(texts.select(key, "text"), key=key), test, key, seed)
    parts = materialize(parts)
    return tuple(encoded(parts.filter(F.col("part") == p), encoder, key=key) for p in ("train", "test"))
