"""Deriving vector datasets: duplicates, splits, samples, normalized, quantized and reduced variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecquarry.functions import vector as V
from vecquarry.operators.ordered import positions
from vecquarry.session import materialize


def distinct_texts(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per text, that of the smallest key; null texts are left out."""
    return df.filter(F.col(text).isNotNull()).groupBy(text).agg(F.min_by(F.struct(*[c for c in df.columns if c != text]), key).alias("r")).select(text, "r.*")


def joined_text(*columns: str) -> Column:
    """Columns joined by spaces, nulls left out, without space at the ends."""
    return F.trim(F.concat_ws(" ", *columns))


def first_per(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(value, order).alias(value))


def _lot(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def draw(df: DataFrame, n: int, key: str = "vec_id", seed: int = 1) -> DataFrame:
    """Exactly n rows (or all) without replacement: the first by a hash (md5) of key and seed."""
    return positions(df, [], [_lot(key, seed).asc(), F.col(key).asc()], "__place").filter(F.col("__place") <= n).drop("__place") if n > 0 else df.limit(0)


def split(df: DataFrame, test: int, key: str = "vec_id", seed: int = 1) -> DataFrame:
    """df with part: test for exactly `test` rows drawn by a hash (md5) of key and seed, train for the others."""
    placed = positions(df, [], [_lot(key, seed).asc(), F.col(key).asc()], "__place")
    return placed.withColumn("part", F.when(F.col("__place") <= test, "test").otherwise("train")).drop("__place")


def block_sample(df: DataFrame, blocks: int, size: int, key: str = "vec_id", seed: int = 1) -> DataFrame:
    """`size` successive rows, by key, from each of `blocks` equal stretches, beginning at a random place of each."""
    n = df.count()
    placed = positions(df, [], [F.col(key).asc()], "__place").withColumn("__at", F.col("__place") - 1)
    block = F.floor(F.col("__at") * blocks / F.lit(max(n, 1)))
    first, last = F.ceil(block * n / F.lit(blocks)), F.ceil((block + 1) * n / F.lit(blocks))
    room = F.greatest(last - first - size, F.lit(0)) + 1
    start = first + F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", block.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint"), room)
    return placed.filter((F.col("__at") >= start) & (F.col("__at") < start + size)).drop("__place", "__at")


def bounds(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """One row (low, high, largest): least, greatest and greatest absolute value of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(0).flatten(), float).reshape(b.num_rows, -1)
                low, high = (x.min(axis=0), x.max(axis=0)) if low is None else (np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0)))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array([low], pa.list_(pa.float64())), pa.array([high], pa.list_(pa.float64()))], names=["low", "high"])

    # a row of each partition, of the dimension
    parts = df.select(embedding).filter(F.col(embedding).isNotNull()).mapInArrow(run, "low array<double>, high array<double>")
    at = parts.select(F.posexplode(F.arrays_zip("low", "high")).alias("j", "x"))
    per = at.groupBy("j").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    per = per.withColumn("largest", F.greatest(F.abs("low"), F.abs("high")))
    l = F.sort_array(F.collect_list(F.struct("j", "low", "high", "largest")))  # noqa: E741
    part = lambda n: F.transform("l", lambda s: s[n]).alias(n)
    return per.agg(l.alias("l")).select(*map(part, ("low", "high", "largest")))


def _with_bounds(df: DataFrame, train: DataFrame) -> DataFrame:
    return df.join(F.broadcast(bounds(train)))  # one row of three arrays of the dimension


def quantize(df: DataFrame, kind: str, train: DataFrame | None = None, distance: str = "euclidean", floating: bool = True) -> DataFrame:
    """df with the embedding in 8 bits (uint8, int8) or one bit (binary) a number, bounds being those of train alone."""
    if kind in ("uint8", "int8") and (distance not in ("euclidean", "cosine") or not floating):
        raise ValueError(f"{kind} needs floating vectors and euclidean or cosine distance")
    if kind == "binary":
        if distance != "hamming":
            raise ValueError("binary needs hamming distance")
        return compact(df.withColumn("embedding", V.pack_bits(F.col("embedding"))), kind)
    b = _with_bounds(df, train if train is not None else df)
    if kind == "uint8":
        return compact(b.withColumn("embedding", V.quantize_uint8(F.col("embedding"), F.col("low"), F.col("high"))).select(df.columns), kind)
    if kind == "int8":
        return compact(b.withColumn("embedding", V.quantize_int8(F.col("embedding"), F.col("largest"))).select(df.columns), kind)
    raise ValueError(f"unknown kind {kind}")


def point_type(train: DataFrame, test: DataFrame, embedding: str = "embedding") -> str:
    """uint8, int8 or float, by the types of both: see compact."""
    kinds = {train.schema[embedding].dataType.elementType.typeName(), test.schema[embedding].dataType.elementType.typeName()}
    return {("short",): "uint8", ("byte",): "int8"}.get(tuple(kinds), "float")


def compact(df: DataFrame, kind: str, embedding: str = "embedding") -> DataFrame:
    """df with quantized vectors in the type that holds them: bytes for int8, shorts for uint8 and packed bits, which do
    not fit a signed byte; floats for anything else."""
    number = {"int8": "tinyint", "uint8": "smallint", "binary": "smallint"}.get(kind, "float")
    return df.withColumn(embedding, F.col(embedding).cast(f"array<{number}>"))


def normalized(df: DataFrame) -> DataFrame:
    return df.withColumn("embedding", V.normalize(F.col("embedding")))


def reduced(df: DataFrame, dim: int) -> DataFrame:
    return df.withColumn("embedding", V.reduce_dimension(F.col("embedding"), dim))


def resplit(df: DataFrame, test: int, seed: int = 1) -> DataFrame:
    """An out-of-distribution dataset made into an in-distribution one: test rows come from train, which also is what is learnt from."""
    return split(df.filter(F.col("part") == "train").drop("part"), test, seed=seed)


def multi_vector_sketch(tokens: DataFrame, bits: int = 3, seed: int = 3, sum_of: bool = True) -> DataFrame:
    """(doc_id, embedding): one vector per document of many: token vectors (doc_id, tok_id, embedding) fall into
    2**bits buckets by signs along random directions, and the sums (queries) or means (documents) of the buckets are laid
    end to end, empty ones being zero."""
    import pandas as pd

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for doc, rows in f.groupby("doc_id", sort=False):
                x = np.stack(rows["embedding"].to_numpy()).astype(float)
                directions = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], bits))
                bucket = (x @ directions > 0) @ (1 << np.arange(bits))
                out = np.zeros((1 << bits, x.shape[1]))
                np.add.at(out, bucket, x)
                yield pd.DataFrame({"doc_id": [doc], "n": [np.bincount(bucket, minlength=1 << bits)], "total": [out.ravel()]})

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        n, total = np.sum(rows["n"].tolist(), axis=0), np.sum(rows["total"].tolist(), axis=0).reshape(1 << bits, -1)
        return pd.DataFrame({"doc_id": [rows["doc_id"].iloc[0]], "embedding": [(total if sum_of else total / np.maximum(n, 1)[:, None]).ravel()]})

    # a row per document and batch of tokens: a document of any number of tokens is never held whole
    kept = tokens.select("doc_id", "embedding").filter("doc_id IS NOT NULL AND embedding IS NOT NULL")
    parts = kept.mapInPandas(partial, "doc_id bigint, n array<bigint>, total array<double>")
    return parts.groupBy("doc_id").applyInPandas(together, "doc_id bigint, embedding array<double>")


def offsets(tokens: DataFrame) -> DataFrame:
    """(doc_id, count, start): where each document's token vectors begin in the flat table ordered by doc_id."""
    counts = materialize(tokens.groupBy("doc_id").agg(F.count("*").alias("count")))
    from vecquarry.operators.ordered import prefix_sums

    return prefix_sums(counts, [], [F.col("doc_id").asc()], {"__end": F.col("count")}).select("doc_id", "count", (F.col("__end") - F.col("count")).alias("start"))


def running_max(df: DataFrame, by: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.max(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
