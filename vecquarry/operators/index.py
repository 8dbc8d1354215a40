"""Approximate nearest-neighbour indexes as DataFrame operations, in eight families under one contract.

Flat, inverted lists, product and scalar quantization, sign bits, hashing, projection trees, neighbour graphs and low
rank. What an index learns (centroids, codebooks, directions) is of bounded size and fitted on a bounded sample, `sample`
rows drawn by a hash of vec_id; every row is indexed. Rows meet queries by equi-joins on buckets, of which large ones are
split, so that a task holds a bounded piece; candidates of all buckets are merged by (distance, vec_id).
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecquarry.functions import beams
from vecquarry.functions.kernels import distances, matrix, nearest_of, prepare, top_k
from vecquarry.operators.knn import DIGITS, knn, ranked, recall_ids, rescore
from vecquarry.session import materialize

SAMPLE = 20_000
#: Rows of a bucket that one task takes; larger buckets are split.
PIECE = 50_000
#: Queries of a bucket that one task takes.
ASKS = 2_000
#: Rows of a shard of neighbour graphs.
SHARD = 20_000
#: Bytes of learnt arrays that may be sent to every task.
MODEL_BYTES = 256 << 20


def _sample(corpus: DataFrame, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rows = corpus.filter("embedding IS NOT NULL").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(n).select("vec_id", "embedding").collect()  # at most n rows
    return np.array([r[0] for r in rows], np.int64), matrix([r[1] for r in rows])


def _checked(*arrays: np.ndarray) -> None:
    size = sum(a.nbytes for a in arrays)
    if size > MODEL_BYTES:
        raise ValueError(f"the index would send {size >> 20} MB to every task; use fewer or smaller parts")


def kmeans(x: np.ndarray, k: int, steps: int = 10, seed: int = 1) -> np.ndarray:
    """Centroids of x by Lloyd's steps from a random start; an empty cell takes a random row."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(steps):
        near = np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
    return c


def add_column(df: DataFrame, name: str, kind: T.DataType, make: Callable[[np.ndarray], np.ndarray | list], keep: list[str]) -> DataFrame:
    """keep and a column made from blocks of embeddings by an Arrow pass; rows without an embedding are left out."""
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(name, kind)])
    arrow = {"bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}[kind.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column("embedding").flatten()).reshape(b.num_rows, -1)
            made = make(x)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(list(made) if np.ndim(made) > 1 else made, arrow)], names=[*keep, name])

    return df.select(*dict.fromkeys([*keep, "embedding"])).filter("embedding IS NOT NULL").mapInArrow(run, schema)


def bucket_search(queries: DataFrame, corpus: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, payload: str = "embedding") -> DataFrame:
    """(qid, vec_id, distance) of the k best per query and piece of a bucket, of queries (bucket, qid, embedding) and
    corpus (bucket, vec_id, payload) rows in the same bucket. Buckets of more than PIECE rows are split by a hash of
    vec_id and those of more than ASKS queries by one of qid; each piece meets each block of queries, in tiles."""
    pieces = corpus.groupBy("bucket").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    pieces = pieces.join(queries.groupBy("bucket").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("blocks")), "bucket")
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n).cast("bigint")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = corpus.join(pieces, "bucket").select("bucket", part("vec_id", "pieces").alias("piece"), every("blocks").alias("block"), "vec_id", F.col(payload).alias("payload"))
    left = queries.join(pieces, "bucket").select(F.col("bucket").alias("qb"), every("pieces").alias("qp"), part("qid", "blocks").alias("qk"), "qid", "embedding")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"qid": [], "vec_id": [], "distance": []})
        ids, x, y = b["vec_id"].to_numpy(), matrix(a["embedding"]), matrix(b["payload"])
        cols, near = nearest_of(len(x), ids, k, DIGITS, lambda some: score(x, y[some]))
        return pd.DataFrame({"qid": np.repeat(a["qid"].to_numpy(), cols.shape[1]), "vec_id": ids[cols].ravel(), "distance": near.ravel()})

    found = left.groupBy("qb", "qp", "qk").cogroup(right.groupBy("bucket", "piece", "block")).applyInPandas(search, "qid bigint, vec_id bigint, distance double")
    return found.groupBy("qid", "vec_id").agg(F.min("distance").alias("distance"))


@dataclass
class Index:
    """The contract: fit (or fit_ood) once, set_query_arguments and query as often as wanted."""

    metric: str = "euclidean"
    seed: int = 1
    sample: int = SAMPLE
    arguments: dict = field(default_factory=dict)
    #: Metrics the family can serve.
    METRICS = ("euclidean", "cosine", "normalized", "ip")

    def __post_init__(self) -> None:
        if self.metric not in self.METRICS:
            raise ValueError(f"{type(self).__name__} has no metric {self.metric}")

    def fit(self, corpus: DataFrame) -> "Index":
        """corpus: (vec_id, embedding)."""
        raise NotImplementedError

    def fit_ood(self, corpus: DataFrame, learn: DataFrame, learn_neighbours: DataFrame) -> "Index":
        """Also given a sample of queries (qid, embedding) and their neighbours (qid, rank, vec_id); most indexes learn nothing from it."""
        return self.fit(corpus)

    def set_query_arguments(self, **arguments) -> "Index":
        self.arguments = arguments
        return self

    def query(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, rank, vec_id, distance) for queries (qid, embedding)."""
        raise NotImplementedError

    def __getstate__(self) -> dict:
        """What tasks get: learnt arrays, but no tables."""
        return {k: v for k, v in self.__dict__.items() if not isinstance(v, (DataFrame, Index))}

    def additional(self) -> dict[str, float]:
        """Facts about the last query, such as the number of distances computed."""
        return {}

    def _score(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return distances(prepare(q, self.metric), prepare(x, self.metric), self.metric)

    def _space(self, x: np.ndarray) -> np.ndarray:
        """Where Euclidean structure stands for the metric: unit length under cosine, single bits under hamming."""
        if self.metric == "hamming":
            return np.unpackbits(x.astype(np.uint8), axis=1).astype(np.float64)
        x = x.astype(np.float64)
        if self.metric in ("cosine", "normalized"):
            return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-12)[:, None]
        return x

    def __str__(self) -> str:
        return f"{type(self).__name__}({self.metric}, {', '.join(f'{k}={v}' for k, v in self.arguments.items())})"


def tuned(index: Index, corpus: DataFrame, k: int, arguments: Iterable[dict], target: float = 0.93, asks: int = 200, fitted: Index | None = None) -> Index:
    """The fitted index with the first of the query arguments (in order of effort) at which `asks` rows of the corpus,
    drawn by a hash of vec_id, find at least the target share of their exact neighbours; with the last if none does."""
    if fitted is not None:
        index.__dict__.update({n: v for n, v in fitted.__dict__.items() if n != "arguments"})
    sample = materialize(corpus.filter("embedding IS NOT NULL").orderBy(F.xxhash64("vec_id", F.lit(index.seed)), "vec_id").limit(asks).select(F.col("vec_id").alias("qid"), "embedding"))
    truth = materialize(knn(sample, corpus, index.metric, k))
    for a in arguments:
        if recall_ids(index.set_query_arguments(**a).query(sample, k), truth, k).agg(F.avg("recall")).first()[0] >= target:
            break
    return index


@dataclass
class Flat(Index):
    METRICS = ("euclidean", "cosine", "normalized", "ip", "hamming")

    def fit(self, corpus: DataFrame) -> "Flat":
        self.corpus = corpus.select("vec_id", "embedding")
        return self

    def query(self, queries: DataFrame, k: int) -> DataFrame:
        return knn(queries, self.corpus, self.metric, k)


@dataclass
class ScalarCodes:
    """8-bit codes per dimension between the bounds of a sample; bits below 8 give coarser ones, after a random rotation if asked for."""

    bits: int = 8
    rotate: bool = False
    seed: int = 1

    def fit(self, x: np.ndarray) -> "ScalarCodes":
        if self.bits not in (1, 2, 3, 4, 8):
            raise ValueError("bits must be 1, 2, 3, 4 or 8")
        self.turn = np.linalg.qr(np.random.default_rng(self.seed).standard_normal((x.shape[1],) * 2))[0] if self.rotate else None
        y = x @ self.turn if self.rotate else x
        self.low, high = y.min(axis=0), y.max(axis=0)
        self.step = np.where(high > self.low, (high - self.low) / ((1 << self.bits) - 1), 1.0)
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.turn if self.rotate else x
        return np.clip(np.rint((y - self.low) / self.step), 0, (1 << self.bits) - 1).astype(np.int32)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        y = self.low + codes * self.step
        return y @ self.turn.T if self.rotate else y


@dataclass
class ProductCodes:
    """One of `words` codewords in each of `parts` sub-spaces (or of sub-spaces of `block` dimensions each); words are
    k-means centroids of a sample, after a random rotation if asked for. threshold, a cosine: errors along the vector,
    which change its large inner products, weigh (d - 1) t^2 / (1 - t^2) times as much as those across it."""

    parts: int = 8
    words: int = 16
    rotate: bool = False
    seed: int = 1
    block: int = 0
    threshold: float = 0.0

    def fit(self, x: np.ndarray) -> "ProductCodes":
        self.turn = np.linalg.qr(np.random.default_rng(self.seed).standard_normal((x.shape[1],) * 2))[0] if self.rotate else None
        y = x @ self.turn if self.rotate else x
        parts = -(-x.shape[1] // self.block) if self.block else self.parts
        self.cuts = np.array_split(np.arange(x.shape[1]), min(parts, x.shape[1]))
        self.books = [kmeans(y[:, c], self.words, seed=self.seed) for c in self.cuts]
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.turn if self.rotate else x
        codes = np.stack([np.argmin((b * b).sum(axis=1) - 2 * y[:, c] @ b.T, axis=1) for c, b in zip(self.cuts, self.books)], axis=1).astype(np.int32)
        return self._along(y, codes) if self.threshold else codes

    def _along(self, y: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Codes of the least weighted error, sub-space by sub-space with the others held, twice round."""
        t = self.threshold**2
        weight = max(0.0, (y.shape[1] - 1) * t / (1 - t) - 1)
        unit = y / np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), 1e-12)
        along = sum(((y[:, c] - b[codes[:, i]]) * unit[:, c]).sum(axis=1) for i, (c, b) in enumerate(zip(self.cuts, self.books)))
        for _ in range(2):
            for i, (c, b) in enumerate(zip(self.cuts, self.books)):
                rest = along - ((y[:, c] - b[codes[:, i]]) * unit[:, c]).sum(axis=1)
                own = (y[:, c] * unit[:, c]).sum(axis=1)[:, None] - unit[:, c] @ b.T
                cost = (b * b).sum(axis=1) - 2 * y[:, c] @ b.T + weight * (rest[:, None] + own) ** 2
                codes[:, i] = np.argmin(cost, axis=1)
                along = rest + np.take_along_axis(own, codes[:, i : i + 1].astype(int), 1)[:, 0]
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        y = np.empty((len(codes), sum(map(len, self.cuts))))
        for i, (c, b) in enumerate(zip(self.cuts, self.books)):
            y[:, c] = b[codes[:, i].astype(int)]
        return y @ self.turn.T if self.rotate else y


@dataclass
class AxisCodes:
    """Components along the first `rank` principal axes of a sample."""

    rank: int = 16

    def fit(self, x: np.ndarray) -> "AxisCodes":
        if self.rank > x.shape[1]:
            raise ValueError("rank is above the dimension")
        self.axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, : self.rank]
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        return x @ self.axes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return codes @ self.axes.T


@dataclass
class SignCodes:
    """Signs of the randomly rotated vector about the sample's mean, with its length and what the signs keep of it."""

    seed: int = 1

    def fit(self, x: np.ndarray) -> "SignCodes":
        self.turn = np.linalg.qr(np.random.default_rng(self.seed).standard_normal((x.shape[1],) * 2))[0]
        self.mean = x.mean(axis=0)
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        y = (x - self.mean) @ self.turn
        return np.concatenate([(y > 0).astype(float), np.abs(y).sum(axis=1, keepdims=True), (y * y).sum(axis=1, keepdims=True)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        signs = np.where(codes[:, :-2] > 0.5, 1.0, -1.0)
        # along the signs, scaled so that the inner product with the vector itself is kept
        return (signs * (codes[:, -1:] / np.maximum(codes[:, -2:-1], 1e-300))) @ self.turn.T + self.mean


@dataclass
class IVF(Index):
    """Inverted lists around centroids, scanned exactly or by codes with a re-ranking of k_factor * k candidates.

    Query arguments: n_probe lists a query; k_factor (0: none). seeded centroids: pass their vec_ids as `centroid_ids`."""

    n_list: int = 16
    codes: ScalarCodes | ProductCodes | SignCodes | AxisCodes | None = None
    centroid_ids: list[int] | None = None
    METRICS = ("euclidean", "cosine", "normalized", "ip", "hamming")

    def fit(self, corpus: DataFrame) -> "IVF":
        self.corpus = corpus.select("vec_id", "embedding").filter("embedding IS NOT NULL")
        if self.centroid_ids is not None:
            rows = self.corpus.filter(F.col("vec_id").isin(self.centroid_ids)).orderBy("vec_id").collect()  # the ids given
            self.centroids = matrix([r["embedding"] for r in rows])
        else:
            _, x = _sample(self.corpus, self.sample, self.seed)
            self.centroids = kmeans(self._space(x), self.n_list, seed=self.seed)
            if self.metric == "hamming":  # the bits that most rows of a cell have
                self.centroids = np.packbits(self.centroids > 0.5, axis=1).astype(np.float64)
        _checked(self.centroids)
        rows = add_column(self.corpus, "bucket", T.LongType(), lambda x: self._near(x, 1)[:, 0], ["vec_id", "embedding"])
        if self.codes is not None:
            self.codes.fit(self._space(_sample(self.corpus, self.sample, self.seed)[1]))
            rows = add_column(rows, "code", T.ArrayType(T.DoubleType()), lambda x: self.codes.encode(self._space(x)).astype(float), ["vec_id", "bucket"])
        self.lists = materialize(rows)
        return self

    def _near(self, x: np.ndarray, n: int) -> np.ndarray:
        d = np.round(self._score(x.astype(np.float64), self.centroids), DIGITS)
        return top_k(d, np.arange(len(self.centroids)), n)[0].astype(np.int64)

    def probes(self, queries: DataFrame, n: int) -> DataFrame:
        """(qid, bucket, embedding): the n nearest lists of each query."""
        some = add_column(queries, "buckets", T.ArrayType(T.LongType()), lambda x: self._near(x, n), ["qid", "embedding"])
        return some.select("qid", "embedding", F.explode("buckets").alias("bucket"))

    def query(self, queries: DataFrame, k: int) -> DataFrame:
        probes = self.probes(queries, self.arguments.get("n_probe", 1))
        if self.codes is None:
            return ranked(bucket_search(probes, self.lists, self._score, k), k)
        factor = self.arguments.get("k_factor", 2)
        score = lambda q, c: self._score(q, self.codes.decode(c))
        near = ranked(bucket_search(probes, self.lists, score, max(1, factor) * k, "code"), max(1, factor) * k)
        return near if not factor else rescore(near, queries, self.corpus, self.metric, k)

    def distance_computations(self, queries: DataFrame) -> DataFrame:
        """(qid, dist_comps): rows of the lists probed and all centroids."""
        sizes = self.lists.groupBy("bucket").agg(F.count("*").alias("n"))
        per = self.probes(queries, self.arguments.get("n_probe", 1)).select("qid", "bucket").join(sizes, "bucket", "left")
        return per.groupBy("qid").agg((F.sum(F.coalesce("n", F.lit(0))) + len(self.centroids)).alias("dist_comps"))


@dataclass
class Hashing(Index):
    """`tables` hash tables of `bits` signs of random projections. Query arguments: probes, the buckets a table looks up,
    in order of how near the query is to the planes that part it from them; or recall, for which the least number of
    probes is chosen that reaches it on a sample of rows."""

    tables: int = 8
    bits: int = 8
    METRICS = ("euclidean", "cosine", "normalized", "ip")

    def fit(self, corpus: DataFrame) -> "Hashing":
        self.corpus = corpus.select("vec_id", "embedding").filter("embedding IS NOT NULL")
        _, x = _sample(self.corpus, self.sample, self.seed)
        self.center = self._space(x).mean(axis=0) if self.metric in ("euclidean", "ip") else np.zeros(x.shape[1])
        self.planes = np.random.default_rng(self.seed).standard_normal((x.shape[1], self.tables * self.bits))
        buckets = add_column(self.corpus, "buckets", T.ArrayType(T.LongType()), lambda x: self._codes(x)[0], ["vec_id", "embedding"])
        self.lists = materialize(buckets.select("vec_id", "embedding", F.explode("buckets").alias("bucket")))
        return self

    def _codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = ((self._space(x) - self.center) @ self.planes).reshape(len(x), self.tables, self.bits)
        codes = (p > 0) @ (1 << np.arange(self.bits)) + (np.arange(self.tables) << self.bits)
        return codes.astype(np.int64), p

    def _probe(self, x: np.ndarray, n: int) -> list[np.ndarray]:
        codes, p = self._codes(x)
        n, flips = min(n, 1 << self.bits), []
        for size in range(self.bits + 1):  # sets of planes, the small ones first, until there are enough
            if len(flips) < n or size <= 2:
                flips += [sum(1 << i for i in c) for c in combinations(range(self.bits), size)]
        cost = np.stack([np.where((np.array([f >> i & 1 for i in range(self.bits)]) > 0), np.abs(p), 0).sum(axis=2) for f in flips], axis=2)
        best = np.argsort(cost, axis=2, kind="stable")[:, :, :n]
        return list((codes[:, :, None] ^ np.array(flips)[best]).reshape(len(x), -1))

    def query(self, queries: DataFrame, k: int) -> DataFrame:
        if "recall" in self.arguments:
            target, steps = self.arguments["recall"], [{"probes": 1 << i} for i in range(self.bits + 1)]
            self.arguments = {"recall": target, "probes": tuned(replace(self), self.corpus, k, steps, target, fitted=self).arguments["probes"]} if "probes" not in self.arguments else self.arguments
        n = self.arguments.get("probes", 1)
        some = add_column(queries, "buckets", T.ArrayType(T.LongType()), lambda x: np.stack(self._probe(x, n)), ["qid", "embedding"])
        return ranked(bucket_search(some.select("qid", "embedding", F.explode("buckets").alias("bucket")), self.lists, self._score, k), k)


@dataclass
class Trees(Index):
    """Random projection trees: one random direction a level, split at the sample's medians. Rows that share a leaf with
    the query in at least `votes` trees are ranked exactly; given a target_recall, the votes are the most that reach it on a
    sample of rows. With fit_ood and supervised, a leaf votes for the neighbours
    of the learn queries in it instead of its own rows."""

    trees: int = 8
    depth: int = 5
    supervised: bool = False
    METRICS = ("euclidean", "cosine", "normalized", "ip", "hamming")

    def _learn(self, corpus: DataFrame) -> None:
        self.corpus = corpus.select("vec_id", "embedding").filter("embedding IS NOT NULL")
        _, x = _sample(self.corpus, self.sample, self.seed)
        x = self._space(x)
        rng = np.random.default_rng(self.seed)
        self.directions = rng.standard_normal((self.trees, x.shape[1], self.depth))
        self.splits = np.zeros((self.trees, (1 << self.depth) - 1))
        for t in range(self.trees):
            p, node = x @ self.directions[t], np.zeros(len(x), np.int64)
            for level in range(self.depth):
                for v in range((1 << level) - 1, (1 << (level + 1)) - 1):
                    here = p[node == v, level]
                    self.splits[t, v] = np.median(here) if len(here) else 0.0
                node = 2 * node + 1 + (p[:, level] > self.splits[t, node])
        _checked(self.directions, self.splits)

    def _leaves(self, x: np.ndarray) -> np.ndarray:
        x, out = self._space(x), []
        for t in range(self.trees):
            p, node = x @ self.directions[t], np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2 * node + 1 + (p[:, level] > self.splits[t, node])
            out.append((t << (self.depth + 1)) + node)
        return np.stack(out, axis=1)

    def _at(self, df: DataFrame, key: str) -> DataFrame:
        leaves = add_column(df, "buckets", T.ArrayType(T.LongType()), self._leaves, [key])
        return leaves.select(key, F.explode("buckets").alias("bucket"))

    def fit(self, corpus: DataFrame) -> "Trees":
        if self.supervised:
            raise ValueError("a supervised index needs fit_ood")
        self._learn(corpus)
        self.lists = materialize(self._at(self.corpus, "vec_id").withColumn("n", F.lit(1).cast("bigint")))
        return self

    def fit_ood(self, corpus: DataFrame, learn: DataFrame, learn_neighbours: DataFrame) -> "Trees":
        if not self.supervised:
            return self.fit(corpus)
        self._learn(corpus)
        at = self._at(learn, "qid").join(learn_neighbours.select("qid", "vec_id"), "qid")
        self.lists = materialize(at.groupBy("bucket", "vec_id").agg(F.count("*").alias("n")))
        return self

    def query(self, queries: DataFrame, k: int) -> DataFrame:
        if "target_recall" in self.arguments and "votes" not in self.arguments:
            sample = materialize(self.corpus.orderBy(F.xxhash64("vec_id", F.lit(self.seed)), "vec_id").limit(200).select(F.col("vec_id").alias("qid"), "embedding"))
            votes = self.autotune(sample, knn(sample, self.corpus, self.metric, k), k, self.arguments["target_recall"])
            self.arguments = self.arguments | {"votes": votes}
        votes = self._at(queries, "qid").join(self.lists, "bucket").groupBy("qid", "vec_id").agg(F.sum("n").alias("votes"))
        return rescore(votes.filter(F.col("votes") >= self.arguments.get("votes", 1)), queries, self.corpus, self.metric, k)

    def autotune(self, queries: DataFrame, truth: DataFrame, k: int, target: float) -> int:
        """The largest number of votes at which the mean recall on the given queries reaches the target (1 if none does)."""
        votes = self._at(queries, "qid").join(self.lists, "bucket").groupBy("qid", "vec_id").agg(F.sum("n").alias("votes"))
        hits = truth.filter(F.col("rank") <= k).join(votes, ["qid", "vec_id"]).groupBy("votes").count().collect()  # at most `trees` rows
        total, best = truth.filter(F.col("rank") <= k).count(), 1
        for v in range(1, self.trees + 1):
            if sum(r["count"] for r in hits if r["votes"] >= v) >= target * total:
                best = v
        return best


def knn_graph(corpus: DataFrame, k: int, metric: str, index: Index | None = None) -> DataFrame:
    """(src, rank, dst, distance): the k nearest of every row, itself excepted; exact, or as found by a fitted index."""
    queries = corpus.select(F.col("vec_id").alias("qid"), "embedding")
    found = index.query(queries, k + 1) if index else knn(queries, corpus, metric, k + 1)
    return _as_edges(found.filter("qid <> vec_id"), k)


def _as_edges(pairs: DataFrame, k: int) -> DataFrame:
    return ranked(pairs.select("qid", "vec_id", "distance"), k).select(F.col("qid").alias("src"), "rank", F.col("vec_id").alias("dst"), "distance")


#: Of a row with many reverse partners, the rows of which one task pairs at once.
HUB = 64
#: Descent ends when a step changes at most this share of the edges.
CHANGED_LEAST = 0.001


def nn_descent(corpus: DataFrame, k: int, metric: str, steps: int = 1, seed: int = 1) -> DataFrame:
    """(src, rank, dst, distance): neighbours of neighbours, in either direction, are tried and the best kept, step by
    step from those found within shards in the same way, at least `steps` times and on until a step changes few edges. Lists of 2.5 * k rows are kept on
    the way and cut to k at the end, as lists of k rows get stuck. All reverse partners take part; the partners of a hub
    are split into blocks whose pairs are made in tasks of their own."""
    width = -(-5 * k // 2)
    rows = materialize(corpus.select("vec_id", "embedding").filter("embedding IS NOT NULL"))
    queries = rows.select(F.col("vec_id").alias("qid"), "embedding")
    n = max(1, rows.count())
    # the start: descent in memory within shards of rows that a hash puts together, which the steps below then join up
    shards = max(1, -(-n // SHARD))

    def within(g: pd.DataFrame) -> pd.DataFrame:
        ids, x = g["vec_id"].to_numpy(), prepare(matrix(g["embedding"]), metric)
        near, far = beams.descend(x, width, metric, seed)
        row, place = np.nonzero(near >= 0)
        return pd.DataFrame({"qid": ids[row], "vec_id": ids[near[row, place]], "distance": np.round(far[row, place], DIGITS)})

    shard = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(shards)).cast("int")
    start = rows.withColumn("shard", shard).groupBy("shard").applyInPandas(within, "qid bigint, vec_id bigint, distance double")
    edges = materialize(_as_edges(start, width))
    step = 0
    while True:
        forth = edges.select("src", "dst")
        around = forth.unionByName(forth.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        blocks = around.groupBy("src").agg(F.ceil(F.count("*") / HUB).cast("int").alias("blocks"))
        split = around.join(blocks, "src").withColumn("block", F.pmod(F.xxhash64("dst"), F.col("blocks").cast("bigint")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        left = split.select(F.col("src").alias("mid"), "block", every.alias("against"), F.col("dst").alias("qid"))
        right = split.select(F.col("src").alias("mid"), F.col("block").alias("against"), every.alias("block"), F.col("dst").alias("vec_id"))
        two = left.join(right, ["mid", "block", "against"]).filter("qid <> vec_id")
        pairs = two.select("qid", "vec_id").unionByName(forth.select(F.col("src").alias("qid"), F.col("dst").alias("vec_id"))).distinct()
        better = materialize(_as_edges(rescore(pairs, queries, rows, metric, width), width))
        changed = better.join(edges, ["src", "dst"], "left_anti").count()
        edges, step = better, step + 1
        if step >= steps and changed <= CHANGED_LEAST * n * width:
            return edges.filter(F.col("rank") <= k)


def prune(edges: DataFrame, corpus: DataFrame, degree: int, metric: str, alpha: float = 1.0) -> DataFrame:
    """(src, rank, dst, distance): of each row's edges, nearest first, one is kept unless a kept one is nearer to its end
    by the factor alpha; at most `degree`."""
    ends = edges.join(corpus.select(F.col("vec_id").alias("dst"), "embedding"), "dst")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["distance", "dst"])
        x = prepare(matrix(g["embedding"]), metric)
        d, kept = distances(x, x, metric), []
        for i in range(len(g)):
            if len(kept) == degree:
                break
            if not kept or (alpha * d[i, kept] > g["distance"].iloc[i]).all():
                kept.append(i)
        g = g.iloc[kept]
        return pd.DataFrame({"src": g["src"], "rank": np.arange(1, len(g) + 1, dtype=np.int32), "dst": g["dst"], "distance": g["distance"]})

    return ends.select("src", "dst", "distance", "embedding").groupBy("src").applyInPandas(run, "src bigint, rank int, dst bigint, distance double")


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


@dataclass
class Graph(Index):
    """Pruned neighbour graphs, one for each shard of the rows, searched by beams.

    The rows are cut by a hash of vec_id into shards of about SHARD rows. A task builds the graph of a shard, exactly in
    tiles or (descent) from neighbours of neighbours, prunes it, and writes it as one row. A query meets all shards, in
    each of which all queries of a block move along at once from `entries` rows until no beam changes; the best of all
    shards are merged. Work and memory of a task do not grow with the rows.

    candidates: neighbours of a row among which pruning chooses, if more than the degree.
    With fit_ood and bipartite, edges also join rows of a shard that are neighbours of one learn query. codes: scores on
    the way by codes, with exact ones at the end. Query arguments: beam, steps (none: until no beam changes)."""

    degree: int = 16
    alpha: float = 1.0
    entries: int = 64
    descent: int = 0
    candidates: int = 0
    bipartite: bool = False
    codes: ScalarCodes | ProductCodes | SignCodes | AxisCodes | None = None
    shard: int = SHARD
    METRICS = ("euclidean", "cosine", "normalized", "ip", "hamming")

    def _build(self, corpus: DataFrame, extra: DataFrame | None = None) -> "Graph":
        self.corpus = corpus.select("vec_id", "embedding").filter("embedding IS NOT NULL")
        self.shards = max(1, -(-self.corpus.count() // self.shard))
        if self.codes is not None:
            self.codes.fit(self._space(_sample(self.corpus, self.sample, self.seed)[1]))
        part = lambda c: F.pmod(F.xxhash64(c), F.lit(self.shards)).cast("int")

        def graph(rows: pd.DataFrame, pairs: pd.DataFrame | None = None) -> pd.DataFrame:
            if not len(rows):
                return pd.DataFrame({"shard": [], "graph": []})
            rows = rows.sort_values("vec_id").drop_duplicates("vec_id")
            ids, raw = rows["vec_id"].to_numpy(), matrix(rows["embedding"])
            x = prepare(raw, self.metric)
            near, far = beams.neighbour_lists(x, max(self.degree, self.candidates), self.metric, self.descent > 0, self.seed)
            if pairs is not None and len(pairs):
                a, b = np.searchsorted(ids, pairs["src"].to_numpy()), np.searchsorted(ids, pairs["dst"].to_numpy())
                row, place = np.nonzero(near >= 0)
                row, col = np.concatenate([row, a]), np.concatenate([near[near >= 0], b])
                near, far = beams.best_of(row, col, beams.pair_distances(x[row], x[col], self.metric), len(ids), 5 * self.degree)
            kept = beams.prune_lists(x, near, far, self.degree, self.metric, self.alpha)
            begin, targets = beams.adjacency(np.nonzero(kept)[0], near[kept], len(ids))
            starts = np.random.default_rng(self.seed).choice(len(ids), min(self.entries, len(ids)), replace=False)
            return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "graph": [_packed(ids=ids, raw=raw, begin=begin, targets=targets, starts=np.sort(starts))]})

        rows = self.corpus.withColumn("shard", part("vec_id"))
        if extra is None:
            built = rows.groupBy("shard").applyInPandas(lambda r: graph(r), "shard int, graph binary")
        else:
            inner = extra.withColumn("pair_shard", part("src")).filter(F.col("pair_shard") == part("dst"))
            built = rows.groupBy("shard").cogroup(inner.groupBy("pair_shard")).applyInPandas(lambda r, p: graph(r, p), "shard int, graph binary")
        self.graphs = materialize(built)
        return self

    def fit(self, corpus: DataFrame) -> "Graph":
        if self.bipartite:
            raise ValueError("a bipartite graph needs fit_ood")
        return self._build(corpus)

    def fit_ood(self, corpus: DataFrame, learn: DataFrame, learn_neighbours: DataFrame) -> "Graph":
        if not self.bipartite:
            return self._build(corpus)
        near = learn_neighbours.filter(F.col("rank") <= self.degree)
        pivot = near.filter("rank = 1").select("qid", F.col("vec_id").alias("src"))  # a learn query's nearest row takes its others
        return self._build(corpus, pivot.join(near, "qid").filter("src <> vec_id").select("src", F.col("vec_id").alias("dst")).distinct())

    def _search(self, queries: DataFrame, k: int, block: int = 1000) -> DataFrame:
        """(qid, vec_id, distance, computed) of the k best of each query in each shard."""
        q = queries.select("qid", "embedding").filter("embedding IS NOT NULL")
        blocks = max(1, -(-q.count() // block))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = q.select("qid", "embedding", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("b"), every(self.shards).alias("s"))
        right = self.graphs.select(F.col("shard").alias("rs"), "graph", every(blocks).alias("rb"))
        width, steps = max(k, self.arguments.get("beam", 2 * k)), self.arguments.get("steps")

        def search(a: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(g):
                return pd.DataFrame({"qid": [], "vec_id": [], "distance": [], "computed": []})
            held = np.load(io.BytesIO(g["graph"].iloc[0]))
            raw, ids = held["raw"], held["ids"]
            x, asked = prepare(raw, self.metric), prepare(matrix(a["embedding"]), self.metric)
            scored = x if self.codes is None else prepare(self.codes.decode(self.codes.encode(self._space(raw))), self.metric)
            out = []
            for at in range(0, len(a), 128):
                some = asked[at : at + 128]
                beam, _, computed = beams.beam_search(some, scored, held["begin"], held["targets"], held["starts"], width, self.metric, steps)
                row, place = np.nonzero(beam >= 0)
                col = beam[row, place]
                d = np.round(beams.pair_distances(some[row], x[col], self.metric), DIGITS)
                by = np.lexsort((ids[col], d, row))
                row, col, d = row[by], col[by], d[by]
                first = np.arange(len(row)) - np.searchsorted(row, row) < k
                out.append(pd.DataFrame({"qid": a["qid"].to_numpy()[at + row[first]], "vec_id": ids[col[first]], "distance": d[first], "computed": computed[row[first]]}))
            return pd.concat(out)

        return left.groupBy("b", "s").cogroup(right.groupBy("rb", "rs")).applyInPandas(search, "qid bigint, vec_id bigint, distance double, computed bigint")

    def query(self, queries: DataFrame, k: int) -> DataFrame:
        return ranked(self._search(queries, k).drop("computed"), k)

    def distance_computations(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(qid, dist_comps): distances computed on the way, in all shards."""
        shard = F.pmod(F.xxhash64("vec_id"), F.lit(self.shards))
        per = self._search(queries, k).groupBy("qid", shard.alias("s")).agg(F.first("computed").alias("n"))
        return per.groupBy("qid").agg(F.sum("n").alias("dist_comps"))


@dataclass
class LowRank(Index):
    """Inverted lists over the first `rank` principal axes of a sample (of learn queries, if there are any), with an exact
    ranking of the candidates. Query arguments: n_probe, rerank."""

    rank: int = 16
    n_list: int = 16
    METRICS = ("euclidean", "cosine", "normalized", "ip")

    def _build(self, corpus: DataFrame, axes_of: np.ndarray) -> "LowRank":
        self.corpus = corpus.select("vec_id", "embedding").filter("embedding IS NOT NULL")
        if self.rank > axes_of.shape[1]:
            raise ValueError("rank is above the dimension")
        second = self._space(axes_of)
        self.axes = np.linalg.eigh(second.T @ second)[1][:, ::-1][:, : self.rank]
        small = add_column(self.corpus, "small", T.ArrayType(T.DoubleType()), lambda x: self._space(x) @ self.axes, ["vec_id"]).select("vec_id", F.col("small").alias("embedding"))
        self.inner = IVF(metric="ip" if self.metric == "ip" else "euclidean", n_list=self.n_list, seed=self.seed, sample=self.sample).fit(materialize(small))
        return self

    def fit(self, corpus: DataFrame) -> "LowRank":
        return self._build(corpus, _sample(corpus, self.sample, self.seed)[1])

    def fit_ood(self, corpus: DataFrame, learn: DataFrame, learn_neighbours: DataFrame) -> "LowRank":
        return self._build(corpus, _sample(learn.select(F.col("qid").alias("vec_id"), "embedding"), self.sample, self.seed)[1])

    def query(self, queries: DataFrame, k: int) -> DataFrame:
        small = add_column(queries, "small", T.ArrayType(T.DoubleType()), lambda x: self._space(x) @ self.axes, ["qid"]).select("qid", F.col("small").alias("embedding"))
        near = self.inner.set_query_arguments(n_probe=self.arguments.get("n_probe", 4)).query(small, self.arguments.get("rerank", 4 * k))
        return rescore(near, queries, self.corpus, self.metric, k)
