"""Same and almost same vectors across splits, by a compressed full-text index of the evaluation shards."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecquarry.llm.vectors import pair_cosines, unit
from vecquarry.session import materialize

#: Letters of a vector's text: signs of its products with so many fixed random directions.
LETTERS = 512
#: Matches are looked for that hold one of the windows of MATCH letters that end at every STRIDE-th letter.
MATCH, STRIDE = 24, 12


def directions(dimension: int, letters: int = LETTERS, seed: int = 7) -> np.ndarray:
    return np.random.default_rng([seed, dimension, letters]).standard_normal((dimension, letters)).astype(np.float32)


def texts(units: np.ndarray, letters: int = LETTERS) -> np.ndarray:
    """One text of letters 0 and 1 per unit vector (row)."""
    return (units.astype(np.float32) @ directions(units.shape[1], letters) > 0).astype(np.uint8)


class TextIndex:
    """A compressed full-text index of equally long texts over two letters, for matches at equal places.

    At each place the texts are ordered by what follows; the letter before the place, in that order, is the column of the
    Burrows-Wheeler transform there, held as bits with a running count per 64 of them. A backward step takes the range of
    texts that match from a place on to those that also match one letter further left, by two rank queries. The order
    itself is kept only at the places where matches are reported.
    """

    def __init__(self, rows: np.ndarray, places: list[int]):
        n, self.length = rows.shape
        self.size, words = n, n // 64 + 1
        self.bits = np.zeros((self.length + 1, words), np.uint64)
        self.counts = np.zeros((self.length + 1, words + 1), np.int32)
        self.zeros = np.zeros(self.length + 1, np.int64)
        order = np.arange(n, dtype=np.uint16 if n < 1 << 16 else np.int64)
        self.places = np.array(sorted(places), np.int64)
        self.orders = np.zeros((len(self.places), n), order.dtype)
        padded = np.zeros(words * 64, np.uint8)
        for place in range(self.length, -1, -1):
            at = np.searchsorted(self.places, place)
            if at < len(self.places) and self.places[at] == place:
                self.orders[at] = order
            if place:
                letters = rows[order, place - 1]
                padded[:n] = letters
                self.bits[place] = np.packbits(padded, bitorder="little").view(np.uint64)
                self.counts[place, 1:] = np.cumsum(np.bitwise_count(self.bits[place]))
                self.zeros[place] = n - int(letters.sum())
                order = np.concatenate([order[letters == 0], order[letters == 1]])

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, shape=np.array([self.size, self.length]), bits=self.bits, counts=self.counts, zeros=self.zeros, places=self.places, orders=self.orders)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "TextIndex":
        self, found = cls.__new__(cls), np.load(io.BytesIO(raw))
        self.size, self.length = map(int, found["shape"])
        for name in ("bits", "counts", "zeros", "places", "orders"):
            setattr(self, name, found[name])
        return self

    def _ones(self, place, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[place, word] + np.bitwise_count(self.bits[place, word] & mask)

    def step(self, place, low: np.ndarray, high: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges at place - 1 of texts that have `letter` there and lie in [low, high) at `place`, which is one place
        or one for each range."""
        a, b = self._ones(place, low), self._ones(place, high)
        one = letter == 1
        return np.where(one, self.zeros[place] + a, low - a), np.where(one, self.zeros[place] + b, high - b)

    def matches(self, queries: np.ndarray, end: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, rank) of all texts that agree with a query in the `length` letters before `end`: their ranks in the
        order at end - length."""
        q = np.arange(len(queries))
        low, high = np.zeros(len(q), np.int64), np.full(len(q), self.size, np.int64)
        for place in range(end, end - length, -1):
            low, high = self.step(place, low, high, queries[q, place - 1])
            alive = low < high
            if not alive.all():
                q, low, high = q[alive], low[alive], high[alive]
            if not len(q):
                break
        hits = high - low
        return np.repeat(q, hits), np.repeat(low, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)

    def text(self, place: int, rank: np.ndarray) -> np.ndarray:
        """The texts of those ranks in the order at one of the places that are kept."""
        return self.orders[np.searchsorted(self.places, place), rank].astype(np.int64)

    def extend_left(self, queries: np.ndarray, q: np.ndarray, place: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The place at which the match of each query with the text of that rank at that place begins."""
        begin, alive = place.copy(), np.flatnonzero(place > 0)
        place, rank = place.copy(), rank.copy()
        while len(alive):
            p, r = place[alive], rank[alive]
            letter = (self.bits[p, r >> 6] >> (r & 63).astype(np.uint64)) & np.uint64(1)
            same = letter == queries[q[alive], p - 1]
            alive, p, r = alive[same], p[same], r[same]
            rank[alive] = self.step(p, r, r + 1, queries[q[alive], p - 1])[0]
            place[alive] = begin[alive] = p - 1
            alive = alive[p > 1]
        return begin

    def extend_right(self, queries: np.ndarray, q: np.ndarray, place: np.ndarray, rank: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
        """The end, less than `most` letters behind `end`, of the match of each query with the text of that rank at that
        place: the last place from which backward search reaches it."""
        out, open_ = end.copy(), np.arange(len(q))
        for further in range(most - 1, 0, -1):
            at = open_[end[open_] + further <= self.length]
            low, high = np.zeros(len(at), np.int64), np.full(len(at), self.size, np.int64)
            now = end[at] + further
            moving = np.arange(len(at))
            while len(moving):
                low[moving], high[moving] = self.step(now[moving], low[moving], high[moving], queries[q[at[moving]], now[moving] - 1])
                now[moving] -= 1
                moving = moving[(low[moving] < high[moving]) & (now[moving] > place[at[moving]])]
            reached = (now == place[at]) & (low <= rank[at]) & (rank[at] < high)
            out[at[reached]] = end[at[reached]] + further
            open_ = np.setdiff1d(open_, at[reached], assume_unique=True)
        return out


def window_ends(length: int, match: int = MATCH, stride: int = STRIDE) -> list[int]:
    return list(range(match, length + 1, stride))


def build_index(evaluation: np.ndarray, match: int = MATCH, stride: int = STRIDE) -> TextIndex:
    return TextIndex(evaluation, [e - match for e in window_ends(evaluation.shape[1], match, stride)])


def maximal_matches(index: TextIndex, train: np.ndarray, match: int = MATCH, stride: int = STRIDE) -> tuple[np.ndarray, ...]:
    """(train row, evaluation text, begin, end) of all maximal matches that hold a window of `match` letters ending at a
    multiple of `stride`: the windows are found by backward search, windows of a pair that follow each other are merged,
    and both ends are extended through the index."""
    found = []
    for end in window_ends(train.shape[1], match, stride):
        q, rank = index.matches(train, end, match)
        found.append((q, index.text(end - match, rank), np.full(len(q), end), rank))
    q, text, end, rank = map(np.concatenate, zip(*found)) if found else [np.empty(0, np.int64)] * 4
    by = np.lexsort((end, text, q))
    q, text, end, rank = q[by], text[by], end[by], rank[by]
    follows = np.zeros(len(q), bool)
    follows[1:] = (q[1:] == q[:-1]) & (text[1:] == text[:-1]) & (end[1:] == end[:-1] + stride)
    first = np.flatnonzero(~follows)
    last = np.append(first[1:], len(q)) - 1 if len(q) else first
    begin = index.extend_left(train, q[first], end[first] - match, rank[first])
    return q[first], text[first], begin, index.extend_right(train, q[last], end[last] - match, rank[last], end[last], stride)


def overlaps(vectors: DataFrame, threshold: float = 0.995, shard: int = 32768, block: int = 32768) -> DataFrame:
    """(dataset, part, train_id, eval_id, cosine, spans, letters): all pairs of a train vector and one of another part
    of the same dataset with a cosine of at least `threshold`, with the number and total length of the maximal matches
    of their texts.

    vectors: (dataset, part, vec_id, embedding) as from vectors.usable, every embedding of a dataset being of one length.
    Rows of one vec_id count once. Null parts take no part. Empty inputs give no rows.

    Method: a vector's text is the signs of its products with 512 fixed directions. The other parts of a dataset are cut
    into shards of about `shard` rows by a hash of vec_id, and each gets one compressed full-text index. Blocks of about
    `block` train rows stream through backward search, which finds all texts that agree in one of 41 windows of 24
    letters; the windows of a pair are merged and extended to maximal matches, whose number and letters are summed.
    Cosines computed in double decide. A task holds one block and one index. Of the maximal matches those count that hold
    a window, as any of 35 letters does. A letter differs with probability angle / pi, so a pair at a cosine of 0.995 has
    no such match with a probability of about 1e-7, and pairs above it, which agree more, with a smaller one; exact
    copies are always found.
    """
    train = F.col("part") == "train"
    kept = vectors.select("dataset", "part", "vec_id", "embedding").filter(F.col("part").isNotNull())
    sizes = kept.groupBy("dataset").agg(F.count_if(train).alias("t"), F.count_if(~train).alias("e")).filter((F.col("t") > 0) & (F.col("e") > 0))
    # written, so that Spark knows its size when it picks the join
    parts = materialize(sizes.select("dataset", F.ceil(F.col("t") / block).cast("int").alias("blocks"), F.ceil(F.col("e") / shard).cast("int").alias("shards")))
    routed = kept.join(parts, "dataset")
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n).cast("bigint")).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def distinct(rows: pa.Table, ids: list[str]) -> pa.Table:
        codes = [np.unique(rows[c].to_numpy(), return_inverse=True)[1] for c in ids]
        return rows.take(pa.array(np.unique(np.stack(codes), axis=1, return_index=True)[1])) if rows.num_rows else rows

    def matrix(rows: pa.Table) -> np.ndarray:
        return np.asarray(rows["embedding"].combine_chunks().flatten()).reshape(rows.num_rows, -1)

    def index(rows: pa.Table) -> pa.Table:
        rows = distinct(rows, ["part", "vec_id"])
        x = matrix(rows)
        columns = [[rows["dataset"][0].as_py()], [rows["shard"][0].as_py()], [rows["blocks"][0].as_py()], [rows["vec_id"].to_pylist()], [rows["part"].to_pylist()], [x.tobytes()], [build_index(texts(unit(x))).to_bytes()]]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    arrow = pa.schema([("dataset", pa.string()), ("shard", pa.int32()), ("blocks", pa.int32()), ("ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.string())), ("vectors", pa.binary()), ("index", pa.binary())])
    evaluation = routed.filter(~train).select("dataset", own("shards").alias("shard"), "blocks", "part", "vec_id", "embedding")
    indexes = evaluation.groupBy("dataset", "shard").applyInArrow(index, "dataset string, shard int, blocks int, ids array<bigint>, parts array<string>, vectors binary, index binary")
    indexes = indexes.select("dataset", "shard", all_of("blocks").alias("block"), "ids", "parts", "vectors", "index")
    blocks = routed.filter(train).select("dataset", all_of("shards").alias("shard"), own("blocks").alias("block"), "vec_id", "embedding")

    def search(rows: pa.Table, shards: pa.Table) -> pa.Table:
        out = {c: np.empty(0, t) for c, t in (("train_id", np.int64), ("eval_id", np.int64), ("cosine", float), ("spans", np.int64), ("letters", np.int64))}
        part = pa.array([], pa.string())
        if rows.num_rows and shards.num_rows:
            rows = distinct(rows, ["vec_id"])
            x = unit(matrix(rows))
            ids, parts = np.asarray(shards["ids"].combine_chunks().flatten()), shards["parts"].combine_chunks().flatten()
            y = unit(np.frombuffer(shards["vectors"][0].as_py(), np.float32).reshape(len(ids), -1))
            q, text, begin, end = maximal_matches(TextIndex.from_bytes(shards["index"][0].as_py()), texts(x))
            pairs, at = np.unique(q * len(ids) + text, return_inverse=True)
            spans, letters = np.bincount(at, minlength=len(pairs)), np.bincount(at, end - begin, len(pairs)).astype(np.int64)
            i, j = pairs // len(ids), pairs % len(ids)
            cosine = pair_cosines(x, i, y, j)
            near = cosine >= threshold
            out = {"train_id": np.asarray(rows["vec_id"])[i[near]], "eval_id": ids[j[near]], "cosine": cosine[near], "spans": spans[near], "letters": letters[near]}
            part = parts.take(pa.array(j[near]))
        name = (rows if rows.num_rows else shards)["dataset"][0].as_py()
        return pa.table({"dataset": pa.array([name] * len(part), pa.string()), "part": part, **out})

    keys = ["dataset", "shard", "block"]
    schema = "dataset string, part string, train_id bigint, eval_id bigint, cosine double, spans bigint, letters bigint"
    return blocks.groupBy(*keys).cogroup(indexes.groupBy(*keys)).applyInArrow(search, schema)
