"""The k most similar vectors for every vector, by windows along shifted space-filling curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecquarry.llm.vectors import pair_cosines, unit, usable
from vecquarry.operators.ordered import positions
from vecquarry.session import materialize, salted_join

#: Each curve runs through a grid of 2**GRID_BITS steps a side in a random projection to CURVE_DIMENSIONS.
CURVE_DIMENSIONS, GRID_BITS = 8, 6
#: Train rows before and after a row on a curve that are compared with it, and how fast the number of curves grows, in
#: a dataset of as many train rows; both grow with its size: see curves_of.
WINDOW, DENSITY = 1024, 3.4
#: Rows of a partition of a curve, on average.
CELL = 32768
#: Groups of more equal vectors than this are searched through a few of them.
COPIES = 64
#: Room for the error of cosines in single precision, so that ties are decided in double.
SLACK = 4e-6
LIST = "array<struct<c: int, id: bigint>>"


def _growth(train: Column, window: int) -> Column:
    return F.greatest(F.lit(1.0), F.pow(train / F.lit(window), F.lit(0.25)))


def window_of(train: Column, window: int = WINDOW) -> Column:
    return F.round(F.lit(window) * _growth(train, window)).cast("int")


def curves_of(train: Column, window: int = WINDOW, density: float = DENSITY) -> Column:
    """Curves for a dataset of so many train rows. A window is a smaller share of a larger dataset, so windows and the
    number of curves both grow, each with the fourth root of it, which keeps recall about level. One curve is enough
    where its windows hold every train row."""
    grown = F.round(2 + density * (_growth(train, window) - 1)).cast("int")
    return F.when(train <= window, F.lit(1)).otherwise(grown)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer grid points (rows; entries below 2**bits).

    From the most significant bit on, coordinates are reflected or swapped with the first one so that each sub-cube is
    in the orientation of the curve within it; a Gray code of all axes then gives the place, bit by bit.
    """
    x = [c.astype(np.int64) for c in cells.T]
    for bit in range(bits - 1, 0, -1):
        high, low = 1 << bit, (1 << bit) - 1
        for i in range(len(x)):
            reflect = (x[i] & high) != 0
            swap = np.where(reflect, 0, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(reflect, low, swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << bit), (1 << bit) - 1, 0)
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ turn) >> bit) & 1)
    return key


def curve_keys(units: np.ndarray, curve: int) -> np.ndarray:
    """Keys along the curve of that number: a random rotation, projected, and a random shift of the grid, all fixed by
    the number and the dimension alone."""
    d = units.shape[1]
    rng = np.random.default_rng([17, curve, d])
    m = min(d, CURVE_DIMENSIONS)
    basis = np.linalg.qr(rng.standard_normal((d, m)))[0]
    side = 1 << GRID_BITS
    # a coordinate of a unit vector in a random direction has a standard deviation of about 1 / sqrt(d)
    grid = (units @ basis.astype(units.dtype)) * (np.sqrt(d) / 6.4 * side / 1.3) + side * (0.5 / 1.3 + 0.3 / 1.3 * rng.random(m))
    return hilbert_keys(np.clip(grid, 0, side - 1).astype(np.int64), GRID_BITS)


def _least_kept(cosines: np.ndarray, k: int) -> np.ndarray:
    """Per row a bound that its k largest entries reach: the k-th of the largest entries of runs of columns, of which
    each run gives one, so that only a fraction of the row is sorted."""
    n, m = cosines.shape
    run = 16
    if m <= 4 * k or m < 8 * run:
        return np.full(n, -np.inf, cosines.dtype) if m <= k else -np.partition(-cosines, k - 1, axis=1)[:, k - 1]
    whole = m // run * run
    tops = cosines[:, :whole].reshape(n, -1, run).max(axis=2)
    if whole < m:
        tops = np.concatenate([tops, cosines[:, whole:].max(axis=1, keepdims=True)], axis=1)
    return -np.partition(-tops, k - 1, axis=1)[:, k - 1] if tops.shape[1] >= k else np.full(n, -np.inf, cosines.dtype)


def search_windows(ids: np.ndarray, exact: np.ndarray, place: np.ndarray, own: np.ndarray, target_ids: np.ndarray, targets: np.ndarray, k: int, window: int, block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, target row, cosine) of the k best targets within `window` places of each query row, best first.

    ids, exact: the queries, unit vectors in double; place: the number of targets before each, ascending; own: its row
    among the targets, or -1; target_ids and targets are in the order of the curve. A query is no target of itself.
    Cosines are rounded to six decimals, of equal ones the smaller id comes first.
    """
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    q32, t32 = exact.astype(np.float32), targets.astype(np.float32)
    for a in range(0, len(ids), block):
        some = slice(a, min(a + block, len(ids)))
        low, high = max(0, place[some][0] - window), min(len(targets), place[some][-1] + window + 1)
        if high <= low:
            continue
        cosines = q32[some] @ t32[low:high].T
        self_row = np.flatnonzero(own[some] >= 0)
        cosines[self_row, own[some][self_row] - low] = -np.inf
        i, j = np.nonzero(cosines >= np.maximum(_least_kept(cosines, k) - np.float32(SLACK), np.float32(-2))[:, None])
        i, j = i + a, j + low
        value = pair_cosines(exact, i, targets, j)
        other = ids[i] != target_ids[j]
        i, j, value = i[other], j[other], value[other]
        by = np.lexsort((target_ids[j], -value, i))
        i, j, value = i[by], j[by], value[by]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        found.append((i[keep], j[keep], value[keep]))
    return tuple(map(np.concatenate, zip(*found)))


def _lists(ids: np.ndarray, i: np.ndarray, other: np.ndarray, cosine: np.ndarray) -> pa.Array:
    """One list of (c, id) per row of ids, i ascending; c is the negative cosine in millionths, so that lists sort by it."""
    ends = np.searchsorted(i, np.arange(len(ids) + 1)).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(-np.round(cosine * 1e6).astype(np.int32)), pa.array(other)], ["c", "id"])
    return pa.ListArray.from_arrays(pa.array(ends), pairs)


def matrix(column: pa.Array) -> np.ndarray:
    """Unit rows, in double, of an Arrow column of lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit(np.asarray(column.flatten()).reshape(len(column), -1))


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (with `curves`) once per curve of their dataset, with curve and key."""
    schema = T.StructType([*rows.drop("curves").schema.fields, T.StructField("curve", T.IntegerType()), T.StructField("key", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            curves = np.asarray(whole.column("curves"))
            lengths = np.asarray(whole.column("embedding").value_lengths())
            for curve in range(curves.max(initial=0)):
                kept = pa.array(curves > curve)
                b, sizes = whole.filter(kept), lengths[curves > curve]
                key = np.zeros(b.num_rows, np.int64)
                for d in np.unique(sizes):
                    at = np.flatnonzero(sizes == d)
                    key[at] = curve_keys(matrix(b.column("embedding").take(pa.array(at))), curve)
                columns = [b.column(c) for c in b.schema.names if c != "curves"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(b.num_rows, curve, np.int32)), pa.array(key)], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


EDGE = "border: int, left: boolean, dataset: string, curve: int, train: boolean, vec_id: bigint, embedding: array<float>"


def _windows(k: int, parts: int):
    """A pass over the sorted partitions of all curves: a list per row, and the rows near the partition's ends, which
    the neighbouring partitions may need."""
    names = ["vec_id", "near", "edge"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        pid, rows = TaskContext.get().partitionId(), pa.Table.from_batches(held).combine_chunks()
        del held
        ids, curve, wide, data = np.asarray(rows["vec_id"]), np.asarray(rows["curve"]), np.asarray(rows["window"]), rows["dataset"].combine_chunks().dictionary_encode()
        code = np.asarray(data.indices)
        h, key, train = np.asarray(rows["h"]), np.asarray(rows["key"]), np.asarray(rows["train"])
        fresh = np.ones(len(ids), bool)  # rows delivered again stand side by side
        fresh[1:] = (np.diff(ids) != 0) | (np.diff(h) != 0) | (np.diff(key) != 0) | (np.diff(curve) != 0) | (train[1:] != train[:-1]) | (np.diff(code) != 0)
        kept = np.flatnonzero(fresh)
        rows = rows.take(pa.array(kept)).combine_chunks()
        ids, curve, wide, code, train = ids[kept], curve[kept], wide[kept], code[kept], train[kept]
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(curve) != 0) | (np.diff(code) != 0)]))
        ends = np.append(starts[1:], len(ids))
        for a, b in zip(starts, ends):
            part, own, is_train = rows.slice(a, b - a), ids[a:b], train[a:b]
            x = matrix(part["embedding"])
            at, window = np.flatnonzero(is_train), int(wide[a])
            before = np.cumsum(is_train) - is_train
            i, j, cosine = search_windows(own, x, before, np.where(is_train, before, -1), own[at], x[at], k, window)
            none = pa.nulls(b - a, pa.struct(_edge_type()))
            yield pa.RecordBatch.from_arrays([pa.array(own), _lists(own, i, own[at][j], cosine), none], names=names)
            for left, near, touches in ((False, before < window, a == 0 and pid > 0), (True, before >= len(at) - window, b == len(ids) and pid < parts - 1)):
                if touches:
                    e = part.filter(pa.array(near))
                    n = e.num_rows
                    border = pa.array(np.full(n, pid if left else pid - 1, np.int32))
                    columns = [border, pa.array(np.full(n, left)), *[e[c].combine_chunks() for c in ("dataset", "curve", "train", "vec_id", "embedding")]]
                    edge = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, _edge_type())], fields=_edge_type())
                    yield pa.RecordBatch.from_arrays([e["vec_id"].combine_chunks(), pa.nulls(n, _list_type()), edge], names=names)

    return run


def _list_type() -> pa.DataType:
    return pa.list_(pa.struct([("c", pa.int32()), ("id", pa.int64())]))


def _edge_type() -> list[pa.Field]:
    return [pa.field("border", pa.int32()), pa.field("left", pa.bool_()), pa.field("dataset", pa.string()), pa.field("curve", pa.int32()), pa.field("train", pa.bool_()), pa.field("vec_id", pa.int64()), pa.field("embedding", pa.list_(pa.float32()))]


def _across(k: int):
    """What the rows on either side of a border find on the other side."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for left in (True, False):
            asks, others = rows[rows["left"] == left], rows[(rows["left"] != left) & rows["train"]]
            if len(asks) and len(others):
                x, y = (unit(np.stack(r["embedding"].to_numpy())) for r in (asks, others))
                ids, others_ids = asks["vec_id"].to_numpy(), others["vec_id"].to_numpy()
                i, j, cosine = search_windows(ids, x, np.zeros(len(ids), np.int64), np.full(len(ids), -1), others_ids, y, k, len(others))
                pairs = [[] for _ in ids]
                for at, c, other in zip(i, -np.round(cosine * 1e6).astype(int), others_ids[j]):
                    pairs[at].append({"c": int(c), "id": int(other)})
                out.append(pd.DataFrame({"vec_id": ids, "near": pairs}))
        return pd.concat(out) if out else pd.DataFrame({"vec_id": np.empty(0, np.int64), "near": np.empty(0, object)})

    return run


def _without_copies(rows: DataFrame, k: int, copies: int) -> tuple[DataFrame, DataFrame | None]:
    """rows without those whose list is that of another row, and (vec_id, like) of these, or None if there are none.

    Of more than `copies` equal vectors of a dataset the k + 1 train rows of the smallest ids are left (or other rows,
    where it has fewer): no further one can be among the k nearest of anything, and each has the same list as the last
    of these. Positions within the groups are exact prefix sums, so a group may hold any share of all rows.
    """
    same = ["dataset", "h", "h2"]
    many = rows.groupBy(*same).agg(F.count("*").alias("__n")).filter(F.col("__n") > copies).drop("__n")
    if many.isEmpty():
        return rows, None
    members = rows.select(*same, "train", "vec_id").join(many, same).distinct()
    placed = materialize(positions(members, same, [F.col("train").desc(), F.col("vec_id").asc()], "__place"))
    last = placed.filter(F.col("__place") == k + 1).select(*same, F.col("vec_id").alias("like"))
    extra = placed.filter(F.col("__place") > k + 1)
    like = salted_join(extra, last, same, F.col("vec_id")).select("vec_id", "like")
    return rows.join(extra.select("vec_id").distinct(), "vec_id", "left_anti"), like


def neighbours(vectors: DataFrame, dataset_info: DataFrame, k: int = 5, *, window: int = WINDOW, density: float = DENSITY, cell: int = CELL, copies: int = COPIES) -> DataFrame:
    """(vec_id, neighbour, cosine): for every usable vector of any part the k train vectors of its dataset with the
    highest cosine (in double, rounded to six decimals), itself excepted, the smaller vec_id first if equal.

    Method: a Hilbert curve through a random projection of the vectors with a random shift of the grid puts similar
    vectors near each other; several such curves make up for what each tears apart. All rows are range-partitioned by
    Spark along all curves of their dataset (curves_of) into partitions of about `cell` rows. There each row is compared
    with at least `window` train rows (more in a dataset of more than so many) before and after it; the rows next to the border of two partitions meet those on the
    other side in a second, small pass, so that no window ends where a partition does (it reaches no further than the next
    one). The lists of a row from its curves are merged. The cosines are exact; recall is
    that of the windows. Datasets whose train rows all lie within one window come out exact. The work grows with the
    power 1.5 of a dataset's size, no task holds more than a partition and its neighbours' edges.

    Rows of one vec_id count once. Large groups of equal vectors are searched through k + 1 of them. Fewer than k
    neighbours come out where a dataset has no more. Nulls: see vectors.usable. Empty inputs give no rows. Other columns
    are ignored.
    """
    used = usable(vectors, dataset_info).filter(F.col("part").isNotNull())
    used = used.withColumns({"h": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding"), "train": F.col("part") == "train"}).drop("part")
    used, like = _without_copies(used, k, copies)
    present = vectors.filter(F.col("embedding").isNotNull() & F.col("part").isNotNull()).groupBy("dataset")
    sizes = present.agg(F.count_if(F.col("part") == "train").alias("__t"), F.count("*").alias("__n"))
    # written, so that Spark knows its size when it picks the join
    sizes = materialize(sizes.select("dataset", curves_of(F.col("__t"), window, density).alias("curves"), window_of(F.col("__t"), window).alias("window"), "__n"))
    total = sizes.agg(F.sum(F.col("curves") * F.col("__n"))).first()[0] or 0
    along = _keyed(used.join(sizes.drop("__n"), "dataset").drop("h2"))
    order = ["dataset", "curve", "key", "h", F.col("train").desc(), "vec_id"]
    parts = max(1, -(-total // cell))
    sorted_rows = along.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
    found = materialize(sorted_rows.mapInArrow(_windows(k, int(parts)), f"vec_id bigint, near {LIST}, edge struct<{EDGE}>"))
    edges = found.filter(F.col("edge").isNotNull()).select("edge.*")
    across = edges.groupBy("border", "dataset", "curve").applyInPandas(_across(k), f"vec_id bigint, near {LIST}")
    every = found.filter(F.col("near").isNotNull()).select("vec_id", "near").unionByName(across)
    merged = every.groupBy("vec_id").agg(F.flatten(F.collect_list("near")).alias("all"))
    nearest = merged.select("vec_id", F.slice(F.array_sort(F.array_distinct("all")), 1, k).alias("near"))
    if like is not None:
        nearest = materialize(nearest)
        others = salted_join(like, nearest.withColumnRenamed("vec_id", "like"), ["like"], F.col("vec_id")).select("vec_id", "near")
        nearest = nearest.unionByName(others)
    return nearest.select("vec_id", F.explode("near").alias("n")).select("vec_id", F.col("n.id").alias("neighbour"), (F.col("n.c") / -1e6).alias("cosine"))
