"""Mergeable quantile sketches with relative rank error: relative-rank compactors."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecquarry.operators.ordered import group_breaks
from vecquarry.session import materialize

#: Items in a section of a compactor. The rank error at rank r of n is about 0.5 / SECTION * (n - r).
SECTION = 128
#: Rows of a part of a large group, about.
PART_ROWS = 1_000_000


def _coin(items: np.ndarray) -> int:
    """0 or 1, by a hash of the values."""
    mixed = (items.view(np.uint64) ^ np.arange(len(items), dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    total = int(np.bitwise_xor.reduce(mixed ^ (mixed >> np.uint64(29)), initial=np.uint64(0)))
    return (total * 0xBF58476D1CE4E5B9 >> 40) & 1


class RelativeSketch:
    """A quantile sketch whose upper tail is kept almost exactly.

    A level h holds items of weight 2**h. A level that is full is sorted; its upper half and a number of sections above
    the lowest, given by how often the level was compacted, are protected; of the items below every second one moves up
    a level and the rest go. High ranks are thus hardly ever compacted, and the rank error falls in proportion to the
    distance from the top. Sketches merge level by level. Which of two neighbours goes is decided by a hash of the values
    that are compacted, so that the errors of many parts do not add up, and the same input in the same order gives the
    same sketch.
    """

    def __init__(self, section: int = SECTION):
        self.section, self.n, self.levels, self.states = section, 0, [], []

    def _sections(self, h: int) -> int:
        return 3 + max(0, int(math.log2(self.states[h] + 1)) - 2)

    def _compact(self) -> None:
        h = 0
        while h < len(self.levels):
            sections = self._sections(h)
            if len(self.levels[h]) > 2 * sections * self.section:
                state = self.states[h]
                free = min(sections, ((state + 1) & ~state).bit_length())
                protected = sections * self.section + (sections - free) * self.section
                items = np.sort(self.levels[h])
                low = (len(items) - protected) // 2 * 2
                promoted = items[_coin(items[:low]) : low : 2]
                self.levels[h], self.states[h] = items[low:], state + 1
                if h + 1 == len(self.levels):
                    self.levels.append(promoted)
                    self.states.append(0)
                else:
                    self.levels[h + 1] = np.concatenate([self.levels[h + 1], promoted])
            h += 1

    def update(self, values: np.ndarray) -> "RelativeSketch":
        if len(values):
            self.n += len(values)
            if not self.levels:
                self.levels, self.states = [np.empty(0)], [0]
            self.levels[0] = np.concatenate([self.levels[0], np.asarray(values, np.float64)])
            self._compact()
        return self

    def merge(self, other: "RelativeSketch") -> "RelativeSketch":
        self.n += other.n
        for h, items in enumerate(other.levels):
            if h == len(self.levels):
                self.levels.append(np.empty(0))
                self.states.append(0)
            self.levels[h] = np.concatenate([self.levels[h], items])
            self.states[h] |= other.states[h]
        self._compact()
        return self

    def quantiles(self, probabilities: list[float]) -> list[float | None]:
        """For each p the least value whose rank reaches p * n; None if the sketch is empty."""
        if not self.n:
            return [None] * len(probabilities)
        values = np.concatenate(self.levels)
        weights = np.repeat(2 ** np.arange(len(self.levels), dtype=np.int64), [len(x) for x in self.levels])
        by = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[by])
        wanted = np.clip(np.ceil(np.asarray(probabilities) * self.n - 1e-9), 1, self.n)
        return [float(x) for x in values[by][np.minimum(np.searchsorted(ranks, wanted), len(ranks) - 1)]]

    def to_bytes(self) -> bytes:
        head = struct.pack("<iqi", self.section, self.n, len(self.levels))
        return head + b"".join(struct.pack("<qi", s, len(x)) + x.tobytes() for x, s in zip(self.levels, self.states))

    @classmethod
    def from_bytes(cls, raw: bytes) -> "RelativeSketch":
        section, n, levels = struct.unpack_from("<iqi", raw)
        out, at = cls(section), 16
        out.n = n
        for _ in range(levels):
            state, size = struct.unpack_from("<qi", raw, at)
            out.levels.append(np.frombuffer(raw, np.float64, size, at + 12).copy())
            out.states.append(state)
            at += 12 + 8 * size
        return out


def _by_group(keys: list[str], column: str, add, section: int):
    """A pass over partitions sorted by keys: one sketch per run of equal keys, one of them open at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, sketch = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            brk = group_breaks(batch, keys)
            brk[0] = True
            starts = np.flatnonzero(brk)
            ends = np.append(starts[1:], batch.num_rows)
            heads = batch.select(keys).take(pa.array(starts)).to_pylist()
            done_keys, done = [], []
            values = batch.column(column)
            values = values.to_numpy(zero_copy_only=False) if pa.types.is_floating(values.type) else values
            for head, a, b in zip(heads, starts, ends):
                key = tuple(head.values())
                if key != open_key:
                    if sketch is not None:
                        done_keys.append(open_key)
                        done.append(sketch)
                    open_key, sketch = key, RelativeSketch(section)
                add(sketch, values, a, b)
            if done:
                yield _sketch_batch(batch.schema, keys, done_keys, done)
        if sketch is not None:
            yield _sketch_batch(batch.schema, keys, [open_key], [sketch])

    return run


def _sketch_batch(schema: pa.Schema, keys: list[str], rows: list[tuple], sketches: list[RelativeSketch]) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], schema.field(k).type) for i, k in enumerate(keys)]
    columns += [pa.array([s.n for s in sketches], pa.int64()), pa.array([s.to_bytes() for s in sketches], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[*keys, "n", "sketch"])


def _sketch_schema(df: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([*[df.schema[k] for k in keys], T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])


def _add_values(sketch: RelativeSketch, values: np.ndarray, a: int, b: int) -> None:
    sketch.update(values[a:b])


def _add_sketches(sketch: RelativeSketch, raw: pa.Array, a: int, b: int) -> None:
    for i in range(a, b):
        sketch.merge(RelativeSketch.from_bytes(raw[i].as_py()))


def usable_number(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def sketches(df: DataFrame, keys: list[str], value: str, section: int = SECTION) -> DataFrame:
    """(keys..., n, sketch): partial sketches of df as it is partitioned, one row per partition and group.

    Nulls, NaN and infinities in value are no values. Null keys are a group. Groups are sorted within the partition, one
    sketch is open at a time, and nothing is shuffled: a group of any size takes part in every partition it is in.
    Combine the rows with merge_sketches. An empty df gives no rows.
    """
    used = df.select(*keys, F.col(value).cast("double").alias("__value")).filter(usable_number(F.col("__value")))
    run = _by_group(keys, "__value", _add_values, section)
    return used.sortWithinPartitions(*keys).mapInArrow(run, _sketch_schema(used, keys))


def merge_sketches(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n, sketch): one sketch per group from the sketches of partitions, days or earlier merges.

    keys may be fewer than those the sketches were made for. A group meets at most one sketch per part it comes from.
    """
    used = df.select(*keys, "sketch")
    section = SECTION
    return used.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_by_group(keys, "sketch", _add_sketches, section), _sketch_schema(df, keys))


def sketch_quantiles(df: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    """(keys..., n, quantiles): the values at the given probabilities, in their order, of each sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [RelativeSketch.from_bytes(x).quantiles(probabilities) for x in batch.column("sketch").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in [*keys, "n"]], pa.array(found, pa.list_(pa.float64()))], names=[*keys, "n", "quantiles"])

    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("n", T.LongType()), T.StructField("quantiles", T.ArrayType(T.DoubleType()))])
    return df.select(*keys, "n", "sketch").mapInArrow(run, schema)


def measured_times(detail: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(dataset, algorithm, day, time) of every row of detail that counts: exact repeats once, time finite and above 0,
    dataset not null. A repeat is told by its own time, measured_at and a hash of the other columns; rows are spread by
    (dataset, algorithm, part), a group having a part for every `part_rows` rows, so that repeats meet and large groups
    are split."""
    rest = ["query_index", "k", "params", "recall", "build_time", "index_size"]
    time = F.col("time")
    nulls = sum((F.col(c).isNull().cast("int") * (1 << i) for i, c in enumerate(rest)), F.lit(0))
    rows = detail.filter(F.col("dataset").isNotNull() & usable_number(time) & (time > 0)).select(
        "dataset", F.coalesce("algorithm", F.lit("\0")).alias("algorithm"), "measured_at", "time", F.xxhash64(*rest, nulls).alias("__rest")
    )
    # the groups of more than one part, of which there is at most one for every part_rows rows; written, so that Spark
    # knows their size when it picks the join
    large = materialize(rows.groupBy("dataset", "algorithm").agg(F.ceil(F.count("*") / part_rows).alias("__parts")).filter("__parts > 1"))
    rows = rows.join(large, ["dataset", "algorithm"], "left")
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("__rest", "measured_at"), F.coalesce("__parts", F.lit(1))))
    rows = rows.repartition("dataset", "algorithm", "__part").dropDuplicates(["dataset", "algorithm", "__part", "measured_at", "time", "__rest"])
    return rows.select("dataset", F.nullif("algorithm", F.lit("\0")).alias("algorithm"), F.to_date("measured_at").alias("day"), "time")
