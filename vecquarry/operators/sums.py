"""Sums of arrays over all partitions, added up in a tree so that the driver gets a bounded number of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Arrays that are added up in one task, or sent to the driver.
FAN = 64


def _row(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])


def tree_sum(df: DataFrame, size: int, add: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of df of add(batch), an array of `size` doubles; zeros if df is empty.

    Each partition sends one array. More than FAN of them are first added up in tasks of FAN each, level by level, so
    that what the driver holds does not grow with the data.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size), False
        for b in batches:
            if b.num_rows:
                total, some = total + add(b), True
        if some:
            yield _row(total)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size), False
        for b in batches:
            if b.num_rows:
                total, some = total + np.asarray(b.column("sums").flatten()).reshape(-1, size).sum(axis=0), True
        if some:
            yield _row(total)

    parts, count = df.mapInArrow(local, "sums array<double>"), df.rdd.getNumPartitions()
    while count > FAN:
        count = -(-count // FAN)
        parts = parts.repartition(count).mapInArrow(together, "sums array<double>")
    return np.sum([np.asarray(r["sums"]) for r in parts.collect()], axis=0, initial=0.0) + np.zeros(size)
