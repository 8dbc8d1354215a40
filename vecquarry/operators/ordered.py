"""Exact positions and running sums in ordered groups of any size.

A window function puts each group into one task. Here the rows are range-partitioned on (group, order), summed within
each partition by one streaming pass, and what a group holds in earlier partitions is added afterwards; that correction
is one row per partition. A group may span any number of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecquarry.session import materialize


def group_breaks(batch: pa.RecordBatch | pa.Table, group: list[str]) -> np.ndarray:
    """True where a row's group differs from that of the row before; nulls equal each other. Row 0 is False."""
    out = np.zeros(batch.num_rows, bool)
    for name in group:
        column = batch.column(name)
        a, b = column.slice(1), column.slice(0, max(0, batch.num_rows - 1))
        changed = pc.fill_null(pc.not_equal(a, b), False)
        one_null = pc.xor(pc.is_null(a), pc.is_null(b))
        out[1:] |= np.asarray(pc.or_(changed, one_null))
    return out


def _segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at each start (starts[0] == 0)."""
    total = np.cumsum(values)
    before = np.concatenate([[0], total[starts[1:] - 1]]).astype(total.dtype)
    lengths = np.diff(np.append(starts, len(values)))
    return total - np.repeat(before, lengths)


def prefix_sums(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    sums: dict[str, Column],
    *,
    ties: list[str] | None = None,
    keep: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """df with a column per entry of sums: the running sum, this row included, in the row's group in the given order.

    group: column names, null being a group of its own. order: sort expressions, which must be total for a definite
    result. sums: bigint or double expressions, not null. ties: columns, without NaN, by which rows are alike; the order
    must keep such rows of a group together. The sums are then those of the rows before the first one alike, as in
    RANK. keep: drop rows after the first `keep` of each group within their partition, but for its last row; the first entry of sums must then
    be the count of rows (lit(1)), without ties, and counts up to `keep` stay exact. An empty df gives an empty result.
    """
    names = list(sums)
    weighted = df.withColumns({f"__w{i}": sums[n] for i, n in enumerate(names)})
    keys = [F.col(g).asc_nulls_first() for g in group] + order
    ranged = weighted.repartitionByRange(partitions, *keys) if partitions else weighted.repartitionByRange(*keys)
    ranged = ranged.sortWithinPartitions(*keys)
    kinds = [ranged.schema[f"__w{i}"].dataType for i in range(len(names))]
    tie_names = [f"__b{i}" for i in range(len(names))] if ties else []
    alike = [*group, *(ties or [])]
    marks = T.StructType([T.StructField("__pid", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("__seg", "__run")], T.StructField("__edge", T.IntegerType())])
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, k) for n, k in zip([*names, *tie_names], kinds * 2)], *marks.fields])
    columns = df.columns

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        last, last_alike, seg, run_no, held = None, None, 0, 0, None
        carry, carry_before = [0] * len(names), [0] * len(names)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = lambda cols, at: tuple(batch.column(c)[at].as_py() for c in cols)  # noqa: B023, E731
            starts = np.flatnonzero(np.concatenate([[True], group_breaks(batch, group)[1:]]))
            lengths = np.diff(np.append(starts, n))
            first = key(group, 0)
            continues = last is not None and first == last
            if last is not None and not continues:
                seg += 1
            segs = seg + np.repeat(np.arange(len(starts)), lengths)
            outs, befores, runs = [], [], np.zeros(n, np.int64)
            for i in range(len(names)):
                run = _segment_sums(batch.column(f"__w{i}").to_numpy(zero_copy_only=False), starts)
                if continues:
                    run[: lengths[0]] += carry[i]
                outs.append(run)
            if ties:
                tie_starts = np.flatnonzero(np.concatenate([[True], group_breaks(batch, alike)[1:]]))
                tie_lengths = np.diff(np.append(tie_starts, n))
                same = last_alike is not None and key(alike, 0) == last_alike
                if last_alike is not None and not same:
                    run_no += 1
                runs = run_no + np.repeat(np.arange(len(tie_starts)), tie_lengths)
                for i in range(len(names)):
                    before = outs[i][tie_starts] - batch.column(f"__w{i}").to_numpy(zero_copy_only=False)[tie_starts]
                    if same:
                        before[0] = carry_before[i]
                    befores.append(np.repeat(before, tie_lengths))
                carry_before, run_no, last_alike = [o[-1] for o in befores], int(runs[-1]), key(alike, n - 1)
            carry, seg, last = [o[-1] for o in outs], int(segs[-1]), key(group, n - 1)
            edge = np.zeros(n, np.int32)  # 1: the first row of the partition, 2: the last, 3: both
            if held is None:
                edge[0] = 1
            else:
                yield finish(*held, False)
            held = ([*[batch.column(c) for c in columns], *[pa.array(o) for o in [*outs, *befores]], pa.array(np.full(n, pid, np.int32)), *[pa.array(x.astype(np.int64)) for x in (segs, runs)]], edge, outs[0])
        if held is not None:
            yield finish(*held, True)

    def finish(arrays: list[pa.Array], edge: np.ndarray, count: np.ndarray, at_end: bool) -> pa.RecordBatch:
        edge[-1] += 2 * at_end
        out = pa.RecordBatch.from_arrays([*arrays, pa.array(edge)], names=schema.names)
        return out.filter(pa.array((count <= keep) | (edge > 0))) if keep is not None else out

    done = materialize(ranged.mapInArrow(local, schema))
    # the first and the last row of each partition
    edges = done.filter(F.col("__edge") > 0).select("__pid", "__edge", "__seg", "__run", F.struct(F.lit(0), *alike).alias("key"), F.struct(F.lit(0), *names).alias("sums"), F.struct(F.lit(0), *tie_names).alias("befores"))
    found: dict[int, list] = {}
    for r in edges.collect():
        pair = found.setdefault(r["__pid"], [None, None])
        pair[0] = r if r["__edge"] & 1 else pair[0]
        pair[1] = r if r["__edge"] & 2 else pair[1]
    offsets, before = [], None
    for pid, (first, end) in sorted(found.items()):
        head, last_key, width = tuple(first["key"])[1:], tuple(end["key"])[1:], len(group)
        sums_here, befores_here = list(end["sums"])[1:], list(end["befores"])[1:]
        off = before[1] if before and before[0][:width] == head[:width] else [0] * len(names)
        goes_on = bool(ties) and before is not None and before[0] == head
        at_head = before[2] if goes_on else [a + b for a, b in zip(off, list(first["befores"])[1:])]
        if any(off) or goes_on:
            offsets.append((pid, *off, *([at_head[i] for i in range(len(names))] if ties else [])))
        add = off if end["__seg"] == 0 else [0] * len(names)
        at_tail = at_head if end["__run"] == 0 else [a + b for a, b in zip(add, befores_here)]
        before = (last_key, [a + b for a, b in zip(add, sums_here)], at_tail)
    if offsets:
        fields = [T.StructField("__pid", T.IntegerType()), *[T.StructField(f"__o{i}", k) for i, k in enumerate(kinds)], *[T.StructField(f"__h{i}", k) for i, k in enumerate(kinds) if ties]]
        small = done.sparkSession.createDataFrame(offsets, T.StructType(fields))
        done = done.join(F.broadcast(small), "__pid", "left")  # at most one row per partition
        first = F.col("__seg") == 0
        shift = [F.when(first, F.coalesce(f"__o{i}", F.lit(0))).otherwise(F.lit(0)).cast(k) for i, k in enumerate(kinds)]
        if ties:
            moved = {b: F.when((F.col("__run") == 0) & F.col(f"__h{i}").isNotNull(), F.col(f"__h{i}")).otherwise(F.col(b) + shift[i]) for i, b in enumerate(tie_names)}
        else:
            moved = {n: F.col(n) + shift[i] for i, n in enumerate(names)}
        done = done.withColumns(moved)
    return done.select(*columns, *([F.col(b).alias(n) for n, b in zip(names, tie_names)] if ties else names))


def positions(df: DataFrame, group: list[str], order: list[Column], name: str = "position", **how) -> DataFrame:
    """df with the exact 1-based position of each row in its group."""
    return prefix_sums(df, group, order, {name: F.lit(1).cast("bigint")}, **how)
