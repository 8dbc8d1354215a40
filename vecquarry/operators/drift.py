"""Schemas that drift between JSON files: one consistent table, and every change of its columns."""

from __future__ import annotations

import difflib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecquarry.operators.ordered import prefix_sums
from vecquarry.session import materialize

#: Words for units of time in names, and the seconds they stand for.
UNITS = {"s": 1.0, "sec": 1.0, "secs": 1.0, "second": 1.0, "seconds": 1.0, "ms": 1e-3, "msec": 1e-3, "millis": 1e-3, "milliseconds": 1e-3, "us": 1e-6, "micros": 1e-6, "microseconds": 1e-6, "ns": 1e-9, "nanoseconds": 1e-9}
#: A name that is not just another spelling is taken for a column's only if it shares at least this much of its words,
NAME_LEAST = 0.5
#: stands in at most this share of its files beside the other one,
BESIDE_MOST = 0.1
#: and its values' sketch is on the average at most so many powers of ten away.
DECADES_MOST = 1.5
#: Without any likeness of names, two paths must be as alike as this in types and values, and never be in one file though
#: so many files with both were to be expected by chance.
ALIKE_LEAST, EXPECTED_LEAST = 0.6, 20
#: The sketch of a path's values: these quantiles of the logarithms of their absolute values.
QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95]
KINDS = ["number", "string", "boolean", "array of numbers", "array of strings"]
#: Most pairs of names that are held on the driver when names are put together to columns.
MOST_LINKS = 1_000_000

FILE = "file_id bigint, dataset string, algorithm string, written_at timestamp_ntz"
ENTRY = "array<struct<path: string, type: string, numbers: array<double>>>"


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def parse_object(body: str | None) -> dict | None:
    """The object a text holds, or None if it holds anything else. Of a key given twice the last counts."""
    try:
        found = json.loads(body, parse_constant=_no_constant)
    except (ValueError, TypeError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _kind(value) -> str:
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def type_of(value) -> str | None:
    """number, string, boolean, array of numbers, array of strings, ...; None for null and for arrays of nothing else."""
    if value is None:
        return None
    if isinstance(value, list):
        inner = sorted({_kind(v) for v in value if v is not None})
        return f"array of {' and '.join(k + 's' for k in inner)}" if inner else None
    return _kind(value)


def _numbers(value) -> list[float]:
    if isinstance(value, bool) or value is None:
        return []
    if isinstance(value, (int, float)):
        try:
            v = float(value)
        except OverflowError:
            return []
        return [v] if math.isfinite(v) else []
    if isinstance(value, list):
        return [x for v in value if not isinstance(v, list) for x in _numbers(v)]
    if isinstance(value, str):
        try:
            found = [float(x) for x in value.replace(",", " ").replace(";", " ").split()]
        except ValueError:
            return []
        return [x for x in found if math.isfinite(x)]
    return []


def leaves(found: dict) -> Iterator[tuple[str, object]]:
    """(dotted path, value) of every field that is no object."""
    todo = [("", found)]
    while todo:
        prefix, level = todo.pop()
        for key, value in level.items():
            if isinstance(value, dict):
                todo.append((f"{prefix}{key}.", value))
            else:
                yield prefix + key, value


def flatten(found: dict) -> list[tuple[str, str | None, list[float]]]:
    """(dotted path, type, numbers) of every field that is no object."""
    return [(path, type_of(value), _numbers(value)) for path, value in leaves(found)]


def read_files(results: DataFrame) -> DataFrame:
    """(file_id, dataset, algorithm, written_at, body, paths, entries) of every file whose body is a JSON object, each file_id
    once (as first delivered). Null file_ids are left out; null datasets and algorithms make a series of their own."""
    kept = F.struct("dataset", "algorithm", "written_at", "body")
    once = results.filter(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.min_by(kept, F.struct(F.coalesce("arrived_at", F.lit("9999-12-31").cast("timestamp_ntz")), "body")).alias("f"))
    item = [("path", pa.string()), ("type", pa.string()), ("numbers", pa.list_(pa.float64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse_object(t) for t in b.column("body").to_pylist()]
            entries = [flatten(o) for o in found if o is not None]
            flat = [e for es in entries for e in es]
            columns = [pa.array([e[i] for e in flat], t) for i, (_, t) in enumerate(item)]
            ends = np.concatenate([[0], np.cumsum([len(e) for e in entries])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, [n for n, _ in item]))
            kept = b.filter(pa.array([o is not None for o in found], pa.bool_()))
            paths = pa.ListArray.from_arrays(pa.array(ends), columns[0])
            yield pa.RecordBatch.from_arrays([*kept.columns, paths, lists], names=[*kept.schema.names, "paths", "entries"])

    return once.select("file_id", "f.dataset", "f.algorithm", "f.written_at", "f.body").mapInArrow(run, f"{FILE}, body string, paths array<string>, entries {ENTRY}")


def words_of(name: str) -> list[str]:
    """The words of a name in any spelling (bestQps, BEST_QPS, best-qps), in lower case and without a plural's s."""
    found = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+|[^\W\d_]+", name)
    return [w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in (w.lower() for w in found)]


def _alike(a: str, b: str) -> float:
    ratio = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    return 1.0 if a == b else ratio if ratio >= 0.8 else 0.0


def _spell_out(words: list[str], other: list[str]) -> list[str]:
    """words with runs of them that other has by their initials (queries per second: qps) put so."""
    for short in other:
        for at in range(len(words) - len(short) + 1):
            run = words[at : at + len(short)]
            if 1 < len(short) <= 5 and "".join(w[0] for w in run) == short:
                return [*words[:at], short, *words[at + len(short) :]]
    return words


def name_similarity(field: str, path: str) -> float:
    """1.0 if path (or what follows its last dot) is the field's name in another spelling or order of words; else the
    share of words they have in common, below 1. Words for units say nothing."""
    best = 0.0
    for name in {path, path.rpartition(".")[2]}:
        a, b = words_of(field), words_of(name)
        a, b = _spell_out(a, b), _spell_out(b, a)
        if sorted(a) == sorted(b) and a:
            return 1.0
        b = [w for w in b if w not in UNITS and w + "s" not in UNITS] or b
        shared = sum(max((_alike(x, y) for y in b), default=0.0) for x in a)
        if a and b:
            best = max(best, 0.99 * (0.75 * shared / len(a) + 0.25 * shared / len(b)))
    return best


def unit_scale(path: str) -> float:
    words = re.findall(r"[a-z]+", path.rpartition(".")[2].lower())
    return next((UNITS[w] for w in reversed(words) if w in UNITS), 1.0)


def assign(gain: np.ndarray) -> list[int]:
    """Per row the column of a one-to-one matching with the largest total gain, or -1; pairs of no gain stay apart."""
    n, m = gain.shape
    cost = np.zeros((n, m + n))
    cost[:, :m] = -np.maximum(gain, 0)
    rows, cols, back = np.zeros(n + 1), np.zeros(m + n + 1), np.full(m + n + 1, -1)
    for i in range(n):  # a shortest augmenting path per row, on reduced costs
        back[-1], j0 = i, m + n
        least, way, seen = np.full(m + n, np.inf), np.full(m + n, -1), np.zeros(m + n, bool)
        while back[j0] >= 0:
            i0 = back[j0]
            if j0 < m + n:
                seen[j0] = True
            reduced = cost[i0] - rows[i0] - cols[:-1]
            better = ~seen & (reduced < least)
            least[better], way[better] = reduced[better], j0
            j1 = int(np.argmin(np.where(seen, np.inf, least)))
            delta = least[j1]
            rows[back[:-1][seen]] += delta
            rows[i] += delta
            cols[:-1][seen] -= delta
            least[~seen] -= delta
            j0 = j1
        while j0 != m + n:
            j1 = way[j0]
            back[j0] = back[j1]
            j0 = j1
    out = [-1] * n
    for j in range(m):
        if back[j] >= 0 and gain[back[j], j] > 0:
            out[back[j]] = j
    return out


@dataclass
class Drift:
    #: (file_id, dataset, algorithm, written_at, one column per field, others): the consistent table; others holds what
    #: is in no asked field, as JSON by the names of the columns.
    unified: DataFrame
    #: (file_id, dataset, algorithm, written_at, field, change, old, new)
    changes: DataFrame
    #: (column, path, files, types): the names of every column, which is called by the most frequent of them.
    columns: DataFrame


@dataclass
class Profile:
    """A path over all files: the files it is in, the share of each of KINDS among those with a type, the QUANTILES of the
    values' logarithms in base units (the mean within a file; None if it has no values), and its column once found."""

    files: int
    types: np.ndarray
    sketch: np.ndarray | None
    column: str = ""


def profile(files: DataFrame) -> dict[str, Profile]:
    """The profile of every path, of which there may be MOST_LINKS."""
    long = files.select(F.inline("entries")).select("path", "type", "numbers")
    logs = F.transform(F.filter("numbers", lambda x: x != 0), lambda x: F.log10(F.abs(x)))
    log = F.aggregate(logs, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size(logs), F.lit(0))
    kinds = F.array(*[F.count_if(F.col("type") == k) for k in KINDS])
    stats = long.select("path", "type", log.alias("log")).groupBy("path")
    stats = stats.agg(F.count("*").alias("files"), F.count("type").alias("typed"), kinds.alias("types"), F.percentile_approx("log", QUANTILES, 1000).alias("sketch"))
    out = {}
    for r in _bounded(stats, "names"):
        sketch = None if r["sketch"] is None else np.array(r["sketch"]) + math.log10(unit_scale(r["path"]))
        out[r["path"]] = Profile(r["files"], np.array(r["types"]) / max(1, r["typed"]), sketch, r["path"])
    return out


def together(files: DataFrame) -> DataFrame:
    """(a, b, both) of the pairs of paths, a < b, that are in the same file, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = [b for b in batches if b.num_rows]
        while todo:
            b = todo.pop()
            codes = b.column("paths").flatten().dictionary_encode()
            names, row = codes.dictionary.to_pylist(), np.repeat(np.arange(b.num_rows), np.asarray(b.column("paths").value_lengths()))
            if len(names) > 4096 and b.num_rows > 1:  # too wide for one matrix
                todo += [b.slice(0, b.num_rows // 2), b.slice(b.num_rows // 2)]
                continue
            order = np.argsort(np.array(names, object))
            rank = np.argsort(order)
            present = np.zeros((b.num_rows, len(names)), np.float32)
            present[row, rank[np.asarray(codes.indices)]] = 1
            i, j = np.nonzero(np.triu(counts := present.T @ present, 1))
            ordered = pa.array([names[k] for k in order], pa.string())
            yield pa.RecordBatch.from_arrays([ordered.take(pa.array(i)), ordered.take(pa.array(j)), pa.array(counts[i, j].astype(np.int64))], names=["a", "b", "both"])

    return files.select("paths").mapInArrow(run, "a string, b string, both bigint").groupBy("a", "b").agg(F.sum("both").alias("both"))


def _apart(a: np.ndarray | None, b: np.ndarray | None) -> float | None:
    """The mean distance of two sketches in powers of ten."""
    return None if a is None or b is None else float(np.abs(a - b).mean())


def likeness(a: str, b: str, profiles: dict[str, Profile], n_files: int) -> tuple[float, bool]:
    """(gain, needs) of two names for being of one column, but for the files they are in together: 0 if they are not alike
    enough in name, types and values. needs: they share no words, so that they must never be in one file though so many
    files with both were to be expected by chance."""
    x, y = profiles[a], profiles[b]
    apart = _apart(x.sketch, y.sketch)
    if apart is not None and apart > DECADES_MOST:
        return 0.0, False
    name, types, values = max(name_similarity(a, b), name_similarity(b, a)), float(np.minimum(x.types, y.types).sum()), 1 / (1 + (1.0 if apart is None else apart))
    strong = x.files * y.files / max(1, n_files) >= EXPECTED_LEAST and min(values, types) >= ALIKE_LEAST
    return (name + types / 2 + values / 2, name < NAME_LEAST) if name >= NAME_LEAST or strong else (0.0, False)


def _beside(a: str, b: str, both: dict[tuple[str, str], int]) -> int:
    return both.get((min(a, b), max(a, b)), 0)


def versions_of(placed: DataFrame) -> DataFrame:
    """(version, gone, come, files): what goes and comes from one version to the next in any series, and in how many files.
    A version is the set of a file's paths; each two are taken once, however many files change so."""
    series = ["dataset", "algorithm"]
    before = placed.select(*[F.col(c).alias(f"p_{c}") for c in [*series, "place", "paths"]])
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in series] + [F.col("place") == F.col("p_place") + 1]
    steps = placed.join(before, same).select(F.array_sort(F.array_except("p_paths", "paths")).alias("gone"), F.array_sort(F.array_except("paths", "p_paths")).alias("come"))
    return materialize(steps.filter((F.size("gone") > 0) & (F.size("come") > 0)).groupBy("gone", "come").agg(F.count("*").alias("files")))


def renames(versions: DataFrame, gain: dict[tuple[str, str], float]) -> DataFrame:
    """(old, new, files): how often one name was put in the place of another. The paths that go and those that come between
    two versions are matched one to one with the largest total gain."""

    def pick(gone: pd.Series, come: pd.Series) -> pd.Series:
        out = []
        for olds, news in zip(gone, come):
            matrix = np.array([[gain.get((a, b), 0.0) for b in news] for a in olds])
            out.append([{"old": olds[i], "new": news[j]} for i, j in enumerate(assign(matrix)) if j >= 0] if matrix.any() else [])
        return pd.Series(out)

    chosen = versions.select("files", F.explode(F.pandas_udf(pick, "array<struct<old: string, new: string>>")("gone", "come")).alias("m"))
    return chosen.groupBy("m.old", "m.new").agg(F.sum("files").alias("files"))


def columns_of(files: dict[str, int], links: list[tuple[str, str, int]], beside: dict[tuple[str, str], int]) -> dict[str, str]:
    """The column of every path: links (old, new, times) are taken from the most frequent on, unless they would bring
    together two paths that are in one file more often than BESIDE_MOST. A column is called by its most frequent path."""
    column, members = {p: p for p in files}, {p: [p] for p in files}
    apart = lambda a, b: beside.get((min(a, b), max(a, b)), 0) > BESIDE_MOST * min(files[a], files[b])
    for old, new, _ in sorted(links, key=lambda x: (-x[2], x[0], x[1])):
        a, b = column[old], column[new]
        if a != b and not any(apart(x, y) for x in members[a] for y in members[b]):
            keep, drop = sorted((a, b), key=lambda c: (-files[c], c))
            members[keep] += members.pop(drop)
            column |= dict.fromkeys(members[keep], keep)
    return column


def _bounded(df: DataFrame, what: str) -> list:
    rows = df.limit(MOST_LINKS + 1).collect()
    if len(rows) > MOST_LINKS:
        raise ValueError(f"more than {MOST_LINKS} {what}")
    return rows


def find_columns(files: DataFrame, fields: list[str]) -> tuple[dict[str, Profile], dict[str, dict[str, float]]]:
    """(profiles with their columns, field -> path -> gain of the names that may stand for it).

    Names of the same words in another spelling are linked wherever they occur; other links are the renames between
    versions. A field asked for may stand under its own name in any spelling, all names of a column one of whose names is
    such, and names that share NAME_LEAST of its words, hardly ever stand beside a spelling of it, and have like values.
    What is about names, of which there may be MOST_LINKS, is done on the driver; what is about files is not."""
    profiles, spark, n_files = profile(files), files.sparkSession, files.count()
    order = [F.col("written_at").asc_nulls_first(), F.col("file_id").asc()]
    placed = prefix_sums(files.select("file_id", "dataset", "algorithm", "written_at", "paths"), ["dataset", "algorithm"], order, {"place": F.lit(1).cast("bigint")})
    versions = versions_of(placed)
    changed = versions.select(F.explode("gone").alias("old"), "come").select("old", F.explode("come").alias("new")).distinct()
    alike = {(a, b): like for a, b in _bounded(changed, "pairs of names") if (like := likeness(a, b, profiles, n_files))[0] > 0}
    named = {f: {p: s for p in profiles if (s := name_similarity(f, p)) >= NAME_LEAST} for f in fields}
    spelled: dict[tuple, list[str]] = {}
    for p in sorted(profiles):
        if words_of(p.rpartition(".")[2]):
            spelled.setdefault(tuple(sorted(words_of(p.rpartition(".")[2]))), []).append(p)
    needed = {p for pair in alike for p in pair} | {p for of in named.values() for p in of} | {p for same in spelled.values() if len(same) > 1 for p in same}
    some = lambda c: spark.createDataFrame([(p,) for p in sorted(needed)], f"{c} string")
    pairs = together(files).join(some("a"), "a", "left_semi").join(some("b"), "b", "left_semi")
    both = {(r["a"], r["b"]): r["both"] for r in _bounded(pairs, "pairs of names")}
    gain = {}
    for (a, b), (value, needs) in alike.items():
        met = _beside(a, b, both)
        if met <= BESIDE_MOST * min(profiles[a].files, profiles[b].files) and not (needs and met):
            gain[a, b] = value
    links = [tuple(r) for r in _bounded(renames(versions, gain), "renames")] if gain else []
    links += [(same[0], p, min(profiles[same[0]].files, profiles[p].files)) for same in spelled.values() for p in same[1:]]
    for p, column in columns_of({p: x.files for p, x in profiles.items()}, links, both).items():
        profiles[p].column = column
    return profiles, {f: _standing_for(named[f], profiles, both) for f in fields}


def _standing_for(named: dict[str, float], profiles: dict[str, Profile], both: dict[tuple[str, str], int]) -> dict[str, float]:
    """path -> gain of the names that may stand for a field, named being the likeness of names to its own."""
    own = [p for p, s in named.items() if s >= 1]
    columns, sketches = {profiles[p].column for p in own}, [profiles[p].sketch for p in own if profiles[p].sketch is not None]
    usual = np.mean(sketches, axis=0) if sketches else None
    kinds = np.mean([profiles[p].types for p in own], axis=0) if own else np.zeros(len(KINDS))
    out = {}
    for p in {*named, *[p for p, x in profiles.items() if x.column in columns]}:
        x, name = profiles[p], named.get(p, 0.0)
        apart = _apart(x.sketch, usual) or 0.0
        alone = sum(_beside(p, o, both) for o in own if o != p) <= BESIDE_MOST * x.files
        if name >= 1 or (alone and apart <= DECADES_MOST):
            out[p] = name + float(np.minimum(x.types, kinds).sum()) / 2 + 1 / (1 + apart)
    return out


def match(files: DataFrame, names: dict[str, dict[str, float]]) -> DataFrame:
    """(file_id, dataset, algorithm, written_at, field, path, type, numbers): for every file and field the entry that
    stands for the field, or nulls. Per file a bipartite matching of fields and entries by the gains of their names."""
    fields, gain = list(names), {}
    for f, of in enumerate(names.values()):
        for path, value in of.items():
            gain.setdefault(path, []).append((f, value))
    keys, numbers = ["file_id", "dataset", "algorithm", "written_at"], ["path", "type", "numbers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, start = [], 0
            for paths in b.column("paths").to_pylist():
                some = [(i, gain[p]) for i, p in enumerate(paths) if p in gain]
                matrix = np.zeros((len(fields), len(some)))
                for j, (_, pairs) in enumerate(some):
                    for f, g in pairs:
                        matrix[f, j] = g
                # with one field to an entry and one entry to a field there is one matching only
                plain = (np.count_nonzero(matrix, axis=0) <= 1).all() and (np.count_nonzero(matrix, axis=1) <= 1).all()
                chosen = ([int(np.argmax(row)) if row.any() else -1 for row in matrix] if plain else assign(matrix)) if some else [-1] * len(fields)
                at += [None if j < 0 else start + some[j][0] for j in chosen]
                start += len(paths)
            entries, again = b.column("entries").flatten(), pa.array(np.repeat(np.arange(b.num_rows), len(fields)))
            field = pa.array(fields * b.num_rows, pa.string())
            taken = [entries.field(n).take(pa.array(at, pa.int64())) for n in numbers]
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(again) for k in keys], field, *taken], names=[*keys, "field", *numbers])

    return files.select(*keys, "paths", "entries").mapInArrow(run, f"{FILE}, field string, path string, type string, numbers array<double>")


def others(files: DataFrame, column: dict[str, str]) -> DataFrame:
    """(file_id, others): the fields of (file_id, body, asked) whose paths are not in asked, as JSON by the names of their
    columns, of which the first path counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for body, asked in zip(b.column("body").to_pylist(), b.column("asked").to_pylist()):
                own: dict[str, str] = {}
                for path, value in sorted(leaves(parse_object(body) or {}), key=lambda x: x[0]):
                    if path not in (asked or ()):
                        own.setdefault(column[path], json.dumps(value, ensure_ascii=False))
                out.append(sorted(own.items()))
            yield pa.RecordBatch.from_arrays([b.column("file_id"), pa.array(out, pa.map_(pa.string(), pa.string()))], names=["file_id", "others"])

    return files.mapInArrow(run, "file_id bigint, others map<string,string>")


def drift(results: DataFrame, fields: dict[str, str]) -> Drift:
    """The consistent table of all files and every change of the fields between successive files of a series.

    results: (file_id, dataset, algorithm, written_at, arrived_at, body); a series is the files of one (dataset,
    algorithm) by (written_at, file_id). fields: name -> max, min or list, what an array of values becomes in the table.

    Method: each path is profiled over all files (types, sketch of values, company). Between successive versions of a
    series the paths that go and come are matched one to one by likeness of name, types and values; what is matched is
    put together to columns. The names of a column one of which is a spelling of a field stand for that field, as do
    names that resemble it; the fields and the entries of each file are matched one to one, and a field under different
    names in successive files is a rename. Matched columns are cast to one type (numbers in text and in arrays read,
    units in names converted), the others are kept as JSON under their columns' names.

    Changes are added, removed, renamed and retyped, against the preceding file of the series that holds a JSON object;
    the first has none. A null or empty array is a present field without a type; a type is compared with the last one
    known since the field was added. Bodies that are null, empty or no JSON object are passed over. Files delivered again
    count once. Other columns are ignored. An empty table gives empty results. A series of any length is spread over all
    tasks: places in the series are exact prefix sums, and predecessors are found by joins on places.
    """
    files = materialize(read_files(results))
    profiles, names = find_columns(files, list(fields))
    matched = materialize(match(files, names))  # range partitioning reads it twice
    present, typed = F.col("path").isNotNull(), F.col("type").isNotNull()
    one = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    rows = prefix_sums(matched, ["dataset", "algorithm", "field"], [F.col("written_at").asc_nulls_first(), F.col("file_id").asc()], {"place": F.lit(1).cast("bigint"), "present": one(present), "typed": one(typed)})

    def before(side: DataFrame, on: str, names: list[str]) -> tuple[DataFrame, list[Column]]:
        p = side.select(*[F.col(c).alias(f"p_{c}") for c in ["dataset", "algorithm", "field", on, *names]])
        return p, [*[F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in ("dataset", "algorithm", "field")], F.col(on) == F.col(f"p_{on}") + 1]

    last, keys = before(rows, "place", ["path"])
    named = rows.join(last, keys, "left").filter(F.col("place") > 1)
    had, has = F.col("p_path").isNotNull(), present
    change = F.when(~had & has, "added").when(had & ~has, "removed").when(had & has & (F.col("p_path") != F.col("path")), "renamed")
    columns = ["file_id", "dataset", "algorithm", "written_at", "field"]
    changes = named.withColumn("change", change).filter("change IS NOT NULL").select(*columns, "change", F.col("p_path").alias("old"), F.col("path").alias("new"))
    known, keys = before(rows.filter(typed), "typed", ["place", "present", "type"])
    pairs = rows.filter(typed).join(known, keys)
    unbroken = F.col("place") - F.col("p_place") == F.col("present") - F.col("p_present")
    types = pairs.filter(unbroken & (F.col("type") != F.col("p_type"))).select(*columns, F.lit("retyped").alias("change"), F.col("p_type").alias("old"), F.col("type").alias("new"))

    scaled = F.pandas_udf(lambda p: pd.Series([1.0 if x is None else unit_scale(x) for x in p]), "double")
    value = rows.withColumn("u", scaled("path")).withColumn("v", F.transform("numbers", lambda x: x * F.col("u")))
    how = {"max": F.array_max, "min": F.array_min, "list": lambda c: c}
    table = value.groupBy("file_id").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("dataset", "algorithm", "written_at")],
        *[how[h](F.first(F.when(F.col("field") == f, F.col("v")), ignorenulls=True)).alias(f) for f, h in fields.items()],
    )
    asked = matched.filter(F.col("path").isNotNull()).groupBy("file_id").agg(F.collect_list("path").alias("asked"))
    rest = others(files.select("file_id", "body").join(asked, "file_id", "left"), {p: x.column for p, x in profiles.items()})
    rows_of_report = [(x.column, p, x.files, [k for k, share in zip(KINDS, x.types) if share > 0]) for p, x in sorted(profiles.items())]
    report = files.sparkSession.createDataFrame(rows_of_report, "column string, path string, files bigint, types array<string>")
    return Drift(table.join(rest, "file_id", "left"), changes.unionByName(types), report)
