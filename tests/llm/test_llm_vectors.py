import numpy as np
import pytest

from vecquarry.llm import neighbours as N
from vecquarry.llm import overlap as O
from vecquarry.llm.vectors import unit, usable

SCHEMA = "dataset string, part string, vec_id bigint, source string, embedding array<float>, loaded_at string"


def units(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    rows, info = [], []
    for d, dim, n in (("big", 24, 900), ("small", 8, 60), ("tiny", 5, 3), ("alone", 6, 40)):
        x = (rng.standard_normal((6, dim))[rng.integers(6, size=n)] + 0.8 * rng.standard_normal((n, dim))).astype(np.float32)
        parts = np.where(rng.random(n) < 0.75, "train", np.where(rng.random(n) < 0.8, "test", "learn")) if d != "alone" else np.full(n, "train")
        for i in range(0, n - 20, 20):  # near copies, exact copies and copies of another length
            x[i + 1] = x[i] + 0.02 * rng.standard_normal(dim).astype(np.float32)
            x[i + 2], x[i + 3] = x[i], 3 * x[i]
        info.append((d, dim))
        rows += [(d, str(p), len(rows) + i, None if i % 7 == 0 else "s", v.tolist(), "1") for i, (p, v) in enumerate(zip(parts, x))]
    again = [(*r[:5], "2") for r in rows[::9]]
    bad = [("small", "train", 90_000 + i, "s", e, "1") for i, e in enumerate([None, [], [1.0] * 7, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [0.0] * 8, [1.0] * 7 + [None]])]
    bad += [("unknown", "train", 91_000, "s", [1.0], "1"), (None, "train", 91_001, "s", [1.0] * 8, "1"), ("small", None, 91_002, "s", [1.0] * 8, "1"), ("small", "train", None, "s", [1.0] * 8, "1")]
    v = spark.createDataFrame(rows + again + bad, SCHEMA).repartition(4).cache()
    return rows, v, spark.createDataFrame(info + [("empty", None)], "dataset string, dimension int")


def by_dataset(rows):
    for d in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == d]
        yield np.array([r[2] for r in own]), np.array([r[1] for r in own]), unit(np.array([r[4] for r in own], np.float32))


def test_usable(data):
    rows, v, info = data
    got = {r["vec_id"] for r in usable(v, info).collect()}
    assert got == {r[2] for r in rows} | {91_002}


@pytest.mark.parametrize("shard,block", [(32768, 32768), (50, 70)])
def test_overlaps(data, shard, block):
    rows, v, info = data
    got = {(r["train_id"], r["eval_id"]): r for r in O.overlaps(usable(v, info), shard=shard, block=block).collect()}
    want = set()
    for ids, part, x in by_dataset(rows):
        s = np.round(x @ x.T, 6)
        want |= {(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(s >= 0.995)) if part[i] == "train" and part[j] != "train"}
    assert set(got) == want and len(want) > 10
    assert all(r["spans"] >= 1 and O.MATCH <= r["letters"] <= O.LETTERS for r in got.values())
    assert all(r["letters"] == O.LETTERS and r["spans"] == 1 for r in got.values() if r["cosine"] == 1)
    assert O.overlaps(usable(v, info).limit(0)).count() == 0


def maximal(a, b, match, stride):
    """Maximal runs of equal letters that hold a window, by looking at every letter."""
    out, at = [], 0
    while at < len(a):
        end = at
        while end < len(a) and a[end] == b[end]:
            end += 1
        if any(e - match >= at for e in range(match, end + 1, stride)):
            out.append((at, end))
        at = end + 1
    return out


@pytest.mark.parametrize("match,stride", [(6, 1), (8, 4), (24, 12)])
def test_index_finds_all_maximal_matches(match, stride):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2, (40, 70)).astype(np.uint8), rng.integers(0, 2, (150, 70)).astype(np.uint8)
    b[:30] = a[:30]
    for _ in range(3):
        b[np.arange(20), rng.integers(0, 70, 20)] ^= 1
    index = O.TextIndex.from_bytes(O.build_index(b, match, stride).to_bytes())
    got = sorted(zip(*map(np.ndarray.tolist, O.maximal_matches(index, a, match, stride))))
    want = [(i, j, s, e) for i in range(40) for j in range(150) for s, e in maximal(a[i], b[j], match, stride)]
    assert got == want and len(got) > 20
    assert not len(O.maximal_matches(index, a[:0], match, stride)[0])


def test_spans_are_those_of_brute_force(data):
    rows, v, info = data
    unit_of = {r[2]: unit(np.array([r[4]], np.float32)) for r in rows}
    for r in O.overlaps(usable(v, info), shard=50, block=70).collect():
        a, b = (O.texts(unit_of[r[c]])[0] for c in ("train_id", "eval_id"))
        found = maximal(a, b, O.MATCH, O.STRIDE)
        assert (r["spans"], r["letters"]) == (len(found), sum(e - s for s, e in found))


def true_neighbours(rows, k):
    out = {}
    for ids, part, x in by_dataset(rows):
        s = np.round(x @ x.T, 6)
        for i in range(len(ids)):
            order = sorted((-s[i, j], int(ids[j])) for j in range(len(ids)) if part[j] == "train" and j != i)
            out[int(ids[i])] = [v for _, v in order[:k]]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("vec_id", df.cosine.desc(), "neighbour").collect():
        out.setdefault(r["vec_id"], []).append(r["neighbour"])
    return out


def test_small_datasets_are_exact(data):
    rows, v, info = data
    assert lists(N.neighbours(v, info, 5)) == {q: n for q, n in true_neighbours(rows, 5).items() if n}


@pytest.mark.parametrize("cell,window", [(250, 60), (100_000, 60), (130, 100)])
def test_windows_across_partitions_find_most(data, cell, window):
    rows, v, info = data
    got = lists(N.neighbours(v, info, 5, cell=cell, window=window))
    want = true_neighbours(rows, 5)
    total = sum(map(len, want.values()))
    assert sum(len(set(got.get(q, [])) & set(n)) for q, n in want.items()) >= 0.95 * total
    assert {q for q in got} == {q for q, n in want.items() if n} and max(map(len, got.values())) <= 5
    assert N.neighbours(v.limit(0), info).count() == 0


@pytest.mark.parametrize("copies", [0, 20, 1000])
def test_groups_of_equal_vectors(data, copies):
    rows, v, info = data
    assert lists(N.neighbours(v, info, 5, copies=copies)) == {q: n for q, n in true_neighbours(rows, 5).items() if n}


def test_many_equal_vectors(spark):
    rows = [("d", "train" if i % 3 else "test", i, "s", [1.0, 2.0], "1") for i in range(300)] + [("d", "train", 500, "s", [2.0, 1.0], "1")]
    got = lists(N.neighbours(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("d", 2)], "dataset string, dimension int")))
    assert got[0] == [1, 2, 4, 5, 7] and got[1] == [2, 4, 5, 7, 8] and got[500] == [1, 2, 4, 5, 7] and len(got) == 301


def test_curve_is_a_hilbert_curve():
    side, dims = 8, 3
    grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = N.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(side**dims))
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()
