import itertools
import json
from datetime import datetime, timedelta

import numpy as np

from vecquarry.operators import drift

SCHEMA = "file_id bigint, dataset string, algorithm string, written_at timestamp_ntz, arrived_at timestamp_ntz, body string, qps double"
FIELDS = {"best_qps": "max", "best_search_time": "min", "recalls": "list"}
T0 = datetime(2025, 1, 1)


def table(spark, bodies, series=lambda i: ("d", "a")):
    rows = [(i, *series(i), T0 + timedelta(hours=i), T0 + timedelta(days=1 + i), b if b is None or isinstance(b, str) else json.dumps(b), 1.0) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, SCHEMA)


def changes(d):
    return {(r["file_id"], r["field"], r["change"]) for r in d.changes.collect()}


def test_changes(spark):
    bodies = [
        {"best_qps": 100.0, "recalls": [9, 10], "worst_qps": 3.0},
        {"bestQps": 110.0, "recalls": None, "worst_qps": 4.0},  # 1: renamed
        None,
        "",
        "[1]",
        '{"best_qps": 1',
        {"bestQps": "120.5", "recalls": ["9", "8"], "best_search_time": 0.01},  # 6: retyped twice, added
        {"timing": {"best_search_time": [0.01, 0.02]}, "recalls": []},  # 7: removed, renamed and retyped
        {"queries_per_second_best": 99, "recall_list": "9 8", "best_search_time_ms": 12.0},  # 8
    ]
    want = {(1, "best_qps", "renamed"), (6, "best_qps", "retyped"), (6, "recalls", "retyped"), (6, "best_search_time", "added"), (7, "best_qps", "removed"), (7, "best_search_time", "renamed"), (7, "best_search_time", "retyped")}
    want |= {(8, "best_qps", "added"), (8, "recalls", "renamed"), (8, "recalls", "retyped"), (8, "best_search_time", "renamed"), (8, "best_search_time", "retyped")}
    once = table(spark, bodies)
    d = drift.drift(once.unionAll(once), FIELDS)
    assert changes(d) == want
    unified = {r["file_id"]: r for r in d.unified.collect()}
    assert set(unified) == {0, 1, 6, 7, 8}
    assert unified[6]["best_qps"] == 120.5 and unified[6]["recalls"] == [9.0, 8.0] and unified[1]["recalls"] == []
    assert unified[7]["best_search_time"] == 0.01 and abs(unified[8]["best_search_time"] - 0.012) < 1e-12


def test_added_again_forgets_the_type(spark):
    bodies = [{"best_qps": 1}, {"x": 1}, {"best_qps": "2"}, {"best_qps": None}, {"best_qps": 3}]
    assert changes(drift.drift(table(spark, bodies), FIELDS)) == {(1, "best_qps", "removed"), (2, "best_qps", "added"), (4, "best_qps", "retyped")}


def test_series_null_keys_and_empty_table(spark):
    bodies = [{"best_qps": 1}, {"best_qps": "1"}, {"best_qps": 1}, {"best_qps": "1"}]
    apart = drift.drift(table(spark, bodies, lambda i: (None if i % 2 else "d", "a")), FIELDS)
    assert changes(apart) == set()
    none = drift.drift(table(spark, bodies).limit(0), FIELDS)
    assert none.changes.count() == 0 and none.unified.count() == 0


def test_another_field_of_a_like_name_is_none(spark):
    bodies = [{"best_qps": 100.0 + i, "worst_qps": float(i), "recall_k": 5, "recalls": [1]} for i in range(20)] + [{"worst_qps": 1.0, "recall_k": 5}]
    assert changes(drift.drift(table(spark, bodies), FIELDS)) == {(20, "best_qps", "removed"), (20, "recalls", "removed")}


def test_names_are_matched_between_versions(spark):
    # throughput shares no word with best_qps, but takes its place again and again, with like values
    bodies = [{("best_qps" if i // 5 % 2 else "throughput"): 100.0 + i % 7, "host": f"h{i}", **({"load": 0.01 * i} if i % 3 else {})} for i in range(80)]
    d = drift.drift(table(spark, bodies), FIELDS)
    assert {(c, p) for c, p in d.columns.select("column", "path").collect()} == {("best_qps", "best_qps"), ("best_qps", "throughput"), ("host", "host"), ("load", "load")}
    assert changes(d) == {(i, "best_qps", "renamed") for i in range(5, 80, 5)}
    first = d.unified.filter("file_id = 1").first()
    assert first["best_qps"] == 101.0 and first["others"] == {"host": '"h1"', "load": "0.01"}


def test_columns_keep_apart_what_stands_together():
    files = {"a": 50, "b": 40, "c": 30, "d": 5}
    links = [("a", "b", 9), ("b", "c", 4), ("a", "d", 1)]
    assert drift.columns_of(files, links, {("a", "c"): 20}) == {"a": "a", "b": "a", "c": "c", "d": "a"}


def test_names():
    for n in ("BestQPS", "best-qps", "attrs.bestQps", "qps_best", "best_queries_per_second", "BEST QPS"):
        assert drift.name_similarity("best_qps", n) == 1.0
    assert 0.5 < drift.name_similarity("recalls", "recall_per_query") < 1 and drift.name_similarity("best_qps", "dataset") == 0


def test_types():
    assert [drift.type_of(v) for v in (None, [], [None], 1, 1.5, "x", True, [1, 2.0], ["a"], [1, "a"])] == [None, None, None, "number", "number", "string", "boolean", "array of numbers", "array of strings", "array of numbers and strings"]
    assert drift.parse_object('{"a": NaN}') is None and drift.parse_object('{"a": 1, "a": 2}') == {"a": 2}


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in itertools.product((1, 2, 3), (1, 2, 4)):
        for _ in range(20):
            gain = rng.integers(-2, 6, (n, m)).astype(float)
            got = drift.assign(gain)
            used = [j for j in got if j >= 0]
            assert len(set(used)) == len(used)
            best = max(sum(gain[i, j] for i, j in enumerate(p) if j < m and gain[i, j] > 0) for p in itertools.permutations(range(m + n), n))
            assert sum(gain[i, j] for i, j in enumerate(got) if j >= 0) == best
