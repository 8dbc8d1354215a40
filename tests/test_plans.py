import json

import pytest

from vecquarry.plans import grid

ALGORITHM = {"name": "x", "image": "i", "module": "m", "constructor": "C"}


def arguments(spark, group, metric="euclidean", **more):
    documents = [{"float": {"any": [ALGORITHM | more | {"run_groups": {"g": group}}]}}]
    d = grid.definitions(grid.specifications(spark, documents), "float", metric, 96, 7)
    return [([json.loads(a) for a in r["arguments"]], [[json.loads(v) for v in q] for q in r["query_arguments"]]) for r in d.collect()]


def test_grids(spark):
    assert [a for a, _ in arguments(spark, {"args": {"M": [4, 8], "ef": 100}})] == [[4, 100], [8, 100]]
    assert [a for a, _ in arguments(spark, {"args": [[1, 2], "k", [3, 4]]})] == [[1, "k", 3], [1, "k", 4], [2, "k", 3], [2, "k", 4]]
    assert [q for _, q in arguments(spark, {"args": [[1]], "query_args": [[[10, 5], [20, 5]]]})] == [[[[10, 5]], [[20, 5]]]]
    assert [q for _, q in arguments(spark, {"args": [[1]], "query_args": [[{"a": 1, "b": 2}, {"a": 3, "b": 4}]]})] == [[[[1, 2]], [[3, 4]]]]
    assert [a for a, _ in arguments(spark, {"arg_groups": [{"M": [4, 8], "L": 2}, [5, 6]]})] == [[{"L": 2, "M": 4}, 5], [{"L": 2, "M": 4}, 6], [{"L": 2, "M": 8}, 5], [{"L": 2, "M": 8}, 6]]
    got = arguments(spark, {"args": ["@dimension", [["@count", "x@count"]]], "query_args": [["@count"]]}, base_args=["@metric"])
    assert got == [(["euclidean", 96, [7, "x@count"]], [["@count"]])]


def test_bad_documents(spark):
    with pytest.raises(TypeError):
        grid.slots_of("text")
    with pytest.raises(ValueError):
        grid.rows_of([{"float": {"any": [{"name": "x", "run_groups": {}}]}}])
    with pytest.raises(ValueError):
        grid.rows_of([{"float": {"any": [ALGORITHM | {"run_groups": {"g": {}}}]}}])


def test_merge_filters_and_resume(spark):
    group = {"g": {"args": [[1, 2, 3]], "query_args": [[10, 20]]}}
    documents = [{"float": {"any": [ALGORITHM | {"run_groups": group}, ALGORITHM | {"name": "y", "gpu": True, "run_groups": group}], "ip": [ALGORITHM | {"disabled": True, "run_groups": {"g": {"args": [[9]]}}}]}}]
    specs = grid.specifications(spark, documents)
    assert {(r["algorithm"], r["disabled"]) for r in grid.definitions(specs, "float", "ip", 8, 1).collect()} == {("x", True), ("y", False)}
    defs = grid.definitions(specs, "float", "euclidean", 8, 1)
    assert grid.chosen(defs).count() == 3 and grid.chosen(defs, gpu=True).count() == 3 and grid.chosen(defs, limit=4).count() + grid.chosen(defs, limit=4, gpu=True).count() == 4
    assert grid.chosen(defs, algorithm="y").count() == 0 and grid.chosen(defs, module="none").count() == 0
    images = spark.createDataFrame([("other",)], "image string")
    assert grid.chosen(defs, available=images).count() == 0 and [r["image"] for r in grid.missing_images(defs, images).collect()] == ["i"]
    runs = grid.runs(grid.chosen(defs), "d", 10)
    assert runs.count() == 6 and grid.unfinished(runs, runs.limit(2)).count() == 4
    assert {(r["algorithm"], r["definitions"], r["evaluations"]) for r in grid.evaluation_counts(defs).collect()} == {("x", 3, 6), ("y", 3, 6)}
    assert {r["name"]: r["metrics"] for r in grid.capabilities(specs).collect()} == {"x": ["any", "ip"], "y": ["any"]}
    assert {r["module"] for r in grid.replaced(defs, module="n").collect()} == {"n"}
    with pytest.raises(TypeError):
        grid.replaced(defs, nothing=1)


def test_documents_on_disk(spark, tmp_path):
    for name, text in (("a", "float: {any: [{name: a, image: i, module: m, constructor: C, run_groups: {g: {args: [[1, .nan]]}}}]}"), ("base", "x: 1"), ("broken", "a: [")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "config.yml").write_text(text)
    assert len(grid.load(str(tmp_path))) == 1
