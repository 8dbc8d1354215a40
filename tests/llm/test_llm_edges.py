"""Clashing names, nulls, repeats, very long texts and empty tables, for every operator dealt with."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecquarry.llm import mixing, neighbours, overlap, quality, quantiles, tokens, topn
from vecquarry.llm.leximin import leximin
from vecquarry.llm.vectors import usable


def clashing(df, names):
    return df.withColumns({n: F.lit("clash") for n in names if n not in df.columns})


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(2).standard_normal((90, 6))
    rows = [("d", ("train", "train", "test")[i % 3], i, v.tolist()) for i, v in enumerate(x)] + [("d", "test", 200, x[0].tolist()), (None, None, None, None), ("d", "train", 0, x[0].tolist())]
    return spark.createDataFrame(rows, "dataset string, part string, vec_id bigint, embedding array<double>"), spark.createDataFrame([("d", 6), (None, 6), ("e", None)], "dataset string, dimension int")


def test_vectors(vectors):
    v, info = vectors
    odd = clashing(v, ["curve", "key", "h", "h2", "train", "window", "cell", "block", "shard", "own", "curves", "near", "edge", "cosine", "neighbour", "dimension"])
    info = clashing(info, ["n", "source", "vec_id"])
    plain = {tuple(r) for r in neighbours.neighbours(v, info).collect()}
    assert {tuple(r) for r in neighbours.neighbours(odd, info).collect()} == plain and len(plain) == 91 * 5
    pairs = overlap.overlaps(usable(odd, info)).collect()
    assert {(r["train_id"], r["eval_id"]) for r in pairs} == {(0, 200)}
    assert neighbours.neighbours(odd.limit(0), info).count() == 0 and overlap.overlaps(usable(odd, info).filter("part = 'train'")).count() == 0


def test_texts(spark):
    long = "Some words, again and again. " * 120_000
    docs = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "a" * 200_000), (5, " \n"), (5, " \n")], "doc_id bigint, text string")
    odd = clashing(docs, ["chunk", "codes", "word", "code", "lines", "statistics", "counts", "filled", "tokens", "ids", "words", "form", "doc"])
    ids = {r["doc_id"]: r["ids"] for r in tokens.encode(odd).collect()}
    assert ids[2] == ids[3] == [] and len(ids) == 5
    decoded = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(odd.dropDuplicates(["doc_id"]))).collect()}
    assert decoded[1] == long and decoded[4] == "a" * 200_000
    counted = {r["doc_id"]: r["tokens"] for r in tokens.token_counts(odd).collect()}
    assert counted == {k: len(v) for k, v in ids.items()}
    common = clashing(spark.createDataFrame([("and",), (None,)], "word string"), ["text", "doc_id"])
    judged = {r["doc_id"]: r for r in quality.quality(odd, common).collect()}
    assert judged[1]["words"] == 600_000 and judged[4]["form"] != "prose" and judged[2]["form"] is judged[5]["form"] is None and len(judged) == 5


def test_times(spark):
    columns = "dataset string, query_index bigint, k int, algorithm string, params string, time float, recall double, build_time double, index_size double, measured_at timestamp_ntz"
    rows = [("d", i, 10, None if i % 2 else "a", None, 1.0 + i, None, None, None, None if i % 5 == 0 else datetime(2025, 1, 1 + i % 3)) for i in range(40)] + [(None,) * 10]
    odd = clashing(spark.createDataFrame(rows, columns), ["day", "n", "sketch", "__part", "__parts", "__rest"])
    times = quantiles.measured_times(odd, part_rows=7)
    assert times.count() == 40 and times.filter("algorithm IS NULL").count() == 20
    merged = quantiles.merge_sketches(quantiles.sketches(times, ["dataset", "algorithm"], "time"), ["dataset", "algorithm"])
    got = {r["algorithm"]: r["quantiles"][0] for r in quantiles.sketch_quantiles(merged, ["dataset", "algorithm"], [0.5]).collect()}
    assert got == {"a": 19.0, None: 20.0}
    assert quantiles.measured_times(odd.limit(0)).count() == 0


def test_rankings(spark):
    rows = [("g", float(i % 4), None, f"i{i}") for i in range(12)] + [(None, 1.0, 1.0, "x"), ("g", None, None, None)]
    odd = clashing(spark.createDataFrame(rows, "g string, a double, b double, item string"), ["s", "v", "x", "salt", "position"])
    ranked = leximin(odd, ["g"], {"a": 1, "b": -1}, ["item"])
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 14)) and {r["a"] for r in ranked.filter("rank <= 3").collect()} == {3.0}
    best = topn.top_n(odd.drop("position"), ["g"], [F.col("a").desc_nulls_last(), F.col("item").asc_nulls_last()], 2)
    assert {(r["g"], r["item"]) for r in best.collect()} == {("g", "i11"), ("g", "i3"), (None, "x")}


def test_mixtures(spark):
    docs = spark.createDataFrame([(i, "s" if i % 3 else None, None if i == 1 else i) for i in range(30)], "doc_id bigint, source string, tokens bigint")
    odd = clashing(docs, ["rate", "copies", "cap", "mean", "x", "docs", "multiplier"])
    m = mixing.mix(odd, clashing(spark.createDataFrame([("s", 1.0, 2)], "source string, target_weight double, max_repeats int"), ["tokens", "docs"]))
    assert m.shares.first()["share"] == 1.0 and m.documents.filter("copies < 0 OR copies > 2").count() == 0
