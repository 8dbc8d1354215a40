"""The pN_ queries of this package: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecquarry.llm import mixing, neighbours, overlap, quality, quantiles, summaries, tokens, topn, vectors
from vecquarry.llm.leximin import leximin
from vecquarry.session import materialize, table

SCORES = {"qps": 1, "recall": 1, "build_time": -1, "index_size": -1}
PROBABILITIES = [0.5, 0.9, 0.99, 0.999]


def _ranking(spark: SparkSession, d: str) -> DataFrame:
    rows = summaries.sound(table(spark, d, "summary"))
    for c in ("build_time", "index_size"):
        rows = rows.filter(summaries.finite(F.col(c)) & (F.col(c) >= 0))
    return leximin(rows, ["dataset", "k"], SCORES, ["algorithm", "params"])


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(spark, d).select("dataset", "k", "rank", "algorithm", "params", "percentiles", *SCORES)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(spark, d).filter((F.col("n") >= 20) & (F.col("worst") * 10 < F.col("n"))).select("dataset", "k", "algorithm", "params")


def p4_daily(spark: SparkSession, d: str) -> DataFrame:
    """Per day, from sketches that combine: percentiles and the sketch itself."""
    keys = ["dataset", "algorithm", "day"]
    days = quantiles.merge_sketches(quantiles.sketches(quantiles.measured_times(table(spark, d, "detail")), keys, "time"), keys)
    return _named(quantiles.sketch_quantiles(days, keys, PROBABILITIES), keys)


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of all days per dataset and algorithm, combined from the sketches of the days."""
    days = ["dataset", "algorithm", "day"]
    daily = quantiles.merge_sketches(quantiles.sketches(quantiles.measured_times(table(spark, d, "detail")), days, "time"), days)
    return _named(quantiles.sketch_quantiles(quantiles.merge_sketches(daily, days[:2]), days[:2], PROBABILITIES), days[:2])


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, "n", *[F.col("quantiles")[i].alias(f"p{p * 100:g}".replace(".", "_")) for i, p in enumerate(PROBABILITIES)])


def p4_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether the ranks of the combined percentiles are within half a percent of the distance from the top, give or take
    one value: of each percentile, the values below and up to it are counted."""
    times = quantiles.measured_times(table(spark, d, "detail"))
    q = p4_percentiles(spark, d)
    names = [f"p{p * 100:g}".replace(".", "_") for p in PROBABILITIES]
    at = times.withColumn("time", F.col("time").cast("double")).join(q, ["dataset", "algorithm"])
    counted = at.groupBy("dataset", "algorithm", "n").agg(*[F.struct(F.count_if(F.col("time") < F.col(c)).alias("low"), F.count_if(F.col("time") <= F.col(c)).alias("high")).alias(c) for c in names])
    off = lambda p, c: F.greatest(F.lit(0.0), F.col(c)["low"] - p * F.col("n"), p * F.col("n") - F.col(c)["high"])
    return counted.select("dataset", "algorithm", "n", *[(off(p, c) <= 0.005 * (1 - p) * F.col("n") + 1).alias(c) for p, c in zip(PROBABILITIES, names)])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    keys = ["dataset", "algorithm"]
    merged = quantiles.merge_sketches(quantiles.sketches(quantiles.measured_times(table(spark, d, "detail")), keys, "time"), keys)
    q = quantiles.sketch_quantiles(merged, keys, [0.5, 0.99])
    return q.filter((F.col("n") >= 150) & (F.col("quantiles")[1] >= 10 * F.col("quantiles")[0])).select(*keys)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = summaries.sound(table(spark, d, "summary").filter((F.col("k") == 100) & (F.col("recall") >= 0.9)))
    order = [F.col("qps").desc(), F.col("recall").desc(), F.col("params").asc()]
    return topn.top_n(rows.select("dataset", "algorithm", "params", "qps", "recall"), ["dataset", "algorithm"], order, 3).select("dataset", "algorithm", "params")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decode(materialize(tokens.encode(table(spark, d, "documents"))))


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    counted = tokens.token_counts(table(spark, d, "documents"), keep=["source"])
    return mixing.mix(counted, table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).documents


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per source asked for: its documents, and whether its share is reached within its longest document and no document
    is repeated more often than allowed."""
    m = _mixture(spark, d)
    longest = m.documents.groupBy("source").agg(F.max("tokens").alias("longest"))
    s = m.shares.join(longest, "source", "left")
    met = F.abs(F.col("mixed_tokens") - F.col("target_tokens")) <= F.coalesce("longest", F.lit(0))
    return s.select("source", "target_weight", "max_repeats", "docs", met.alias("met"), (F.col("most_copies") <= F.col("max_repeats")).alias("within"))


QUERIES = {f.__name__: f for f in (p1_found, p1_ranking, p4_found, p4_daily, p4_percentiles, p4_bounds, p8_checks, p5_found, p7_ids, p7_decoded, p8_mix, p8_shares)}


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(vectors.usable(table(spark, d, "vectors"), table(spark, d, "dataset_info")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(F.least("train_id", "eval_id").alias("vec_id_a"), F.greatest("train_id", "eval_id").alias("vec_id_b"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Per dataset, part and source: overlapping pairs, and the evaluation vectors and train vectors in them."""
    # a vec_id delivered with several sources counts under the least of them
    sources = table(spark, d, "vectors").groupBy(F.col("vec_id").alias("eval_id")).agg(F.min("source").alias("source"))
    pairs = _overlaps(spark, d).join(sources, "eval_id")
    return pairs.groupBy("dataset", "part", "source").agg(
        F.count("*").alias("pairs"), F.count_distinct("eval_id").alias("eval_vectors"), F.count_distinct("train_id").alias("train_vectors"),
        F.count_if(F.col("cosine") == 1).alias("same"),
    )


def p2_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every overlapping pair with the number and the letters of the maximal matches of its texts."""
    return _overlaps(spark, d)


QUERIES |= {f.__name__: f for f in (p2_found, p2_report, p2_spans)}


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbours(table(spark, d, "vectors"), table(spark, d, "dataset_info"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_neighbours(spark, d).select(F.least("vec_id", "neighbour").alias("vec_id_a"), F.greatest("vec_id", "neighbour").alias("vec_id_b")).distinct()


QUERIES |= {f.__name__: f for f in (p3_found, p3_neighbours)}


def p9_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(table(spark, d, "documents"), table(spark, d, "common_words"))


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The plain figures of every document."""
    q = quality.document_statistics(table(spark, d, "documents"), table(spark, d, "common_words"))
    return q.select("doc_id", "words", *[F.round(c, 9).alias(c) for c in ("mean_word_length", "symbol_ratio", "ending_share", "common_share")])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_quality(spark, d).filter(F.col("form") != "prose").select("doc_id")


QUERIES |= {f.__name__: f for f in (p9_found, p9_quality, p9_statistics)}
