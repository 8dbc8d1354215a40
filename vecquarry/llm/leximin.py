"""One ranking from several scores of different scales: leximin over percentiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecquarry.operators.ordered import positions, prefix_sums
from vecquarry.session import materialize, salted_join


def leximin(df: DataFrame, group: list[str], scores: dict[str, int], ties: list[str]) -> DataFrame:
    """df with n (rows of the group), better (per score, in the order of `scores`: rows of the group strictly better),
    worst (the largest of them), percentiles (1 - better / n, ascending) and rank (1-based, in the group).

    Method: each score becomes a percentile within the group; a row's own percentiles are sorted ascending, and rows are
    compared by these vectors lexicographically, the higher first: the weakest score decides before any other is looked
    at. Equal vectors fall by `ties`, ascending. The rows strictly better in a score are counted by running sums over the
    rows in the order of that score, up to the first row alike, so that groups of any size, and any number of equal
    values, spread over all tasks.

    group, ties: columns of df; null group keys make no group and leave no rows. scores: column -> 1 if more is better, -1 if less is. A score that
    is null or NaN counts as worse than any number (all such alike); infinities are ordinary values. Repeated rows are
    ranked one by one. An empty df gives an empty result. Columns of df are kept; those named here must not be in it.
    """
    clash = {"n", "better", "worst", "percentiles", "rank"} & {*df.columns}
    if clash:
        raise ValueError(f"df already has {sorted(clash)}")
    rows = materialize(df.filter(reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in group])).withColumn("__rid", F.monotonically_increasing_id()))
    goods = []
    for i, (c, sign) in enumerate(scores.items()):
        v = F.col(c).cast("double")
        known = v.isNotNull() & ~F.isnan(v)
        # + 0.0 makes one value of -0.0 and 0.0
        goods.append(F.struct(F.lit(i).alias("s"), F.when(known, v * sign + F.lit(0.0)).otherwise(F.lit(None).cast("double")).alias("v")))
    keys = [f"__g{i}" for i in range(len(group))]
    # groups by number from here on; written, so that the numbers stay and Spark knows the table's size
    sizes = rows.groupBy(*[F.col(g).alias(k) for g, k in zip(group, keys)]).agg(F.count("*").alias("n"))
    sizes = materialize(sizes.withColumn("__group", F.monotonically_increasing_id()))
    sized = salted_join(rows.withColumns(dict(zip(keys, map(F.col, group)))), sizes, keys, F.col("__rid")).drop(*keys)
    long = sized.select("__rid", "__group", F.explode(F.array(*goods)).alias("x"))
    long = long.select("__rid", "__group", F.col("x.s").alias("__s"), F.col("x.v").isNull().alias("__none"), F.coalesce("x.v", F.lit(0.0)).alias("__v"))
    order = [F.col("__none").asc(), F.col("__v").desc(), F.col("__rid").asc()]
    ranked = prefix_sums(long, ["__group", "__s"], order, {"__b": F.lit(1).cast("bigint")}, ties=["__none", "__v"])
    per_row = ranked.groupBy("__rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("__s", "__b"))), lambda x: x["__b"]).alias("better"))
    vector = F.sort_array("better", asc=False)
    full = sized.join(per_row, "__rid").withColumns(
        {"worst": F.array_max("better"), "percentiles": F.transform(vector, lambda b: 1 - b / F.col("n")), "__vector": vector}
    )
    order = [*[F.col("__vector")[i].asc() for i in range(len(scores))], *[F.col(t).asc() for t in ties], F.col("__rid")]
    return positions(full, ["__group"], order, "rank").drop("__rid", "__group", "__vector")
