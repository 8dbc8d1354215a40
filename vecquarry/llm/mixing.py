"""A mixture of sources with target shares of all tokens: entropy balancing by distributed Newton steps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecquarry.operators.ordered import prefix_sums
from vecquarry.session import materialize

#: Fractions of copies are counted in units of 2**-BITS, so that running sums are exact.
BITS = 20


@dataclass
class Mixture:
    #: (doc_id, source, tokens, rate, copies) of every document of the sources asked for.
    documents: DataFrame
    #: (source, target_weight, max_repeats, docs, available_tokens, target_tokens, mixed_tokens, share, most_copies)
    shares: DataFrame


def token_goals(weights: np.ndarray, caps: np.ndarray, budget: float | None) -> np.ndarray:
    """Tokens to take from each source, caps being the most it can give. Without a budget: the most for which every
    source that has any tokens keeps its exact share. With one: full sources give all they can, and the others share the
    rest by weight."""
    live = (caps > 0) & (weights > 0)
    goals = np.zeros(len(weights))
    if not live.any():
        return goals
    w = np.where(live, weights, 0) / weights[live].sum()
    if budget is None:
        return w * np.min(caps[live] / w[live])
    full = np.zeros(len(w), bool)
    while True:
        rest, free = budget - caps[full].sum(), live & ~full
        goals = np.where(full, caps, np.where(free, w / max(w[free].sum(), 1e-300) * max(rest, 0), 0))
        more = free & (goals >= caps)
        if not more.any():
            return np.minimum(goals, caps)
        full |= more


def mix(docs: DataFrame, targets: DataFrame, budget: float | None = None, steps: int = 60, seed: int = 42) -> Mixture:
    """Copies per document such that each source has its target weight of all tokens, as far as max_repeats allows.

    docs: (doc_id, source, tokens); targets: (source, target_weight, max_repeats), a parameter of few rows, held on the
    driver with one multiplier a source. Method: rates of minimal relative entropy to one copy each, under a token
    constraint per source and a cap on each document, are min(cap, exp(multiplier * tokens / mean tokens)); the
    multipliers solve the convex dual by safeguarded Newton steps, whose gradient and curvature are sums over the
    distinct (source, tokens). Rates become copies by systematic rounding along (tokens, hash of doc_id), which leaves a
    source off its goal by at most its longest document; one document per source then closes most of that.

    budget: tokens of the mixture; None takes the most for which all shares are met. Documents without tokens (null or
    empty texts) get no copies; null sources and those not asked for are left out; sources without tokens get nothing and
    the others share their weight. Repeated rows are documents of their own. Weights need not sum to 1; null or negative
    ones, caps below 1 and sources named twice are errors. Empty docs give no documents and shares of null.
    """
    goals = [(r["source"], r["target_weight"], r["max_repeats"]) for r in targets.select("source", "target_weight", "max_repeats").collect()]
    if len({g[0] for g in goals}) < len(goals) or any(g[0] is None or g[1] is None or not g[1] >= 0 or g[2] is None or g[2] < 1 for g in goals):
        raise ValueError("targets need distinct sources, weights of 0 or more and max_repeats of 1 or more")
    spark = docs.sparkSession
    goals.sort()
    names = [g[0] for g in goals]
    weights, repeats = np.array([float(g[1]) for g in goals]), np.array([float(g[2]) for g in goals])
    used = materialize(docs.select("doc_id", "source", F.col("tokens").cast("bigint").alias("tokens")).filter(F.col("source").isin(names)))
    cells = materialize(used.groupBy("source", "tokens").agg(F.count("*").alias("docs")))
    sums = {r["source"]: r for r in cells.groupBy("source").agg(F.sum(F.col("docs") * F.col("tokens")).alias("t"), F.sum(F.when(F.col("tokens") > 0, F.col("docs"))).alias("n")).collect()}
    total = np.array([float(sums[s]["t"] or 0) if s in sums else 0.0 for s in names])
    mean = np.array([sums[s]["t"] / sums[s]["n"] if s in sums and sums[s]["n"] else 1.0 for s in names])
    goal = token_goals(weights, repeats * total, budget)
    full, none = goal >= repeats * total * (1 - 1e-12), goal <= 0

    def parameters(multipliers: np.ndarray) -> DataFrame:
        rows = [(s, float(c), float(m), float(x)) for s, c, m, x in zip(names, repeats, mean, multipliers)]
        return F.broadcast(spark.createDataFrame(rows, "source string, cap double, mean double, multiplier double"))  # a row per target

    x = F.col("tokens") / F.col("mean")
    tilted = F.exp(F.least(F.col("multiplier") * x, F.lit(600.0)))
    rate: Column = F.when(F.col("tokens") <= 0, 0.0).otherwise(F.least(F.col("cap"), tilted))

    at = np.where(total > 0, np.log(np.maximum(goal, 1e-300) / np.maximum(total, 1e-300)), 0.0)
    low, high = np.full(len(names), -700.0), np.full(len(names), 700.0)
    open_ = ~full & ~none
    for _ in range(steps):
        if not open_.any():
            break
        moved = cells.join(parameters(at), "source").select("source", "docs", "tokens", x.alias("x"), rate.alias("r"), (F.col("cap") > tilted).alias("inner"))
        got = {
            r["source"]: (r["g"], r["h"])
            for r in moved.groupBy("source").agg(F.sum(F.col("docs") * F.col("r") * F.col("tokens")).alias("g"), F.sum(F.when(F.col("inner"), F.col("docs") * F.col("r") * F.col("x") * F.col("tokens")).otherwise(0.0)).alias("h")).collect()
        }
        for i in np.flatnonzero(open_):
            g, h = got[names[i]]
            if abs(g - goal[i]) <= 1e-9 * goal[i]:
                open_[i] = False
                continue
            low[i], high[i] = (at[i], high[i]) if g < goal[i] else (low[i], at[i])
            newton = at[i] - (g - goal[i]) / h if h > 0 else np.nan
            at[i] = newton if low[i] < newton < high[i] else (low[i] + high[i]) / 2
    at = np.where(full, 700.0 * mean.max(initial=1.0), np.where(none, -np.inf, at))
    rated = used.join(parameters(np.where(np.isinf(at), -1e300, at)), "source").select(
        "doc_id", "source", "tokens", F.when(F.col("multiplier") >= 700.0, F.when(F.col("tokens") > 0, F.col("cap")).otherwise(0.0)).otherwise(rate).alias("rate")
    )
    units = F.round(F.col("rate") * (1 << BITS)).cast("bigint")
    base = F.shiftright(units, BITS)
    rest = units - F.shiftleft(base, BITS)
    order = [F.col("tokens").asc(), F.xxhash64("doc_id", F.lit(seed)).asc(), F.col("doc_id").asc()]
    summed = prefix_sums(rated, ["source"], order, {"__upto": rest, "__at": F.lit(1).cast("bigint")})
    half = 1 << (BITS - 1)
    copies = base + F.shiftright(F.col("__upto") + half, BITS) - F.shiftright(F.col("__upto") - rest + half, BITS)
    rounded = summed.select("doc_id", "source", "tokens", "rate", copies.cast("int").alias("copies"), "__at")
    # What a source is off by is less than its longest document: one copy more or less of the document that comes
    # nearest to it, where that helps. One row per source.
    off = rounded.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("got")).collect()
    short = spark.createDataFrame([(s, float(g - r["got"]), int(c)) for r in off for s, g, c in zip(names, goal, repeats) if s == r["source"]], "source string, short double, cap int")
    more = F.col("short") > 0
    can = F.when(more, F.col("copies") < F.col("cap")).otherwise(F.col("copies") > 0)
    left_over = F.abs(F.abs("short") - F.col("tokens"))
    helps = can & (F.col("tokens") > 0) & (left_over < F.abs("short"))
    fix = rounded.join(F.broadcast(short), "source").filter(helps).groupBy("source").agg(F.min_by(F.struct("__at", F.when(more, 1).otherwise(-1).alias("by")), F.struct(left_over, "__at")).alias("f"))
    fix = F.broadcast(fix.select("source", "f.__at", "f.by"))
    documents = rounded.join(fix, ["source", "__at"], "left").select("doc_id", "source", "tokens", "rate", (F.col("copies") + F.coalesce("by", F.lit(0))).alias("copies"))
    taken = documents.groupBy("source").agg(
        F.count("*").alias("docs"), F.sum("tokens").alias("available_tokens"), F.sum(F.col("copies") * F.col("tokens")).alias("mixed_tokens"), F.max("copies").alias("most_copies")
    )
    asked = spark.createDataFrame([(s, float(w), int(c), float(g)) for s, w, c, g in zip(names, weights, repeats, goal)], "source string, target_weight double, max_repeats int, target_tokens double")
    whole = taken.agg(F.sum("mixed_tokens").alias("__all"))
    shares = asked.join(taken, "source", "left").crossJoin(whole).select(
        "source", "target_weight", "max_repeats", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), "target_tokens",
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), (F.coalesce("mixed_tokens", F.lit(0)) / F.col("__all")).alias("share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
    return Mixture(documents, shares)
