"""The first N rows of every group, whatever the sizes of the groups."""

from pyspark.sql import Column, DataFrame

from vecquarry.operators.ordered import positions


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, name: str = "position") -> DataFrame:
    """The rows of df at positions 1..n of their group in the given order, with the position.

    Method: a global range-partitioned sort on group and order; each partition numbers its rows and keeps n of each
    group, which leaves at most n rows per group and partition; counts per partition are prefix-summed to exact
    positions. No task holds a whole group.

    order must end in an identifier, so that ties always fall the same way; rows equal in all of it are kept as
    separate rows in any order. Null keys form a group of their own; nulls in scores sort as the expressions say.
    Groups of fewer rows come out whole; an empty df gives no rows; n below 1 is an error. Columns of df are kept, but
    none may be called `name`.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    if name in df.columns:
        raise ValueError(f"df already has a column {name}")
    placed = positions(df, group, order, name, keep=n)
    return placed.filter(placed[name] <= n)
