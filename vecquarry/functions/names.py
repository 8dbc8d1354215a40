"""Names of datasets, runs and parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRIC_NAMES = ["euclidean", "cosine", "ip", "normalized", "hamming"]
POINT_TYPES = ["float", "uint8", "int8", "binary"]


def parse_dataset(name: Column) -> Column:
    """struct(dimension, distance, point_type) of <corpus>-<model>-<dimension>[-<distance>[-<point type>]]; the first
    part of digits only is the dimension; distance and point type default to normalized and float. Without a dimension
    all are null."""
    parts = F.split(name, "-")
    at = F.array_position(F.transform(parts, lambda p: p.rlike("^[0-9]+$")), True)
    found = at > 0
    rest = lambda i, default: F.when(found, F.coalesce(F.get(parts, (at + i - 1).cast("int")), F.lit(default)))
    return F.struct(F.when(found, F.get(parts, (at - 1).cast("int")).cast("int")).alias("dimension"), rest(1, "normalized").alias("distance"), rest(2, "float").alias("point_type"))


def title(name: Column, drop: int = 2) -> Column:
    """The name without its last `drop` parts."""
    parts = F.split(name, "-")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - drop, F.lit(0))), "-")


def slug(text: Column) -> Column:
    """Runs of anything but letters, digits and _ become _, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\W+", "_"), F.lit("_"))


def marker(text: Column) -> Column:
    return F.sha2(text, 256)


def cpu_range(text: Column) -> Column:
    """The sorted set of numbers in a list such as 0-3,8; reversed ranges are turned round."""
    parts = F.filter(F.split(F.regexp_replace(text, r"\s", ""), ","), lambda p: p != "")
    ends = lambda p: F.transform(F.split(p, "-"), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(F.array_min(ends(p)), F.array_max(ends(p)))))))


def whole(x: Column) -> Column:
    """Rounded to no decimals, as text."""
    return F.format_string("%.0f", x.cast("double"))
