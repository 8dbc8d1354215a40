"""Vector functions as Column expressions: metrics, normalization, quantization, bit packing.

Arrays are cast to double before sums; sums run left to right, so results do not depend on partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(a: Column) -> Column:
    return a.cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine, within [0, 2]; null if a vector is zero."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(a, b) / size)))


def inner_product(a: Column, b: Column) -> Column:
    """The negated product: smaller is closer."""
    return -dot(a, b)


def normalized(a: Column, b: Column) -> Column:
    """Cosine distance of vectors that have length 1 already."""
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(a, b)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of packed bytes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x).cast("double")


#: Metric name -> distance of two array columns; smaller is closer in each.
METRICS = {"euclidean": euclidean, "cosine": cosine, "ip": inner_product, "normalized": normalized, "hamming": hamming}


def metric(name: str):
    try:
        return METRICS[name]
    except KeyError:
        raise ValueError(f"unknown metric {name}; there are {', '.join(METRICS)}") from None


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, however often it is used, within lambdas too."""
    return F.transform(F.array(value), use)[0]


def _over(a: Column, size: Column, zero: Column | None = None) -> Column:
    """a / size, element by element, size being computed once a row; zero: what a size of 0 gives."""
    both = F.struct(_doubles(a).alias("a"), size.alias("size"))
    divided = lambda s: F.transform(s["a"], lambda x: x / s["size"])
    return _once(both, divided if zero is None else lambda s: F.when(s["size"] == 0, zero).otherwise(divided(s)))


def l2_normalize(a: Column, least: float = 1e-12) -> Column:
    return _over(a, F.greatest(norm(a), F.lit(least)))


def normalize(a: Column) -> Column:
    """Length 1; a zero vector becomes the diagonal."""
    d = F.size(a)
    return _over(a, norm(a), F.array_repeat(1 / F.sqrt(d.cast("double")), d))


def reduce_dimension(a: Column, dim: int) -> Column:
    """The first dim components of the normalized vector, normalized again."""
    return _once(F.slice(normalize(a), 1, dim), normalize)


def layer_norm(a: Column, eps: float = 1e-5) -> Column:
    d = F.size(a)
    centred = lambda s: F.transform(s["a"], lambda x: x - s["mean"])
    spread = lambda c: F.sqrt(dot(c, c) / F.size(c) + eps)
    mean = F.struct(_doubles(a).alias("a"), (total(_doubles(a)) / d).alias("mean"))
    return _once(_once(mean, centred), lambda c: _over(c, spread(c)))


def quantize_uint8(a: Column, low: Column, high: Column) -> Column:
    """Truncated to 0..255 of the span per dimension; values outside the span are clamped, an empty span gives 0."""
    spans = F.arrays_zip(low.alias("low"), high.alias("high"))
    step = lambda s: (s["high"] - s["low"]) / 255
    one = lambda x, s: F.when(step(s) > 0, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (x - s["low"]) / step(s))))).otherwise(0).cast("int")
    return F.zip_with(_doubles(a), spans, one)


def quantize_int8(a: Column, largest: Column) -> Column:
    """Rounded half to even to -127..127 of the largest absolute value per dimension; an empty span counts as 127."""
    step = lambda m: F.when(m > 0, m / 127).otherwise(1.0)
    return F.zip_with(_doubles(a), largest, lambda x, m: F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(x / step(m)).cast("int"))))


def pack_bits(a: Column) -> Column:
    """Bytes of x > 0, eight to a byte, the first in the highest bit; the last byte is filled with zeros."""
    bits = F.transform(_doubles(a), lambda x: F.when(x > 0, 1).otherwise(0))
    filled = F.concat(bits, F.array_repeat(F.lit(0), F.pmod(-F.size(a), F.lit(8)).cast("int")))
    starts = F.sequence(F.lit(1), F.size(filled), F.lit(8))
    return F.transform(starts, lambda i: F.aggregate(F.slice(filled, i, F.lit(8)), F.lit(0), lambda s, b: s * 2 + b))


def unpack_bits(a: Column) -> Column:
    """The bits of an array of bytes as doubles, highest first."""
    return F.flatten(F.transform(a, lambda b: F.array(*[F.getbit(b.cast("bigint"), F.lit(7 - i)).cast("double") for i in range(8)])))


def gaussian_kernel(x: Column, center: Column, width: float) -> Column:
    z = (x - center) / width
    return F.exp(-0.5 * z * z) / (width * math.sqrt(2 * math.pi))
