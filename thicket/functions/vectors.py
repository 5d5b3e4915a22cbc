"""Distances between vectors, in double precision. Smaller is nearer.

cosine: 1 - dot / (|a| |b|), and 1 where a norm is 0; l2: the squared Euclidean distance; ip: the
negated inner product. Vectors of another length are infinitely far.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "ip")
LARGEST_DIMENSION = 4096


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def distance(a: Column, b: Column, metric: str) -> Column:
    """a, b: arrays of double."""
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}")
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    if metric == "ip":
        found = -dot
    elif metric == "l2":
        found = _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
    else:
        norms = F.sqrt(_sum(F.transform(a, lambda x: x * x))) * F.sqrt(_sum(F.transform(b, lambda x: x * x)))
        found = F.when(norms == 0.0, 1.0).otherwise(1.0 - dot / norms)
    return F.when(F.size(a) == F.size(b), found).otherwise(F.lit(float("inf")))


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def literal(vector: list[float]) -> Column:
    if not 1 <= len(vector) <= LARGEST_DIMENSION:
        raise ValueError(f"a vector has 1 to {LARGEST_DIMENSION} components")
    return F.array(*(F.lit(float(x)) for x in vector))


def decode(raw: bytes) -> list[float]:
    """A vector carried as little-endian 32-bit floats."""
    if len(raw) % 4:
        raise ValueError("not whole 32-bit floats")
    return list(struct.unpack(f"<{len(raw) // 4}f", raw))


def decoded(raw: Column) -> Column:
    """The same for a binary column, as an array of double; null where the length does not fit.

    A 32-bit float's bits are its sign, exponent and fraction, so arithmetic on them gives its value.
    """
    bits = F.transform(
        F.sequence(F.lit(0), (F.octet_length(raw) / 4).cast("int") - 1),
        lambda i: F.conv(F.hex(_reversed4(raw, i)), 16, 10).cast("bigint"),
    )

    def value(u: Column) -> Column:
        sign = F.when(F.shiftright(u, 31) == 1, -1.0).otherwise(1.0)
        exponent, fraction = F.shiftright(u, 23) % 256, (u % (1 << 23)).cast("double")
        normal = (F.lit(1.0) + fraction / float(1 << 23)) * F.pow(F.lit(2.0), exponent.cast("double") - 127.0)
        tiny = fraction * F.lit(2.0**-149)
        odd = F.when(fraction == 0.0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
        return sign * F.when(exponent == 255, odd).when(exponent == 0, tiny).otherwise(normal)

    whole = (F.octet_length(raw) > 0) & (F.octet_length(raw) % 4 == 0)
    return F.when(whole, F.transform(bits, value))


def _reversed4(raw: Column, i: Column) -> Column:
    at = i.cast("int") * 4
    return F.concat(*(F.substring(raw, at + k, F.lit(1)) for k in (4, 3, 2, 1)))
