"""Vector columns: validity, normalisation, dot products, packing."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid(v: Column, size: int) -> Column:
    finite = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))) & x.isNotNull())
    return F.coalesce((F.size(v) == size) & finite, F.lit(False))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """Unit length; an empty, non-finite or zero vector is an error."""
    n = norm(v)
    ok = (F.size(v) > 0) & ~F.isnan(n) & (n > 0) & (n < F.lit(float("inf")))
    return F.when(ok, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.raise_error(F.lit("vector without a direction")).cast("array<double>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def unit(values: list[float]) -> list[float]:
    n = math.sqrt(math.fsum(x * x for x in values))
    if not values or not math.isfinite(n) or n == 0:
        raise ValueError("vector without a direction")
    return [x / n for x in values]


def pack(values: list[float]) -> bytes:
    return struct.pack(f"<{len(values)}f", *values)


def unpack(raw: bytes, size: int) -> list[float]:
    if len(raw) != 4 * size:
        raise ValueError("vector of another size")
    return list(struct.unpack(f"<{size}f", raw))
