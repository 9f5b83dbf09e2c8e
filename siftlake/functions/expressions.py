"""Column expressions that Spark lacks: Morton keys, IPv4 integers, JSON paths, order-independent digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled(col: Column, low, high, bits: int = 16) -> Column:
    """col mapped linearly from [low, high] to integers of so many bits; a null maps to 0."""
    top = (1 << bits) - 1
    part = (col.cast("double") - F.lit(float(low))) / F.lit(float(max(high - low, 1)))
    return F.coalesce(F.least(F.greatest(F.floor(part * top), F.lit(0)), F.lit(top)), F.lit(0)).cast("long")


def morton(cols: list[Column], bits: int = 16) -> Column:
    """The bits of all cols interleaved, lowest first: a z-order key of len(cols) * bits bits."""
    if len(cols) * bits > 63:
        raise ValueError("a z-order key has 63 bits at most")
    terms = [
        F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), b * len(cols) + k)
        for b in range(bits) for k, c in enumerate(cols)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), terms)


def ipv4(col: Column, bounded: bool = True) -> Column:
    """Dotted address as a long; null unless it has four parts of 0 to 255. bounded=False takes four whole numbers of any size."""
    parts = F.split(col, r"\.")
    numbers = [F.get(parts, F.lit(i)).try_cast("long") for i in range(4)]
    good = reduce(lambda a, b: a & b, [n.between(0, 255) if bounded else n.isNotNull() for n in numbers], F.size(parts) == 4)
    return F.when(good, reduce(lambda a, n: a * 256 + n, numbers))


def row_digest(*cols: Column) -> Column:
    """Aggregate: an order-independent digest of rows, the same for any partitioning: count, sum and xor of row hashes."""
    h = F.xxhash64(*cols)
    return F.concat_ws(":", F.count(F.lit(1)), F.sum(F.pmod(h, F.lit(2147483647))), F.bit_xor(h))
