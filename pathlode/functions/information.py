"""Information measures as aggregate expressions over counts, and as plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(count: Column) -> Column:
    """Shannon entropy in bits of a distribution given by counts (one row a value).

    log2(N) - sum(c log2 c) / N needs no total beforehand: one aggregation, no window.
    """
    total = F.sum(count)
    return F.greatest(F.lit(0.0), F.log2(total) - F.sum(count * F.log2(count)) / total)


def normalized_entropy(count: Column) -> Column:
    """Entropy over log2 of the number of values; 0 with one value at most."""
    n = F.count(count)
    return F.when(n > 1, F.least(F.lit(1.0), entropy(count) / F.log2(n))).otherwise(F.lit(0.0))


def max_rarity(count: Column) -> Column:
    """Self-information of the rarest value."""
    return F.log2(F.sum(count)) - F.log2(F.min(count))


def renyi(count: Column, order: float) -> Column:
    """Renyi entropy of the given order, the limits 0, 1 and infinity included."""
    if order == 0:
        return F.log2(F.count(count))
    if order == 1:
        return entropy(count)
    if order == float("inf"):
        return F.log2(F.sum(count)) - F.log2(F.max(count))
    return (F.log2(F.sum(F.pow(count, F.lit(order)))) - order * F.log2(F.sum(count))) / (1 - order)


def rarity(count: Column, total: Column) -> Column:
    """Self-information of one value in bits."""
    return F.log2(total) - F.log2(count)


def modified_z(x: Column, median: Column, mad: Column) -> Column:
    """0.6745 (x - median) / MAD; 0 where MAD is 0."""
    return F.when(mad > 0, 0.6745 * (x - median) / mad).otherwise(F.lit(0.0))


def wilson_lower(hits: Column, total: Column, z: float = 1.959963984540054) -> Column:
    """Lower end of the Wilson interval of a share; 0 without observations."""
    p = hits / total
    spread = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total))
    return F.when(total > 0, F.greatest(F.lit(0.0), (p + z * z / (2 * total) - spread) / (1 + z * z / total))).otherwise(F.lit(0.0))


def quadrant(entropy_norm: Column, complexity: Column, cut: float = 0.5) -> Column:
    """random, structured, constant or anomalous, by normalised entropy and LZ complexity."""
    return (
        F.when((entropy_norm > cut) & (complexity > cut), "random")
        .when(entropy_norm > cut, "structured")
        .when(complexity <= cut, "constant")
        .otherwise("anomalous")
    )
