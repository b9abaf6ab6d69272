"""Running sums and exact percentiles of counted numbers, without one task's sort of a whole group.

Numbers fall into cells, CELLS to a doubling of their size, in the order of the numbers. The cells of a group
are counted first; only the numbers of one cell are ever sorted together, and the number of cells is bounded
by the range of doubles. A cell whose numbers are very many is one task's sort, on disk if it must be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1024
#: Larger than the cell of any double, so that cells keep the order on both sides of zero.
_SHIFT = CELLS * 1200


def cell(x: Column) -> Column:
    """The cell of a number; it never falls where the number rises. NaN comes last, as in a sort."""
    size = F.floor(F.least(F.log2(F.abs(x)), F.lit(1025.0)) * CELLS) + _SHIFT
    return F.when(F.isnan(x), 2 * _SHIFT).when(x == 0, 0).otherwise(F.when(x < 0, -size).otherwise(size)).cast("long")


def _placed(counted: DataFrame, keys: tuple[str, ...], value: str, amounts: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """``counted`` with its cells, and the cells: keys, cell, the next cell's least number, and for each amount its sum, that of the cells before and that of all."""
    celled = counted.withColumn("__cell", cell(F.col(value).cast("double")))
    sums = celled.groupBy(*keys, "__cell").agg(F.min(value).alias("__least"), *[F.sum(a).alias(a) for a in amounts])
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy("__cell")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    cells = sums.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        F.col("__cell").alias("__c"),
        F.lead("__least").over(ordered).alias("__next"),
        *[F.col(a).alias(f"__in_{a}") for a in amounts],
        *[F.coalesce(F.sum(a).over(earlier), F.lit(0)).alias(f"__before_{a}") for a in amounts],
        *[F.sum(a).over(whole).alias(f"__total_{a}") for a in amounts],
    )
    return celled, cells


def _met(celled: DataFrame, cells: DataFrame, keys: tuple[str, ...], value: str, amounts: tuple[str, ...]) -> DataFrame:
    order = Window.partitionBy(*keys, "__cell").orderBy(value)
    within = order.rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col("__cell") == F.col("__c"), *[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]]
    columns = [c for c in celled.columns if c != "__cell"]
    return celled.join(cells, same).select(
        *columns,
        F.coalesce(F.lead(value).over(order), F.col("__next")).alias(f"next_{value}"),
        *[(F.col(f"__before_{a}") + F.coalesce(F.sum(a).over(within), F.lit(0))).alias(f"before_{a}") for a in amounts],
        *[F.col(f"__total_{a}").alias(f"total_{a}") for a in amounts],
    )


def running(counted: DataFrame, keys: tuple[str, ...], value: str, amounts: tuple[str, ...]) -> DataFrame:
    """``counted`` with before_<amount>, the sum over smaller numbers of the same keys, total_<amount>, that over all, and next_<value>, the next larger number.

    ``counted`` has one row for each keys and number, so the order is total; null numbers are left out.
    """
    celled, cells = _placed(counted.where(F.col(value).isNotNull()), keys, value, amounts)
    return _met(celled, cells, keys, value, amounts)


def percentiles(counted: DataFrame, keys: tuple[str, ...], value: str, weight: str, points: tuple[float, ...]) -> DataFrame:
    """keys, p: the exact percentiles at ``points`` (linear interpolation) of numbers with whole weights over 0.

    Cells that hold none of the places asked for are not sorted at all. Null numbers are left out.
    """
    celled, cells = _placed(counted.where(F.col(value).isNotNull()), keys, value, (weight,))

    def places(total: Column) -> list[tuple[Column, Column, Column]]:
        at = [F.lit(p) * (total - 1) for p in points]
        return [(x, F.floor(x), F.ceil(x)) for x in at]

    def holds(before: Column, size: Column, place: Column) -> Column:
        return (before <= place) & (place < before + size)

    asked = F.lit(False)
    for _, low, high in places(F.col(f"__total_{weight}")):
        for place in (low, high):
            asked = asked | holds(F.col(f"__before_{weight}"), F.col(f"__in_{weight}"), place)
    met = _met(celled, cells.where(asked), keys, value, (weight,))
    before, size, total, x = F.col(f"before_{weight}"), F.col(weight), F.col(f"total_{weight}"), F.col(value).cast("double")
    ends = []
    for i, (_, low, high) in enumerate(places(total)):
        ends += [F.max(F.when(holds(before, size, low), x)).alias(f"__l{i}"), F.max(F.when(holds(before, size, high), x)).alias(f"__h{i}")]
    found = met.groupBy(*keys).agg(F.max(total).alias("__n"), *ends)
    out = []
    for i, (at, low, high) in enumerate(places(F.col("__n"))):
        between = (high - at) * F.col(f"__l{i}") + (at - low) * F.col(f"__h{i}")
        out.append(F.when(F.col(f"__l{i}") == F.col(f"__h{i}"), F.col(f"__l{i}")).otherwise(between))
    return found.select(*keys, F.array(*out).alias("p"))
