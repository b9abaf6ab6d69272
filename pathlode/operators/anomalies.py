"""Numeric outliers, rare values and unstable types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlode.functions import information as info
from pathlode.operators.profile import numeric_summary, path_inventory, value_frequency
from pathlode.sources.tables import TYPES

Z_CUT, RARITY_CUT, INSTABILITY_CUT = 3.5, 2.0, 0.01
EPSILON = 2.220446049250313e-16


def numeric_outliers(nodes: DataFrame, cut: float = Z_CUT) -> DataFrame:
    """Numbers with a modified z beyond ``cut``: path, record_id, value, z_mad, median, mad.

    Where MAD is 0, any other number has an infinite z. A path with one number has none.
    """
    center = numeric_summary(nodes).where("count > 1").select(F.col("path").alias("p"), "median", "mad")
    gap = F.col("num") - F.col("median")
    infinite = F.when(gap > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    z = F.when(F.col("mad") > EPSILON, 0.6745 * gap / F.col("mad")).when(F.abs(gap) > EPSILON, infinite).otherwise(F.lit(0.0))
    numbers = nodes.where("num is not null").join(center, F.col("path") == F.col("p"))
    return numbers.withColumn("z_mad", z).where(F.abs("z_mad") > cut).select("path", "record_id", F.col("num").alias("value"), "z_mad", "median", "mad")


def rare_values(nodes: DataFrame, cut: float = RARITY_CUT) -> DataFrame:
    """Strings whose self-information is over the path's mean by ``cut`` deviations: path, value, count, rarity_bits.

    The deviation is the median distance from the mean; paths with one value or no deviation have none.
    """
    counts = value_frequency(nodes.where("type = 'string'"))
    totals = counts.groupBy("path").agg(F.sum("count").alias("total"), F.count("*").alias("values")).where("values > 1")
    bits = counts.join(totals, "path").withColumn("rarity_bits", info.rarity(F.col("count"), F.col("total")))
    # distinct values that occur equally often have the same bits: weigh them instead of listing them
    weighed = bits.groupBy("path", "rarity_bits").agg(F.count("*").alias("w"))
    means = weighed.groupBy("path").agg((F.sum(F.col("rarity_bits") * F.col("w")) / F.sum("w")).alias("mean"))
    spread = weighed.join(means, "path").groupBy("path", "mean").agg(F.percentile(F.abs(F.col("rarity_bits") - F.col("mean")), 0.5, F.col("w")).alias("mad"))
    limits = spread.where(F.col("mad") > EPSILON).select("path", (F.col("mean") + cut * F.col("mad")).alias("limit"))
    return bits.join(limits, "path").where("rarity_bits > limit").select("path", "value", "count", "rarity_bits")


def type_instabilities(nodes: DataFrame, cut: float = INSTABILITY_CUT) -> DataFrame:
    """Paths of more than one type: path, instability, dominant_type, type_distribution."""
    pairs = F.array(*[F.struct(F.lit(t).alias("k"), F.col(f"n_{t}").alias("v")) for t in TYPES])
    spread = F.map_from_entries(F.filter(pairs, lambda e: e["v"] > 0))
    return path_inventory(nodes).where(F.col("type_instability") > cut).select("path", F.col("type_instability").alias("instability"), "dominant_type", spread.alias("type_distribution"))


def anomaly_report(nodes: DataFrame, z_cut: float = Z_CUT, rarity_cut: float = RARITY_CUT, instability_cut: float = INSTABILITY_CUT) -> DataFrame:
    """All three kinds in one table: kind, path, record_id, value, num, score.

    The score is the modified z of a ``numeric_outlier``, the bits of a ``rare_value`` and the share of other
    types of a ``type_instability``, whose value is the dominant type.
    """
    def row(kind: str, record: Column, value: Column, num: Column, score: str) -> list[Column]:
        return [F.lit(kind).alias("kind"), F.col("path"), record.alias("record_id"), value.cast("string").alias("value"), num.cast("double").alias("num"), F.col(score).alias("score")]

    none = F.lit(None)
    record_type = dict(nodes.dtypes)["record_id"]
    numbers = numeric_outliers(nodes, z_cut).select(*row("numeric_outlier", F.col("record_id"), none, F.col("value"), "z_mad"))
    values = rare_values(nodes, rarity_cut).select(*row("rare_value", none.cast(record_type), F.col("value"), none, "rarity_bits"))
    types = type_instabilities(nodes, instability_cut).select(*row("type_instability", none.cast(record_type), F.col("dominant_type"), none, "instability"))
    return numbers.unionByName(values).unionByName(types)
