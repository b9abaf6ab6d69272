"""Per-path structure and value statistics over a node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlode.functions import information as info
from pathlode.operators.ordered import percentiles
from pathlode.sources.tables import TYPES, scalars


def dominant() -> Column:
    """The most frequent type by the columns ``n_<type>``; ties go to the later type."""
    return F.greatest(*[F.struct(F.col(f"n_{t}").alias("n"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(TYPES)])["t"]


def path_inventory(nodes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """path, count, depth, dominant_type, type_instability, null_rate and a count for each type."""
    by_type = [F.count_if(F.col("type") == t).alias(f"n_{t}") for t in TYPES]
    counted = nodes.groupBy(*keys, "path").agg(F.count("*").alias("count"), F.max("depth").alias("depth"), *by_type)
    largest = F.greatest(*[F.struct(F.col(f"n_{t}").alias("n"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(TYPES)])
    return counted.withColumn("top", largest).select(
        *keys,
        "path",
        "count",
        "depth",
        F.col("top.t").alias("dominant_type"),
        (1 - F.col("top.n") / F.col("count")).alias("type_instability"),
        (F.col("n_null") / F.col("count")).alias("null_rate"),
        *[f"n_{t}" for t in TYPES],
    )


def document_metadata(nodes: DataFrame) -> DataFrame:
    """One row: total_nodes, max_depth, distinct_paths (the root array included)."""
    by_path = nodes.groupBy("path").agg(F.count("*").alias("n"), F.max("depth").alias("d"))
    return by_path.agg((F.sum("n") + 1).alias("total_nodes"), F.max("d").alias("max_depth"), (F.count("*") + 1).alias("distinct_paths"))


def value_frequency(nodes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """How often each value occurs at each path: path, value, count."""
    return scalars(nodes).groupBy(*keys, "path", "value").agg(F.count("*").alias("count"))


def top_values(frequency: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent values of each path, most frequent first, ties by value."""
    order = Window.partitionBy("path").orderBy(F.desc("count"), F.asc("value"))
    return frequency.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def value_statistics(frequency: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Entropies, cardinality and rarity of each path, in one aggregation of the counts."""
    c = F.col("count")
    return frequency.groupBy(*keys, "path").agg(
        F.sum(c).alias("total_count"),
        F.count("*").alias("cardinality"),
        info.entropy(c).alias("entropy"),
        info.normalized_entropy(c).alias("normalized_entropy"),
        info.max_rarity(c).alias("max_rarity"),
    )


def renyi_spectrum(frequency: DataFrame, order: float = 2.0) -> DataFrame:
    """H0, H1, the given order and H-infinity of each path, their divergence, and all over H0."""
    c = F.col("count")
    raw = frequency.groupBy("path").agg(
        info.renyi(c, 0).alias("h0"), info.renyi(c, 1).alias("h1"), info.renyi(c, order).alias("h2"), info.renyi(c, float("inf")).alias("h_inf")
    )

    def part(name: str) -> Column:
        return F.when(F.col("h0") > 0, F.col(name) / F.col("h0")).otherwise(F.lit(0.0)).alias(f"{name}_normalized")

    return raw.select("path", "h0", "h1", "h2", "h_inf", (F.col("h0") - F.col("h_inf")).alias("divergence"), part("h1"), part("h2"), part("h_inf"))


def numeric_summary(nodes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """min, max, mean, median, mad and percentiles (linear interpolation) of the numbers of each path.

    Equal numbers are counted first and enter the exact percentiles as weights; the percentiles come from
    counts by cell (:mod:`pathlode.operators.ordered`), so no path's numbers meet in one buffer. MAD is unscaled.
    """
    counted = nodes.where("num is not null and not isnan(num)").groupBy(*keys, "path", "num").agg(F.count("*").alias("w"))
    first = counted.groupBy(*keys, "path").agg(
        F.sum("w").alias("count"),
        F.min("num").alias("min"),
        F.max("num").alias("max"),
        (F.sum(F.col("num") * F.col("w")) / F.sum("w")).alias("mean"),
    )
    places = percentiles(counted, (*keys, "path"), "num", "w", (0.05, 0.25, 0.5, 0.75, 0.95))
    centers = places.select(*[F.col(k).alias(f"__k_{k}") for k in (*keys, "path")], "p")
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in (*keys, "path")]
    apart = counted.join(centers, same).select(*keys, "path", F.abs(F.col("num") - F.col("p")[2]).alias("apart"), "w")
    spread = percentiles(apart, (*keys, "path"), "apart", "w", (0.5,))
    spread = spread.select(*[F.col(k).alias(f"__s_{k}") for k in (*keys, "path")], F.col("p")[0].alias("mad"))
    return first.join(centers, same).join(spread, [F.col(k).eqNullSafe(F.col(f"__s_{k}")) for k in (*keys, "path")]).select(
        *keys, "path", "count", "min", "max", "mean", F.col("p")[2].alias("median"), "mad", *[F.col("p")[i].alias(n) for i, n in ((0, "p05"), (1, "p25"), (3, "p75"), (4, "p95"))]
    )


def benford(nodes: DataFrame) -> DataFrame:
    """Leading digits of the numbers of each path against Benford's law: path, digit, count, observed, expected, and for the path chi_squared, mad, conforms."""
    x = F.abs(F.col("num"))
    digit = F.floor(x / F.pow(F.lit(10.0), F.floor(F.log10(x)))).cast("int")
    digits = nodes.where("num is not null and num <> 0 and abs(num) < double('Infinity')").select("path", F.least(F.lit(9), F.greatest(F.lit(1), digit)).alias("digit"))
    wide = digits.groupBy("path").agg(F.count("*").alias("n"), *[F.count_if(F.col("digit") == d).alias(f"d{d}") for d in range(1, 10)])
    expected = {d: F.log10(F.lit(1 + 1 / d)) for d in range(1, 10)}
    chi = sum((F.pow(F.col(f"d{d}") - F.col("n") * expected[d], 2) / (F.col("n") * expected[d]) for d in range(1, 10)), F.lit(0.0))
    mad = sum((F.abs(F.col(f"d{d}") / F.col("n") - expected[d]) for d in range(1, 10)), F.lit(0.0)) / 9
    return wide.select("path", F.col("n").alias("count"), *[f"d{d}" for d in range(1, 10)], chi.alias("chi_squared"), mad.alias("mad"), (mad < 0.015).alias("conforms"))


def batch_aggregate(nodes: DataFrame, document: str = "record_id") -> DataFrame:
    """In how many documents each path occurs, and whether it is common (half of them) or rare."""
    found = nodes.select("path", document).distinct().groupBy("path").agg(F.count("*").alias("documents"))
    total = nodes.agg(F.count_distinct(document).alias("n"))
    n = total.scalar()
    rare = F.when(n <= 10, F.col("documents") < 2).otherwise(F.col("documents") < F.ceil(n * 0.1))
    return found.select("path", "documents", (F.col("documents") >= F.ceil(n * 0.5)).alias("common"), rare.alias("rare"))
