"""Approximate statistics that merge: cardinality, quantiles, frequent values, count-min."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathlode.operators.profile import numeric_summary, value_frequency, value_statistics
from pathlode.sources.tables import scalars

HLL_BITS, TOP_K, EXACT_LIMIT, ALPHA = 11, 100, 10_000, 0.01


def path_sketches(nodes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """path, n, hll, kll (null without numbers): sketches that :func:`merge_sketches` adds up."""
    return scalars(nodes).groupBy(*keys, "path").agg(
        F.count("*").alias("n"), F.hll_sketch_agg("value", HLL_BITS).alias("hll"), F.kll_sketch_agg_double("num").alias("kll"), F.min("num").alias("min"), F.max("num").alias("max"), F.sum("num").alias("sum"), F.count("num").alias("n_num")
    )


def merge_sketches(parts: DataFrame) -> DataFrame:
    """One row a path from any number of partial ones."""
    return parts.groupBy("path").agg(
        F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"), F.kll_merge_agg_double("kll").alias("kll"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"), F.sum("n_num").alias("n_num")
    )


def read_sketches(merged: DataFrame) -> DataFrame:
    """path, total_count, cardinality, p05, p25, median, p75, p95, mad (half the middle range), min, max, mean."""
    has = F.col("n_num") > 0

    def q(p: float):
        return F.when(has, F.kll_sketch_get_quantile_double("kll", F.lit(p)))

    return merged.select(
        "path",
        F.col("n").alias("total_count"),
        F.hll_sketch_estimate("hll").alias("cardinality"),
        q(0.05).alias("p05"),
        q(0.25).alias("p25"),
        q(0.5).alias("median"),
        q(0.75).alias("p75"),
        q(0.95).alias("p95"),
        ((q(0.75) - q(0.25)) / 2).alias("mad"),
        "min",
        "max",
        F.when(has, F.col("sum") / F.col("n_num")).alias("mean"),
    )


def sketch_bytes(merged: DataFrame) -> DataFrame:
    """path, hll_bytes, kll_bytes, hll_error: what the sketches of a path take, and the standard error of its cardinality.

    HyperLogLog stops growing at 2^HLL_BITS registers; the other grows with the logarithm of the count.
    """
    return merged.select("path", F.octet_length("hll").alias("hll_bytes"), F.octet_length("kll").alias("kll_bytes"), F.lit(1.04 / 2 ** (HLL_BITS / 2)).alias("hll_error"))


def approximate_top(nodes: DataFrame, k: int = 10, max_items: int = 10_000) -> DataFrame:
    """path, value, count of about the k most frequent values of each path."""
    found = scalars(nodes).groupBy("path").agg(F.expr(f"approx_top_k(value, {k}, {max_items})").alias("t"))
    return found.select("path", F.explode("t").alias("e")).select("path", F.col("e.item").alias("value"), F.col("e.count").alias("count"))


def count_min(nodes: DataFrame, path: str, eps: float = 0.001, confidence: float = 0.99, seed: int = 1) -> DataFrame:
    """One row with the count-min sketch of one path's values."""
    return scalars(nodes).where(F.col("path") == path).agg(F.count_min_sketch("value", F.lit(eps), F.lit(confidence), F.lit(seed)).alias("sketch"))


def ddsketch(nodes: DataFrame, quantiles: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95), alpha: float = ALPHA) -> DataFrame:
    """path, q, value: quantiles with relative error from logarithmic buckets, as an ordinary aggregation.

    A number's bucket is ceil(ln |x| / ln g), g = (1 + alpha) / (1 - alpha); the quantile is the upper edge
    of the bucket that holds rank round(q (n - 1)) + 1. Buckets of parts add up.
    """
    g = (1 + alpha) / (1 - alpha)
    x = F.col("num")
    bucket = F.when(x == 0, F.lit(0)).otherwise(F.ceil(F.log(F.abs(x)) / F.log(F.lit(g)))).cast("int")
    counts = nodes.where("num is not null").groupBy("path", F.signum(x).cast("int").alias("sign"), bucket.alias("bucket")).agg(F.count("*").alias("c"))
    edge = F.col("sign") * F.pow(F.lit(g), F.col("bucket"))
    up = Window.partitionBy("path").orderBy("edge")
    run = counts.withColumn("edge", edge).select(
        "path", "edge", "c", F.sum("c").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"), F.sum("c").over(Window.partitionBy("path")).alias("n")
    )
    asked = F.explode(F.array(*[F.lit(q) for q in quantiles])).alias("q")
    ranks = run.select("*", asked).withColumn("rank", F.round(F.col("q") * (F.col("n") - 1)) + 1)
    return ranks.where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c"))).select("path", "q", F.col("edge").alias("value"))


def adaptive_statistics(nodes: DataFrame, limit: int = EXACT_LIMIT) -> DataFrame:
    """Statistics of each path: exact where it has at most ``limit`` distinct values, else from sketches.

    A first, cheap pass of HyperLogLog decides; only paths under the limit are counted by value. Past it
    entropy is null and entropy_upper_bound is log2 of the cardinality.
    """
    rough = read_sketches(path_sketches(nodes)).withColumn("exact", F.col("cardinality") <= limit)
    small = rough.where("exact").select("path")
    exact = value_statistics(value_frequency(nodes.join(small, "path", "left_semi"))).select("path", F.col("cardinality").alias("c"), "entropy", "max_rarity")
    both = rough.join(exact, "path", "left")
    return both.select(
        "path",
        "total_count",
        F.coalesce("c", "cardinality").alias("cardinality"),
        "entropy",
        F.when(~F.col("exact"), F.log2("cardinality")).alias("entropy_upper_bound"),
        "max_rarity",
        "exact",
        "min",
        "max",
        "mean",
        "median",
        "mad",
    )


__all__ = ["adaptive_statistics", "approximate_top", "count_min", "ddsketch", "merge_sketches", "numeric_summary", "path_sketches", "read_sketches", "sketch_bytes"]
