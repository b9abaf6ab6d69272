"""Per-path statistics of a stream, exact while they are small and as sketches, under Structured Streaming.

Each micro-batch is profiled like a table and appended as one small table of mergeable parts; reading
merges them. Batches are idempotent: a batch that is run again overwrites its own part, so a lost executor
or a restart counts nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pathlode.operators.fingerprints import hashed_shapes
from pathlode.operators.profile import dominant, path_inventory
from pathlode.operators.sketches import merge_sketches, path_sketches, read_sketches
from pathlode.sources.tables import TYPES, table_nodes


def start_statistics(stream: DataFrame, state_path: str, checkpoint: str, columns: list[str] | None = None) -> StreamingQuery:
    """Start a query that keeps parts of statistics of ``stream`` under ``state_path``."""

    def merge(batch: DataFrame, number: int) -> None:
        path_sketches(table_nodes(batch, columns)).write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def read_statistics(spark: SparkSession, state_path: str) -> DataFrame:
    """Statistics of all batches so far."""
    return read_sketches(merge_sketches(spark.read.parquet(state_path).drop("batch")))


def compact_statistics(spark: SparkSession, state_path: str, target: str) -> None:
    """Write all parts as one."""
    merge_sketches(spark.read.parquet(state_path).drop("batch")).write.mode("overwrite").parquet(f"{target}/batch=0")


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 day", lateness: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts by key in tumbling (or sliding) windows of event time; later events than ``lateness`` are dropped."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, lateness).groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sessions by key: start, end and number of events, closed by a gap."""
    return stream.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def start_fingerprint(stream: DataFrame, state_path: str, checkpoint: str, columns: list[str] | None = None) -> StreamingQuery:
    """Start a query that keeps the counts of types by path of ``stream`` under ``state_path``: one row a path and batch."""

    def merge(batch: DataFrame, number: int) -> None:
        path_inventory(table_nodes(batch, columns)).write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def read_fingerprint(spark: SparkSession, state_path: str) -> DataFrame:
    """nodes, path_set and typed_path of all batches so far, as :func:`shape_fingerprints` gives them for the whole table."""
    parts = spark.read.parquet(state_path)
    added = parts.groupBy("path").agg(F.sum("count").alias("count"), *[F.sum(f"n_{t}").alias(f"n_{t}") for t in TYPES])
    paths = added.select(F.lit(0).alias("stream"), "path", "count", dominant().alias("dominant_type"))
    return hashed_shapes(paths, "stream").select("nodes", "path_set", "typed_path")
