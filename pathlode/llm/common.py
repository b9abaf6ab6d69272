"""Helpers that the pipeline operators share: scratch tables, word splitting, ASCII case."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space that separates words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: A key is hot if it has at least this share of the rows, so there are at most so many hot keys.
HOT_KEYS = 4096

_own_root: dict[str, str] = {}
#: Takes the scratch tables that are written, in a context that collects them.
_collector: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("collector", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The folder for tables that cut lineage: spark.checkpoint.dir of the session.

    Where the session names none, a local session (tests, one machine) gets a temporary folder of this
    process; on a cluster no machine's own folder would do, so that is an error.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = tempfile.mkdtemp(prefix="pathlode-")
    return "file://" + _own_root[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the application's folder in the shared scratch folder and read it back.

    The table survives lost executors and fixes whatever the plan above it would compute anew,
    such as generated row ids. Results are lazy, so it stays until :func:`drop_scratch` or
    :func:`drop_all_scratch` is called.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (tables := _collector.get()) is not None:
        tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession) -> str:
    """The application's own folder in the scratch folder."""
    return f"{scratch_root(spark)}/pathlode-{spark.sparkContext.applicationId}"


@contextlib.contextmanager
def collected_scratch() -> Iterator[list[tuple[SparkSession, str]]]:
    """Lists the scratch tables that this thread writes inside."""
    tables: list[tuple[SparkSession, str]] = []
    before = _collector.set(tables)
    try:
        yield tables
    finally:
        _collector.reset(before)


def drop_all_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of the application. Call it when no lazy result needs them any more."""
    drop_scratch([(spark, scratch_folder(spark))])


def drop_scratch(tables: list[tuple[SparkSession, str]]) -> None:
    """Delete scratch tables. Call it only when no lazy result needs them any more."""
    while tables:
        spark, path = tables.pop()
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _forget() -> None:
    for path in _own_root.values():
        shutil.rmtree(path, ignore_errors=True)


def spread_join(rows: DataFrame, lookup: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``lookup``, a table with one row for each of its keys, without a hot task.

    ``count`` is a column of ``lookup``: the number of rows that have the key. Keys with at least one
    HOT_KEYS-th of all these rows are broadcast; there are at most HOT_KEYS of them, whatever the input.
    All others are shuffled, and none of them can fill a task. ``how`` is inner or left; null keys match
    nothing. ``lookup`` is read three times, so it should be a written table.
    """
    spare = [c for c in lookup.columns if c not in on]
    is_hot = F.col(count) * HOT_KEYS >= lookup.agg(F.sum(count)).scalar()
    packed = lookup.select(*[F.col(f"`{k}`").alias(f"__{i}") for i, k in enumerate(on)], F.struct(*[F.col(f"`{c}`") for c in spare]).alias("__l"), is_hot.alias("__is_hot"))
    keys = [f"__{i}" for i in range(len(on))]
    left = rows.select(F.struct("*").alias("__r"), *[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(on)])
    hot = packed.where("__is_hot").select(*keys, F.col("__l").alias("__hot"))
    one = left.join(F.broadcast(hot), [F.col(f"__k{i}") == F.col(f"__{i}") for i in range(len(on))], "left").drop(*keys)
    # rows that are served already get a key that matches nothing and spreads them
    served = F.col("__hot").isNotNull()
    one = one.select("__r", "__hot", *[F.when(~served, F.col(f"__k{i}")).alias(f"__k{i}") for i in range(len(on))], F.when(served, F.xxhash64("__r")).otherwise(F.lit(0)).alias("__spread"))
    rest = packed.where("not __is_hot").select(*keys, "__l", F.lit(0).cast("long").alias("__zero"))
    both = one.join(rest, [F.col("__spread") == F.col("__zero"), *[F.col(f"__k{i}") == F.col(f"__{i}") for i in range(len(on))]], "left")
    found = F.coalesce("__hot", "__l")
    if how == "inner":
        both = both.where(found.isNotNull())
    return both.select("__r", found.alias("__f")).select("__r.*", *[F.col(f"__f.`{c}`").alias(c) for c in spare])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row.

    A plain reference may be inlined into every place that uses it; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]
