"""The training-data pipeline: five stages over ``documents``, each reading what its predecessor wrote."""

from __future__ import annotations

import functools
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathlode.llm import decontam, mixing, near_dup, quality, sharding
from pathlode.llm.common import collected_scratch, drop_scratch, scratch_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: For each thread and input folder, the scratch tables of the stage that ran last.
_scratch: dict[tuple[int, str], list] = {}


def stage(function: Stage) -> Stage:
    """A stage first drops the scratch tables of the one before it, called by the same thread on the same
    folder: that one's result has been written by then."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = (threading.get_ident(), sf_dir)
        drop_scratch(_scratch.pop(own, []))
        with collected_scratch() as tables:
            out = function(spark, docs, sf_dir)
        _scratch[own] = tables
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the label model reject go."""
    return quality.filter_quality(docs)


@stage
def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dup.deduplicate(docs)


@stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of sources whose weight is raised are repeated, up to the limit; none is left out."""
    return mixing.mix_documents(docs)


@stage
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document gets its shard and its virtual slot."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Expectation-maximisation and hashing are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is written as Parquet and read again.

    What a stage has read and its scratch tables go once its result is written; those of the last stage
    stay, as its result is lazy.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    read = []
    for k, (name, step) in enumerate(STAGES):
        with collected_scratch() as tables:
            out = step.__wrapped__(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            break
        out.write.parquet(f"{base}/{k}_{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}_{name}")
        drop_scratch(tables + read)
        read = [(spark, f"{base}/{k}_{name}")]
    return out
