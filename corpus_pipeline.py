"""From raw documents to packed token rows, in five stages.

Each stage takes the rows its predecessor kept, stored as Parquet, and all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import lorespark
from lorespark.llm import decontamination, mixing, packing, simhash, toxicity
from lorespark.session import bounded_batches, durable

# Functions that run inside tasks travel with them; executors need no copy of the package.
cloudpickle.register_pickle_by_value(lorespark)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bounded(stage: Stage) -> Stage:
    """The stage, with texts that travel to Python a few MiB at a time."""

    @wraps(stage)
    def run_bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_bounded


@_bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window scores 0.5 or more go."""
    return toxicity.drop_toxic(docs, docs, _table(spark, sf_dir, "labels"))


@_bounded
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by sets of five-word shingles, that of the smallest id stays."""
    return simhash.drop_near_copies(docs)


@_bounded
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words of a benchmark item in a row go."""
    return decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken up to their targets; a document taken twice stands twice."""
    return mixing.mix(docs)


@_bounded
def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in rows of equal length, written as binary matrices and read from these."""
    return packing.pack_files(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

# The first stage is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
