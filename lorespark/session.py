"""Session settings and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
# Paths of the tables that the innermost ``passing`` block has stored.
_passing: ContextVar[list[str] | None] = ContextVar("_passing", default=None)


def local_session(cores: str = "*", name: str = "lorespark", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def bounded_batches(spark: SparkSession) -> None:
    """From now on rows travel to Python a few MiB at a time, unless the session has a size of its own.

    Spark's 64 MiB are held several times over by each task: as rows, as a growing buffer and as the
    batch that Python reads. Results do not depend on it.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(4 << 20))


def scratch_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, shared by all executors.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master without one gets a
    temporary folder, because there the driver's disk is every task's disk.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lorespark-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def durable(df: DataFrame, options: dict[str, str] | None = None, lasting: bool = False) -> DataFrame:
    """The same rows, written to a table in the scratch folder and read back from it.

    ``options`` are those of the Parquet writer. A ``lasting`` table outlives a ``passing`` block.

    Cuts lineage, survives the loss of executors, and later readers still prune columns and
    push filters.
    """
    path = f"{scratch_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    stored = _passing.get()
    if stored is not None and not lasting:
        stored.append(path)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``durable`` stores inside the block are deleted at its end, unless ``lasting``.

    For a job of many steps whose result is stored, and lasting, before the block ends.
    """
    token = _passing.set(paths := [])
    try:
        yield
    finally:
        _passing.reset(token)
        for path in paths:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
