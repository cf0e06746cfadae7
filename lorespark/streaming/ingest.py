"""Chunks of arriving contents, upserted by their deterministic id."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorespark.operators.ingest import chunk_contents, vectors_of
from lorespark.schemas import CHUNK_OVERLAP, CHUNK_SIZE, CONTENTS

DELIVERIES = "source_id string, part int, version long, batch int, checkpoint string, trigger long"


def stream_contents(spark: SparkSession, directory: str, files_per_trigger: int = 1000) -> DataFrame:
    """Contents files as they arrive in a folder."""
    return (
        spark.readStream.schema(CONTENTS)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(directory)
    )


def _version() -> Column:
    given = F.try_element_at("metadata", F.lit("ingest_version")).try_cast("long")
    return F.coalesce(given, F.lit(0).cast("long"))


def _deliveries(spark: SparkSession, chunks_path: str) -> DataFrame | None:
    """What has been delivered completely: a row per content, its version, and the batch it is in."""
    try:
        return spark.read.schema(DELIVERIES).option("recursiveFileLookup", True).parquet(_deliveries_path(chunks_path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _deliveries_path(chunks_path: str) -> str:
    return chunks_path.rstrip("/") + "_deliveries"


def _batch_number(spark: SparkSession, chunks_path: str, checkpoint: str, trigger: int) -> int:
    """The folder of a micro-batch: its own if it was stored before, else the next free one."""
    known = _deliveries(spark, chunks_path)
    if known is None:
        return 0
    same = (F.col("checkpoint") == checkpoint) & (F.col("trigger") == trigger)
    own, last = known.agg(F.max(F.when(same, F.col("batch"))), F.max("batch")).first()
    return own if own is not None else 0 if last is None else last + 1


def ingest_stream(
    contents: DataFrame,
    chunks_path: str,
    checkpoint: str,
    vectors_path: str | None = None,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> StreamingQuery:
    """Chunk and embed everything that has arrived, then stop.

    Each micro-batch has a folder of its own, ``batch=<n>``, under ``chunks_path`` and
    ``vectors_path``. When both are written, the deliveries of the batch are listed beside them;
    readers see listed batches only, so chunks and vectors appear together or not at all, and
    a batch that failed half-way is overwritten. A batch replayed by its checkpoint finds its
    folder again, and a new checkpoint goes on behind the batches that are there.
    """

    def store(batch: DataFrame, trigger: int) -> None:
        spark = batch.sparkSession
        number = _batch_number(spark, chunks_path, checkpoint, trigger)
        folder = f"{chunks_path}/batch={number}"
        chunk_contents(batch, size, overlap).write.mode("overwrite").parquet(folder)
        if vectors_path is not None:
            vectors_of(spark.read.parquet(folder)).write.mode("overwrite").parquet(f"{vectors_path}/batch={number}")
        batch.select(
            "source_id", "part", _version().alias("version"), F.lit(number).alias("batch"), F.lit(checkpoint).alias("checkpoint"), F.lit(trigger).cast("long").alias("trigger"),
        ).write.mode("overwrite").parquet(f"{_deliveries_path(chunks_path)}/{number}")

    return (
        contents.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _stored(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.option("basePath", path).parquet(path)
    return stored.withColumn("batch", F.col("batch").cast("int")).withColumn("version", _version())


def _shown(spark: SparkSession, chunks_path: str) -> DataFrame:
    """Chunks of the latest version of each source, each part from its latest batch, with both."""
    known = _deliveries(spark, chunks_path)
    if known is None:
        known = spark.createDataFrame([], DELIVERIES)
    latest = known.groupBy("source_id").agg(F.max("version").alias("version"))
    current = (
        known.join(latest, ["source_id", "version"], "left_semi")
        .groupBy("source_id", "part", "version").agg(F.max("batch").alias("batch"))
    )
    return _stored(spark, chunks_path).join(current, ["source_id", "part", "version", "batch"], "left_semi")


def latest_chunks(spark: SparkSession, chunks_path: str) -> DataFrame:
    """Stored chunks; a part of a source that arrived again shows only its latest batch.

    Parts of one source may arrive in different batches. Contents whose metadata carry a number
    ``ingest_version`` also retire every part of the source with a smaller one (none counts as 0),
    also if they hold no text and leave no chunk.
    """
    return _shown(spark, chunks_path).drop("batch", "version")


def latest_vectors(spark: SparkSession, chunks_path: str, vectors_path: str) -> DataFrame:
    """Stored vectors of the chunks that ``latest_chunks`` shows."""
    keys = _shown(spark, chunks_path).select(F.col("chunk_id").alias("vec_id"), "version", "batch")
    return _stored(spark, vectors_path).join(keys, ["vec_id", "version", "batch"], "left_semi").drop("batch", "version")
