"""Token counts of flat, unindexed token files by a separator scan.

A file is a row of ids in which each document ends with one separator. Files are cut into blocks
of bytes; each block is searched on its own, and a prefix scan over one row per block carries
open documents and document numbers across the borders.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.llm.tokens import END, ID_TYPE, VOCABULARY, Encoder, filesystem, whole_file
from lorespark.session import durable, scratch_folder

BLOCK_BYTES = 8 << 20


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """Write the ids of ``docs(doc_id, text)``, one file per task; ``file, number, doc_id`` per row.

    Texts are not shuffled. Null and empty texts are documents without ids. The result is stored,
    so files are written once; a task that is run again replaces its file.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    store, path = filesystem(folder)
    store.create_dir(path)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = iter(frames)
        first = next(frames, None)
        while first is not None and first.empty:
            first = next(frames, None)
        if first is None:
            return
        task = TaskContext.get()
        name = f"tokens-{task.partitionId():06d}.bin"
        encoder, number = Encoder(vocabulary), 0
        last = np.array([end], ID_TYPE).tobytes()
        with whole_file(f"{folder}/{name}", task.taskAttemptId()) as out:
            frame = first
            while frame is not None:
                for text in frame["text"]:
                    out.write(encoder.ids(text).tobytes())
                    out.write(last)
                yield pd.DataFrame(
                    {"file": name, "number": np.arange(number, number + len(frame)), "doc_id": frame["doc_id"]}
                )
                number += len(frame)
                frame = next(frames, None)

    rows = docs.select("doc_id", "text").mapInPandas(write, f"file string, number long, doc_id {kind}")
    return durable(rows)


def scan_token_files(
    spark: SparkSession, folder: str, end: int = END, id_type: str = ID_TYPE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``file, number, start, n_tokens`` for every document in the ``.bin`` files of a folder.

    ``number`` and ``start`` count documents and ids from the start of the file; ``n_tokens`` does
    not count the separator. Ids after the last separator are a document too, if there are any; an
    odd last byte of a cut-off file is no id. An empty file holds no document. Only positions of
    separators leave the tasks that read the ids.
    """
    width = np.dtype(id_type).itemsize
    step = max(1, block_bytes // width)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, file, start, size in zip(frame["path"], frame["file"], frame["start"], frame["size"]):
                store, place = filesystem(path)
                with store.open_input_file(place) as data:
                    data.seek(int(start) * width)
                    ids = np.frombuffer(data.read(int(size) * width), id_type)
                at = np.flatnonzero(ids == end) + int(start)
                # One row per separator, numbered from 0, and one for the block, numbered -1.
                yield pd.DataFrame({
                    "file": file,
                    "block": int(start),
                    "rank": np.arange(-1, len(at)),
                    "at": np.concatenate(([at[-1] if len(at) else -1], at)).astype("int64"),
                    "previous": np.concatenate(([start + size, -1], at[:-1])).astype("int64")[: len(at) + 1],
                })

    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")
        .withColumn("ids", F.floor(F.col("length") / width)).filter("ids > 0")
    )
    tasks = spark.sparkContext.defaultParallelism * 4
    blocks = files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file"), "ids",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("ids") - 1, F.lit(step).cast("long"))).alias("start"),
    ).withColumn("size", F.least(F.lit(step), F.col("ids") - F.col("start"))).repartition(tasks, "path", "start")
    found = durable(
        blocks.mapInPandas(search, "file string, block long, rank long, at long, previous long")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("file").orderBy("block").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    separators = found.filter("rank >= 0").groupBy("file", "block").agg(F.count(F.lit(1)).alias("separators"))
    scanned = (
        found.filter("rank < 0").join(separators, ["file", "block"], "left")
        .withColumn("first", F.coalesce(F.sum("separators").over(before), F.lit(0)))
        .withColumn("carried", F.coalesce(F.max("at").over(before), F.lit(-1)))
        .withColumn("last", F.greatest(F.col("at"), F.col("carried")))
        .withColumn("ends", F.max("previous").over(later))
        .withColumn("final", F.col("ends") == F.col("previous"))
    )
    borders = scanned.select("file", "block", "first", "carried")
    closed = found.filter("rank >= 0").join(borders, ["file", "block"]).select(
        "file",
        (F.col("first") + F.col("rank")).alias("number"),
        (F.when(F.col("rank") == 0, F.col("carried")).otherwise(F.col("previous")) + 1).alias("start"),
        "at",
    )
    # The last block of a file ends where the file ends.
    opened = scanned.filter("final and last + 1 < ends").select(
        "file", (F.col("first") + F.coalesce("separators", F.lit(0))).alias("number"),
        (F.col("last") + 1).alias("start"), F.col("ends").alias("at"),
    )
    return closed.unionByName(opened).select("file", "number", "start", (F.col("at") - F.col("start")).alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_tokens, file, number, start`` for every row of ``docs(doc_id, text)``.

    The ids are written to flat files in the shared folder, and counted from these alone.
    """
    spark = docs.sparkSession
    folder = f"{scratch_folder(spark)}/tokens-{uuid.uuid4().hex}"
    placed = write_token_files(docs, folder, vocabulary)
    counted = scan_token_files(spark, folder, block_bytes=block_bytes)
    return placed.join(counted, ["file", "number"]).select("doc_id", "n_tokens", "file", "number", "start")
