"""Token ids packed into rows of equal length by best fit decreasing.

Documents are cut without loss into pieces of at most one row. Pieces are placed longest first,
each into the row whose free space it leaves smallest; a segment tree over free spaces finds that
row in logarithmic time. A task packs blocks of bounded size, so texts are never shuffled and no
row spans two tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lorespark.llm.tokens import END, ID_TYPE, VOCABULARY, Encoder, filesystem, whole_file
from lorespark.session import durable, scratch_folder

ROW_TOKENS = 2048
BLOCK_TOKENS = 1 << 21
# Tokens of the rows that are laid out at once, and texts that are Python strings at once.
MATRIX_TOKENS = 1 << 19
TEXTS = 256

PACKED = (
    "part int, block int, row int, n_tokens int, ids binary, positions binary, cu_seqlens array<int>,"
    " doc_ids array<{kind}>, pieces array<int>"
)
INDEX = ["part", "block", "row", "n_tokens", "doc_ids", "pieces"]


class FreeSpace:
    """Rows by free space. ``take(size)`` finds the row with the least space that is enough."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.rows: list[list[int]] = [[] for _ in range(self.size)]
        self.tree = bytearray(2 * self.size)

    def put(self, row: int, space: int) -> None:
        self.rows[space].append(row)
        at = space + self.size
        while at and not self.tree[at]:
            self.tree[at] = 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        tree, at = self.tree, size + self.size
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        space = at - self.size
        row = self.rows[space].pop()
        if not self.rows[space]:
            tree[at] = 0
            while at > 1 and not tree[at ^ 1]:
                at >>= 1
                tree[at] = 0
        return row, space


def best_fit(sizes: np.ndarray, most: int) -> list[list[int]]:
    """Rows of piece numbers; no row holds more than ``most``, ties go by piece number."""
    rows: list[list[int]] = []
    free = FreeSpace(most)
    for piece in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[piece])
        found = free.take(size)
        if found is None:
            found = len(rows), most
            rows.append([])
        rows[found[0]].append(piece)
        if found[1] > size:
            free.put(found[0], found[1] - size)
    return rows


def _binary(data: object, n: int, width: int) -> pa.Array:
    """``n`` values of ``width`` bytes each, laid side by side in ``data``."""
    edges = pa.array(np.arange(n + 1, dtype="i4") * width)
    return pa.Array.from_buffers(pa.binary(), n, [None, edges.buffers()[1], pa.py_buffer(data)])


def _pack_block(
    doc_ids: pa.Array, lines: list[np.ndarray], row_tokens: int, part: int, block: int
) -> Iterator[pa.RecordBatch]:
    """The packed rows of the ids ``lines`` of documents, a bounded number of rows at a time."""
    pieces = [(doc, at) for doc, ids in enumerate(lines) for at in range(0, len(ids), row_tokens)]
    sizes = np.array([min(row_tokens, len(lines[doc]) - at) for doc, at in pieces])
    steps = np.arange(row_tokens, dtype=ID_TYPE)
    rows = best_fit(sizes, row_tokens)
    most = max(1, MATRIX_TOKENS // row_tokens)
    for first in range(0, len(rows), most):
        some = rows[first : first + most]
        ids, positions = np.zeros((2, len(some), row_tokens), ID_TYPE)
        ends = [np.cumsum(sizes[members]) for members in some]
        for row, members in enumerate(some):
            for (doc, at), end, n in zip((pieces[p] for p in members), ends[row], sizes[members]):
                ids[row, end - n : end], positions[row, end - n : end] = lines[doc][at : at + n], steps[:n]
        flat = [p for members in some for p in members]
        counts = np.array([len(members) for members in some])
        starts = np.cumsum([0, *counts]).astype("i4")
        segments = np.concatenate([np.r_[0, e] for e in ends]).astype("i4")
        owners = doc_ids.take(pa.array([pieces[p][0] for p in flat]))
        numbers = pa.array([pieces[p][1] // row_tokens for p in flat], pa.int32())
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part] * len(some), pa.int32()),
            "block": pa.array([block] * len(some), pa.int32()),
            "row": pa.array(range(first, first + len(some)), pa.int32()),
            "n_tokens": pa.array([int(e[-1]) for e in ends], pa.int32()),
            "ids": _binary(ids.tobytes(), len(some), row_tokens * ids.itemsize),
            "positions": _binary(positions.tobytes(), len(some), row_tokens * ids.itemsize),
            "cu_seqlens": pa.ListArray.from_arrays(np.cumsum([0, *(counts + 1)]).astype("i4"), pa.array(segments)),
            "doc_ids": pa.ListArray.from_arrays(starts, owners),
            "pieces": pa.ListArray.from_arrays(starts, numbers),
        })


def _pack_texts(
    batches: Iterator[pa.RecordBatch], row_tokens: int, vocabulary: str, end: int, block_tokens: int
) -> Iterator[pa.RecordBatch]:
    """What ``pack`` makes of the documents of one task."""
    encoder, part, block, n = None, TaskContext.get().partitionId(), 0, 0
    doc_ids: list[pa.Array] = []
    lines: list[np.ndarray] = []
    for batch in batches:
        for at in range(0, len(batch), TEXTS):
            # A few texts at a time become Python strings; ids are copied, so that no batch is kept for them.
            encoder = encoder or Encoder(vocabulary)
            texts = batch.column("text").slice(at, TEXTS).to_pylist()
            owners, first = batch.column("doc_id").take(pa.array(range(at, at + len(texts)))), 0
            for i, text in enumerate(texts, 1):
                lines.append(np.append(encoder.ids(text), np.array([end], ID_TYPE)))
                n += len(lines[-1])
                if n >= block_tokens:
                    held = pa.concat_arrays([*doc_ids, owners[first:i]])
                    yield from _pack_block(held, lines, row_tokens, part, block)
                    doc_ids, lines, n, first, block = [], [], 0, i, block + 1
            doc_ids.append(owners[first:])
    if lines:
        yield from _pack_block(pa.concat_arrays(doc_ids), lines, row_tokens, part, block)


def _check(row_tokens: int) -> None:
    if not 0 < row_tokens < 1 << 16:
        raise ValueError("row_tokens must be positive and below 65,536")


def pack(
    docs: DataFrame,
    row_tokens: int = ROW_TOKENS,
    vocabulary: str = VOCABULARY,
    end: int = END,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Packed rows of the ids of ``docs(doc_id, text)``, each document closed by ``end``.

    ``ids`` and ``positions`` are little-endian 16-bit arrays of ``row_tokens`` entries, zero
    after ``n_tokens``; segment ``i`` of a row is ``cu_seqlens[i] : cu_seqlens[i + 1]`` and holds
    piece ``pieces[i]`` of document ``doc_ids[i]``; positions start at 0 in each segment. Null and
    empty texts are the single id ``end``. The row numbers count within ``part`` and ``block``;
    an empty table gives no rows and other columns are ignored.
    """
    _check(row_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pack_texts(batches, row_tokens, vocabulary, end, block_tokens)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, PACKED.format(kind=kind))


def write_matrices(rows: DataFrame, folder: str, row_tokens: int = ROW_TOKENS) -> DataFrame:
    """Write packed rows as binary files; ``file, rows`` per file.

    ``rows`` are those of ``pack``. Or they are documents, just ``doc_id, text``: then each task packs
    its own as ``pack`` does and writes them at once, in one Python process instead of two.

    For each task: ``ids-*.bin`` and ``positions-*.bin`` are matrices of ``row_tokens`` 16-bit
    columns, ``segments-*.bin`` holds the cumulative lengths of all rows as 32-bit integers, one
    0 at the start of each row, and ``index-*.bin`` is an Arrow stream of each row's number, length,
    documents and pieces. Files appear whole and a repeated task replaces its own.
    """

    _check(row_tokens)
    texts = rows.columns == ["doc_id", "text"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, attempt, written, stream = f"{task.partitionId():06d}.bin", task.taskAttemptId(), 0, None
        if texts:
            batches = _pack_texts(batches, row_tokens, VOCABULARY, END, BLOCK_TOKENS)
        with (
            whole_file(f"{folder}/ids-{name}", attempt) as ids,
            whole_file(f"{folder}/positions-{name}", attempt) as positions,
            whole_file(f"{folder}/segments-{name}", attempt) as segments,
            whole_file(f"{folder}/index-{name}", attempt) as index,
        ):
            for batch in batches:
                for a, b in zip(batch.column("ids"), batch.column("positions")):
                    ids.write(a.as_buffer()), positions.write(b.as_buffer())
                segments.write(batch.column("cu_seqlens").flatten().to_numpy().astype("<i4").tobytes())
                places = batch.select(INDEX)
                stream = stream or pa.ipc.new_stream(index, places.schema)
                stream.write_batch(places)
                written += len(batch)
            if stream:
                stream.close()
        yield pa.RecordBatch.from_pydict({"file": [name], "rows": pa.array([written], pa.int64())})

    store, path = filesystem(folder)
    store.create_dir(path)
    held = rows if texts else rows.select(*INDEX, "ids", "positions", "cu_seqlens")
    return held.mapInArrow(write, "file string, rows long")


def read_matrices(spark: SparkSession, folder: str, kind: str, row_tokens: int = ROW_TOKENS) -> DataFrame:
    """The packed rows in the files of ``write_matrices``; ``kind`` is the type of the document ids."""
    width = row_tokens * np.dtype(ID_TYPE).itemsize
    names = [c.split()[0] for c in PACKED.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch.column("path").to_pylist()):
            top, name = path.rsplit("/", 1)
            with ExitStack() as files:
                index, ids, positions, segments = (
                    files.enter_context(filesystem(top)[0].open_input_stream(
                        f"{filesystem(top)[1]}/{name.replace('index', part, 1)}"))
                    for part in ("index", "ids", "positions", "segments")
                )
                for places in pa.ipc.open_stream(index):
                    n = len(places)
                    sizes = [len(p) + 1 for p in places.column("pieces")]
                    lengths = np.frombuffer(segments.read(4 * sum(sizes)), "<i4")
                    found = {c: places.column(c) for c in INDEX} | {
                        c: _binary(f.read(n * width), n, width) for c, f in (("ids", ids), ("positions", positions))
                    }
                    found["cu_seqlens"] = pa.ListArray.from_arrays(np.cumsum([0, *sizes]).astype("i4"), pa.array(lengths))
                    yield pa.RecordBatch.from_pydict({c: found[c] for c in names})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "index-*.bin").load(folder)
    files = files.filter("length > 0").select("path")
    tasks = spark.sparkContext.defaultParallelism * 4
    return files.repartition(tasks, "path").mapInArrow(read, PACKED.format(kind=kind))


def pack_files(docs: DataFrame, row_tokens: int = ROW_TOKENS) -> DataFrame:
    """The rows of ``pack``, written as matrices to a new shared folder and read from these alone."""
    spark = docs.sparkSession
    folder = f"{scratch_folder(spark)}/packed-{uuid.uuid4().hex}"
    durable(write_matrices(docs.select("doc_id", "text"), folder, row_tokens))
    return read_matrices(spark, folder, docs.schema["doc_id"].dataType.simpleString(), row_tokens)
