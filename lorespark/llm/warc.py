"""Web archives as a chunked record table.

A payload travels as rows of a record, a chunk number and a bounded piece of bytes, never as one
value: its digests are carried from chunk to chunk, the writer passes pieces on to the archive as
they come, and the reader gives the pieces back with the digest so far. Equal payloads are found
by length and two digests; one record keeps the payload, the others refer to it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.tokens import filesystem, whole_file
from lorespark.session import durable, scratch_folder

CHUNK_BYTES = 64 << 10
FILE_BYTES = 256 << 20
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2048
LEVEL = 1
DATE = "1970-01-01T00:00:00Z"
#: The chunked record table: chunks of one record are numbered from 0 and stand in order.
RECORD = ["page_id", "url", "mark"]
DIGESTS = "page_id {kind}, url string, mark long, n_bytes long, sha1 string, sha256 string"
WRITTEN = "file string, records long, bytes long"
READ = (
    "file string, record_id string, type string, page_id string, url string, refers_to_id string, refers_to string,"
    " declared_digest string, declared_bytes long, chunk int, last boolean, data binary, bytes_so_far long,"
    " digest_so_far string"
)
# Fixed values of the archive format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http;msgtype=response"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
END = b"\r\n\r\n"


def pieces(payload: Column, size: int = CHUNK_BYTES) -> list[Column]:
    """``chunk, last, data``: the bytes of a payload in rows of at most ``size``; an empty one is one row."""
    last = F.col("_last")
    data = F.substring(payload, F.col("chunk") * size + 1, F.lit(size))
    return [F.col("chunk"), (F.col("chunk") == last).alias("last"), data.alias("data")]


def with_chunks(rows: DataFrame, payload: str, size: int, *columns: str) -> DataFrame:
    last = F.greatest(F.lit(0), F.floor((F.octet_length(payload) - 1) / size)).cast("int")
    numbered = rows.withColumn("_last", last).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    return numbered.select(*columns, *pieces(F.col(payload), size))


def payloads(pages: DataFrame) -> DataFrame:
    """``page_id, url, mark, payload`` of ``pages(page_id, url, html)``; a null html is an empty payload."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    url = F.col("url").cast("string").alias("url")
    return pages.select("page_id", url, payload.alias("payload")).withColumn("mark", F.xxhash64("payload"))


def payload_chunks(pages: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table ``page_id, url, mark, chunk, last, data`` of some pages."""
    return with_chunks(payloads(pages), "payload", size, *RECORD)


def in_order(chunks: DataFrame) -> DataFrame:
    """A chunked record table that came in any order, each record whole in one partition."""
    return chunks.repartition(*RECORD).sortWithinPartitions(*RECORD, "chunk")


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha1, sha256, size, expected = hashlib.sha1(), hashlib.sha256(), 0, 0
    for batch in batches:
        ends, found = [], []
        numbers, lasts = batch.column("chunk").to_pylist(), batch.column("last").to_pylist()
        for row, (number, last, data) in enumerate(zip(numbers, lasts, batch.column("data"))):
            if number != expected:
                raise ValueError(f"chunk {number} where {expected} was due")
            if number == 0:
                sha1, sha256, size = hashlib.sha1(), hashlib.sha256(), 0
            piece = data.as_buffer()
            sha1.update(piece), sha256.update(piece)
            size += len(piece)
            expected = 0 if last else expected + 1
            if last:
                ends.append(row)
                found.append((size, base64.b32encode(sha1.digest()).decode(), sha256.hexdigest()))
        named = batch.select(RECORD).take(pa.array(ends, pa.int64()))
        sizes, ones, twos = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [*named.columns, pa.array(sizes, pa.int64()), pa.array(ones, pa.string()), pa.array(twos, pa.string())],
            names=[*RECORD, "n_bytes", "sha1", "sha256"],
        )


def chunk_digests(chunks: DataFrame) -> DataFrame:
    """``page_id, url, mark, n_bytes, sha1, sha256`` per record of a chunked record table in order."""
    kind = chunks.schema["page_id"].dataType.simpleString()
    return chunks.select(*RECORD, "chunk", "last", "data").mapInArrow(_digest_rows, DIGESTS.format(kind=kind))


def _name(page_id: Column, url: Column, mark: Column, sha1: Column, copy: Column) -> Column:
    """A record's name, made from what identifies it, so that a rerun writes the same archive."""
    missing = lambda c: F.coalesce(c.cast("string"), F.lit("\x00"))
    h = F.md5(F.concat_ws("\x01", missing(page_id), missing(url), mark.cast("string"), sha1, copy.cast("string")))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cuts))


def decide(digests: DataFrame, least: int = 0) -> DataFrame:
    """One row per distinct record of ``digests``, with what becomes of its ``times`` rows.

    ``bodies`` of them are written with their payload, the others refer to the record of the same
    payload with the greatest page id (null ids are least; then url), ``kept``. Payloads of fewer
    than ``least`` bytes are always written. Copies are counted before anything is joined.
    """
    payload = ["n_bytes", "sha1", "sha256"]
    each = digests.groupBy(*RECORD, *payload).agg(F.count(F.lit(1)).alias("times"))
    kept = each.groupBy(*payload).agg(F.max(F.struct(*RECORD)).alias("kept"))
    own = F.struct(*RECORD).eqNullSafe(F.col("kept"))
    bodies = F.when(F.col("n_bytes") < least, F.col("times")).when(own, F.lit(1)).otherwise(F.lit(0))
    return each.join(kept, payload).withColumn("bodies", bodies.cast("long"))


def archive_rows(pages: DataFrame, decided: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """The rows the writer takes: records with payloads in chunks, and records that only refer.

    Only payloads that are written are looked up in ``pages``, and those of repeated rows once.
    """
    name = lambda copy: _name(*(F.col(c) for c in (*RECORD, "sha1")), copy)
    kept = _name(*(F.col(f"kept.{c}") for c in RECORD), F.col("sha1"), F.lit(1))
    head = ["record_id", "page_id", "url", "n_bytes", "sha1", "refers_to_id", "refers_to"]
    nothing = [F.lit(None).cast("string").alias(c) for c in ("refers_to_id", "refers_to")]

    needed = decided.filter("bodies > 0").select(*(F.col(c).alias(f"_{c}") for c in RECORD), "n_bytes", "sha1", "times", "bodies")
    found = payloads(pages)
    same = [found[c].eqNullSafe(F.col(f"_{c}")) for c in RECORD]
    bodies = found.join(needed.filter("times = 1"), same).select(*RECORD, "payload", "n_bytes", "sha1", "bodies")
    repeated = needed.filter("times > 1")
    if not repeated.isEmpty():
        # Repeated rows bring their payload once; by its name, so that each task first reduces its own.
        rest = found.join(repeated, same).select(*RECORD, "payload", "n_bytes", "sha1", "bodies")
        rest = rest.withColumn("_name", name(F.lit(1))).groupBy("_name").agg(
            *(F.first(c).alias(c) for c in [*RECORD, "payload", "n_bytes", "sha1", "bodies"])
        )
        bodies = bodies.unionByName(rest.drop("_name"))
    bodies = bodies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("bodies"))))
    bodies = bodies.withColumn("record_id", name(F.col("copy"))).select("*", *nothing)
    referring = (
        decided.filter("times > bodies")
        .withColumn("copy", F.explode(F.sequence(F.col("bodies") + 1, F.col("times"))))
        .withColumn("record_id", name(F.col("copy")))
        .withColumn("refers_to_id", kept).withColumn("refers_to", F.col("kept.page_id").cast("string"))
    )
    as_text = lambda rows: rows.withColumn("page_id", F.col("page_id").cast("string"))
    return with_chunks(as_text(bodies), "payload", size, *head).unionByName(
        as_text(referring).select(*head, F.lit(0).alias("chunk"), F.lit(True).alias("last"), F.lit(None).cast("binary").alias("data"))
    )


def header_value(value: object) -> str:
    """A value that stays in its line: control characters and blanks are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def _record_head(fields: list[tuple[str, object]], size: int) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {size}"]
    return "\r\n".join([*lines, "", ""]).encode("utf-8", "replace")


class _Archive:
    """One archive file; each record is a gzip member of its own."""

    def __init__(self, out, name: str):
        self.out, self.records, self.bytes, self.member = out, 0, 0, None
        self.start([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, name).urn}>"),
                    ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], 0)
        self.end()

    def start(self, fields: list[tuple[str, object]], size: int) -> None:
        self.member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self.put(_record_head(fields, size))

    def put(self, data) -> None:
        self._out(self.member.compress(data))

    def end(self) -> None:
        self.put(END)
        self._out(self.member.flush())
        self.records += 1

    def _out(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.bytes += len(data)


def _fields(row: dict) -> list[tuple[str, object]]:
    refers = row["refers_to_id"]
    shown = lambda c: None if row[c] is None else header_value(row[c])
    return [
        ("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", f"<{row['record_id']}>"),
        ("WARC-Date", DATE), ("WARC-Target-URI", shown("url")), ("WARC-Payload-Digest", f"sha1:{row['sha1']}"),
        ("WARC-Profile", REVISIT_PROFILE if refers else None), ("WARC-Refers-To", f"<{refers}>" if refers else None),
        ("X-Refers-To-Page-ID", shown("refers_to")), ("X-Page-ID", shown("page_id")),
        ("X-Payload-Length", row["n_bytes"]), ("Content-Type", HTTP),
    ]


def write_warc(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``archive_rows`` as gzipped archives into a shared folder; ``file, records, bytes`` per file.

    A task writes one file after another, each with a record at least and closed at the first
    record border after ``file_bytes`` bytes. Files appear whole and a repeated task replaces its own. A payload whose
    chunks do not give its digest and length ends the job.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        rows = (
            (row, data) for batch in batches
            for row, data in zip(batch.drop_columns(["data"]).to_pylist(), batch.column("data"))
        )
        following, number, done = next(rows, None), 0, []
        while following:
            name = f"part-{task.partitionId():06d}-{number:04d}.warc.gz"
            with whole_file(f"{folder}/{name}", task.taskAttemptId()) as out:
                archive, sha1, size = _Archive(out, name), hashlib.sha1(), 0
                while following and (archive.bytes < file_bytes or archive.records == 1 or following[0]["chunk"]):
                    row, data = following
                    if row["chunk"] == 0:
                        body = HTTP_HEAD.format(size=row["n_bytes"]).encode()
                        archive.start(_fields(row), len(body) + (0 if row["refers_to_id"] else row["n_bytes"]))
                        archive.put(body)
                        sha1, size = hashlib.sha1(), 0
                    if data.is_valid:
                        piece = data.as_buffer()
                        sha1.update(piece)
                        size += len(piece)
                        archive.put(piece)
                    if row["last"]:
                        sound = (base64.b32encode(sha1.digest()).decode(), size) == (row["sha1"], row["n_bytes"])
                        if not (row["refers_to_id"] or sound):
                            raise ValueError(f"{row['record_id']}: chunks of {size} bytes do not give its digest")
                        archive.end()
                    following = next(rows, None)
            done.append((name, archive.records, archive.bytes))
            number += 1
        names, records, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())],
            names=["file", "records", "bytes"],
        )

    store, path = filesystem(folder)
    store.create_dir(path)
    return rows.mapInArrow(write, WRITTEN)


def _headers(stream: io.BufferedIOBase, path: str) -> dict[str, str]:
    found: dict[str, str] = {}
    while line := stream.readline(1 << 20).decode("utf-8", "replace"):
        if not line.endswith("\n"):
            break
        if not line.strip():
            return found
        key, _, value = line.partition(":")
        found[key.strip().lower()] = value.strip()
    raise ValueError(f"{path}: a header that does not end")


def read_records(stream: io.BufferedIOBase, path: str, size: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Rows of the chunked record table of one archive, in the order of ``READ``."""
    while line := stream.readline(1 << 16):
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{path}: no record where one is due")
        head = _headers(stream, path)
        left = int(head["content-length"])
        if head.get("content-type", "").startswith("application/http"):
            # The status line and the fields before the payload belong to the block.
            while left > 0 and (line := stream.readline(min(left, 1 << 20))):
                left -= len(line)
                if not line.strip():
                    break
        kind = head.get("warc-type")
        digest = head.get("warc-payload-digest", "")
        length = head.get("x-payload-length")
        named = (
            path.rsplit("/", 1)[-1], head.get("warc-record-id", "").strip("<>"), kind, head.get("x-page-id"),
            head.get("warc-target-uri"), head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
            head.get("x-refers-to-page-id"), digest.removeprefix("sha1:") if digest.startswith("sha1:") else None,
            int(length) if length else None,
        )
        sha1, done, chunk = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(size, left))
            if left and not data:
                raise ValueError(f"{path}: {named[1]} ends early")
            sha1.update(data)
            left, done = left - len(data), done + len(data)
            yield *named, chunk, left == 0, data, done, base64.b32encode(sha1.digest()).decode()
            chunk += 1
            if left == 0:
                break


def read_warc(spark: SparkSession, folder: str, size: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of all ``.warc`` and ``.warc.gz`` files of a folder.

    One row per chunk of at most ``size`` bytes, with the payload's bytes and SHA-1 so far; the row
    with ``last`` has those of the whole payload as it stands in the archive. Records that refer to
    another have no payload there: ``declared_digest`` and ``declared_bytes`` say what it is. A
    file is streamed, so neither it nor a record is held. A broken archive ends the job.
    """
    names = [c.split()[0] for c in READ.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            (n, {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}.get(k, pa.string()))
            for n, k in (c.split() for c in READ.split(", "))
        ])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for path in (p for found in batches for p in found.column("path").to_pylist()):
            store, place = filesystem(path)
            with store.open_input_stream(place, compression=None, buffer_size=1 << 20) as raw:
                stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw)
                held, bytes_held = [], 0
                for row in read_records(stream, path, size):
                    held.append(row)
                    bytes_held += len(row[names.index("data")])
                    if bytes_held >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                        yield batch(held)
                        held, bytes_held = [], 0
                if held:
                    yield batch(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(folder).select("path")
    return files.repartition(max(1, files.count()), "path").mapInArrow(read, READ)


def archive(pages: DataFrame, folder: str | None = None, least: int = 0, size: int = CHUNK_BYTES) -> str:
    """Write ``pages(page_id, url, html)`` as archives into ``folder``, by default a new shared one.

    Every row becomes one record. Of rows with equal payloads of at least ``least`` bytes the one
    with the greatest page id (null is least; then the greatest url) is a response, the others
    refer to it; of repeated rows one is the response. A null html is an empty payload, a null url
    or id leaves its field out. An empty table writes no file; other columns are ignored.
    """
    folder = folder or f"{scratch_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    digests = durable(chunk_digests(payload_chunks(pages, size)))
    decided = durable(decide(digests, least))
    durable(write_warc(archive_rows(pages, decided, size), folder))
    return folder


def warc_query(pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` as read from the archives."""
    kind = pages.schema["page_id"].dataType
    records = read_warc(pages.sparkSession, archive(pages)).filter("last and type in ('response', 'revisit')")
    response = F.col("type") == "response"
    return records.select(
        F.col("page_id").cast(kind).alias("page_id"),
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


SQL = """
with hashed as (
  select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex,
    first_value(page_id) over (partition by coalesce(html, '') order by page_id desc nulls last, url desc) as kept,
    row_number() over (partition by coalesce(html, '') order by page_id desc nulls last, url desc) as place
  from pages)
select page_id, strlen(body)::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, ((i // 4) * 5 + 1)::bigint, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31) + 1)::bigint, 1)), '')
    as payload_digest,
  case when place = 1 then 'response' else 'revisit' end as record_type,
  case when place > 1 then kept end as refers_to
from hashed
"""
