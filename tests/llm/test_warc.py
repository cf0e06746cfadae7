import base64
import gzip
import hashlib
import io

import pytest

from lorespark.llm import warc


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(rows, least=0):
    """Page, length, digest, kind and page referred to, by plain Python."""
    bodies = [(r[0], r[1] or "", (r[2] or "").encode()) for r in rows]
    rank = lambda r: (r[0] is not None, r[0] or 0, r[1])
    best, out = {}, []
    for r in bodies:
        if r[2] not in best or rank(r) > rank(best[r[2]]):
            best[r[2]] = r
    seen = set()
    for r in bodies:
        first = best[r[2]] == r and r[2] not in seen
        if len(r[2]) < least or first:
            if first:
                seen.add(r[2])
            out.append((r[0], len(r[2]), b32(r[2]), "response", None))
        else:
            out.append((r[0], len(r[2]), b32(r[2]), "revisit", best[r[2]][0]))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, "http://a/3", "é漢字" * 500),
    (4, None, None), (5, "http://a/5", ""), (None, "http://a/6", "<p>one</p>"), (7, "a b\r\nEvil: x", "x" * 5000),
    (8, "http://a/8", "same row"), (8, "http://a/8", "same row"), (8, "http://a/9", "same row"),
    (9, "http://a/9", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n"), (10, "u", "a" * 64), (11, "u", "a" * 64),
]
SCHEMA = "page_id long, url string, html string, sha1 string, chunk int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 5) for r in rows], SCHEMA)


def test_every_row_comes_back(spark):
    got = sorted((tuple(r) for r in warc.warc_query(frame(spark, ROWS)).collect()), key=str)
    assert got == expected(ROWS)
    assert warc.warc_query(frame(spark, ROWS).limit(0)).count() == 0


@pytest.mark.parametrize("size,file_bytes,least", [(64, 1500, 0), (7, 1, 20), (1 << 20, 1 << 20, 1000)])
def test_small_chunks_files_and_payloads(spark, tmp_path, size, file_bytes, least):
    pages = frame(spark, ROWS)
    digests = warc.chunk_digests(warc.payload_chunks(pages, size))
    rows = warc.archive_rows(pages, warc.decide(digests, least), size)
    assert max(len(r.data) for r in rows.filter("data is not null").collect()) <= size
    files = warc.write_warc(rows.coalesce(2), str(tmp_path), file_bytes).collect()
    assert sum(f.records for f in files) == len(ROWS) + len(files)  # and one that describes each file
    assert all((tmp_path / f.file).stat().st_size == f.bytes for f in files)
    found = warc.read_warc(spark, str(tmp_path), size).collect()
    texts, ends = {}, []
    for r in sorted(found, key=lambda r: (r.file, r.record_id, r.chunk)):
        if r.type == "warcinfo":
            continue
        texts[r.record_id] = texts.get(r.record_id, b"") + r.data
        assert (len(texts[r.record_id]), b32(texts[r.record_id])) == (r.bytes_so_far, r.digest_so_far)
        if r.last:
            ends.append(r)
    assert len({r.record_id for r in ends}) == len(ROWS)
    got = [
        (int(r.page_id) if r.page_id else None, r.declared_bytes, r.declared_digest, r.type, int(r.refers_to) if r.refers_to else None)
        for r in ends
    ]
    assert sorted(got, key=str) == expected(ROWS, least)
    by_id = {r.record_id: r for r in ends}
    for r in ends:
        if r.type == "revisit":
            kept = by_id[r.refers_to_id]
            assert (kept.type, kept.declared_digest, r.bytes_so_far) == ("response", r.declared_digest, 0)
        else:
            assert r.digest_so_far == r.declared_digest


def test_chunks_in_any_order(spark):
    chunks = warc.payload_chunks(frame(spark, ROWS[:7]), 16).repartition(5)
    got = sorted((tuple(r)[:1] + tuple(r)[3:5] for r in warc.chunk_digests(warc.in_order(chunks)).collect()), key=str)
    assert got == sorted(((r[0], len((r[2] or "").encode()), b32((r[2] or "").encode())) for r in ROWS[:7]), key=str)


def test_members_plain_files_and_other_records(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello"
    record = lambda kind, body, more="": (
        f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{kind}>\r\n{more}Content-Length: {len(body)}\r\n\r\n".encode()
        + body + b"\r\n\r\n"
    )
    content = [record("request", b"GET / HTTP/1.1\r\n\r\n"), record("response", block, "Content-Type: application/http\r\n"), record("metadata", b"")]
    (tmp_path / "plain.warc").write_bytes(b"".join(content))
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(gzip.compress(c) for c in content))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = sorted((r.file, r.type, bytes(r.data), r.declared_bytes) for r in warc.read_warc(spark, str(tmp_path)).collect())
    want = [("metadata", b"", None), ("request", b"GET / HTTP/1.1\r\n\r\n", None), ("response", b"hello", None)]
    assert got == sorted((f, *w) for f in ("plain.warc", "packed.warc.gz") for w in want)


@pytest.mark.parametrize("broken", [b"junk\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort", b"WARC/1.1\r\nContent-Le"])
def test_broken_archives_are_refused(broken):
    with pytest.raises((ValueError, KeyError)):
        list(warc.read_records(io.BytesIO(broken), "x.warc"))


def test_wrong_payloads_are_not_written(spark, tmp_path):
    pages = frame(spark, ROWS[:3])
    decided = warc.decide(warc.chunk_digests(warc.payload_chunks(pages))).selectExpr("*").replace(ROWS[2][1], "other", ["url"])
    rows = warc.archive_rows(pages, decided).selectExpr("* except (sha1)", "'WRONG' as sha1")
    with pytest.raises(Exception, match="do not give its digest"):
        warc.write_warc(rows, str(tmp_path)).collect()
