import random

import numpy as np
import pytest

from lorespark.llm import packing, token_files, tokens

FOLDER = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " "), (4, "x " * 9000), (5, "<|endoftext|> é漢"), (5, "same"), (5, "same"), (None, "no id"), (6, "\n" * 200_000)]


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder()


def test_segments_change_nothing(encoder):
    text = " ".join("ab  cd\n\nef, 12"[: 3 + i % 11] for i in range(3000))
    whole = encoder.encoding.encode_ordinary(text)
    for size in (64, 500, 5000):
        parts = list(tokens.segments(text, size))
        assert "".join(parts) == text and max(map(len, parts)) <= size
        assert [i for p in parts for i in encoder.encoding.encode_ordinary(p)] == whole
    assert encoder.encoding.decode(encoder.ids("\n" * 300_000).tolist()) == "\n" * 300_000


def test_counts_of_files_with_borders_everywhere(spark, tmp_path):
    rng, want = random.Random(2), []
    for f, tail in enumerate((0, 3, 0)):
        lengths = [rng.choice((0, 0, 1, 2, 7, 30)) for _ in range(40)]
        ids = np.concatenate([np.r_[np.full(n, 5), 9] for n in lengths] + [np.full(tail, 5)]).astype("<u2")
        (tmp_path / f"t{f}.bin").write_bytes(ids.tobytes() + (b"\x01" if f else b""))
        starts = np.cumsum([0, *(n + 1 for n in lengths)])
        want += [(f"t{f}.bin", i, int(starts[i]), n) for i, n in enumerate([*lengths, tail][: 40 + (tail > 0)])]
    (tmp_path / "empty.bin").write_bytes(b"")
    for block in (2, 6, 64, 1 << 20):
        got = token_files.scan_token_files(spark, str(tmp_path), 9, block_bytes=block)
        assert sorted(map(tuple, got.collect())) == want


def test_counts_of_documents(spark, encoder):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    got = sorted((r.doc_id or -1, r.n_tokens) for r in token_files.token_counts(docs, block_bytes=1 << 12).collect())
    assert got == sorted((r.doc_id or -1, len(encoder.ids(r.text))) for r in docs.collect())
    assert token_files.token_counts(docs.limit(0)).count() == 0


def test_best_fit_against_plain_search():
    rng = random.Random(4)
    for _ in range(60):
        most = rng.randrange(1, 40)
        sizes = np.array([rng.randrange(1, most + 1) for _ in range(rng.randrange(0, 80))], int)
        free = []
        for s in sorted(sizes.tolist(), reverse=True):
            fit = min((i for i, f in enumerate(free) if f >= s), key=lambda i: free[i], default=None)
            if fit is None:
                free.append(most - s)
            else:
                free[fit] -= s
        rows = packing.best_fit(sizes, most)
        assert sorted(most - int(sizes[r].sum()) for r in rows) == sorted(free)
        assert sorted(p for r in rows for p in r) == list(range(len(sizes)))


def test_packed_rows_give_the_documents_back(spark, encoder, tmp_path):
    docs = spark.createDataFrame([(*r, b"x", 0) for r in ODD], "doc_id long, text string, ids binary, row int")
    packed = packing.pack(docs.coalesce(1), row_tokens=64, block_tokens=5000)
    found = {}
    rows = packed.collect()
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == 64 and r.cu_seqlens[-1] == r.n_tokens <= 64 and not ids[r.n_tokens :].any()
        for a, b, doc_id, piece in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.pieces):
            assert positions[a:b].tolist() == list(range(b - a))
            found.setdefault(doc_id, []).append((r.block, piece, ids[a:b].tolist()))
    for doc_id in {r[0] for r in ODD} - {5}:
        text = next(t for i, t in ODD if i == doc_id)
        ids = [i for _, _, p in sorted(found[doc_id]) for i in p]
        assert ids.count(tokens.END) == 1 and encoder.encoding.decode(ids[:-1]) == (text or "")
    assert len(found[5]) == 3
    assert packing.pack(docs.limit(0)).count() == 0
    files = packing.write_matrices(packed.coalesce(1), str(tmp_path), 64).collect()
    matrix = np.fromfile(tmp_path / f"ids-{files[0].file}", "<u2").reshape(-1, 64)
    assert files[0].rows == len(matrix) == len(rows)
    assert sorted(m.tobytes() for m in matrix) == sorted(bytes(r.ids) for r in rows)
    assert (np.fromfile(tmp_path / f"segments-{files[0].file}", "<i4") == 0).sum() == len(rows)


def test_rows_are_read_from_the_matrices(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").coalesce(2)
    key = lambda r: (r.part, r.block, r.row)
    want = sorted(packing.pack(docs, 64).collect(), key=key)
    monkeypatch.setattr(packing, "scratch_folder", lambda _: str(tmp_path))
    got = packing.pack_files(docs, 64)
    assert sorted(got.collect(), key=key) == want
    assert got.schema == packing.pack(docs, 64).schema
    folder = next(tmp_path.iterdir())
    assert {f.name.split("-")[0] for f in folder.glob("*.bin")} == {"ids", "positions", "segments", "index"}
    assert sum(f.stat().st_size for f in folder.glob("ids-*.bin")) == len(want) * 128
    assert packing.pack_files(docs.limit(0), 64).count() == 0


def test_the_query_writes_matrices(spark, monkeypatch):
    from lorespark.llm.queries import QUERIES

    folders = []
    write = packing.write_matrices
    monkeypatch.setattr(packing, "write_matrices", lambda rows, folder, n: folders.append(folder) or write(rows, folder, n))
    assert QUERIES["op7_pack_tokens"](spark, FOLDER).count() and len(folders) == 1


def test_packing_takes_one_python_process_a_task(spark, tmp_path, monkeypatch):
    plans = []
    write = packing.write_matrices

    def seen(*given):
        out = write(*given)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(packing, "write_matrices", seen)
    monkeypatch.setattr(packing, "scratch_folder", lambda _: str(tmp_path))
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    assert packing.pack_files(docs, 64).count()
    assert sum(plans[0].count(f"{kind} write") + plans[0].count(f"{kind} run") for kind in ("MapInArrow", "MapInPandas")) == 1


def test_blocks_within_a_batch_keep_their_documents(spark, encoder):
    docs = [(f"d{i}" if i % 5 else None, "ab " * (i % 7)) for i in range(700)]
    frame = spark.createDataFrame(docs, "doc_id string, text string").coalesce(1)
    rows = packing.pack(frame, row_tokens=16, block_tokens=100).collect()
    got = sorted(
        (d or "", np.frombuffer(r.ids, "<u2")[a:b].tolist())
        for r in rows for d, a, b in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:])
    )
    assert got == sorted((d or "", [*encoder.ids(t).tolist(), tokens.END]) for d, t in docs)
    assert len({r.block for r in rows}) > 20
