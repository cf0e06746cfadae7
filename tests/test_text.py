"""Chunking, terms, file names, globs and embedding."""

import fnmatch
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorespark.functions.text import any_glob, glob_regex, terms
from lorespark.operators import embedding
from lorespark.operators.chunking import (
    chunk_config,
    symbol_chunk,
    tag_language,
    token_chunk,
)
from lorespark.operators.embedding import check_dimension, embed, hashed_bag, model_dimension
from lorespark.operators.export import page_filename
from lorespark.operators.ingest import chunk_contents
from lorespark.operators.keyword import build_postings
from lorespark.schemas import CONTENTS


def contents(spark, *rows):
    return spark.createDataFrame(
        [(str(i), "kb", 0, text, meta) for i, (text, meta) in enumerate(rows)], CONTENTS
    )


def pieces(df):
    return [r.content for r in df.orderBy("source_id", "chunk_index").collect()]


def test_chunk_config_rules():
    assert chunk_config() == (512, 64)
    for size, overlap in ((0, 0), (10, -1), (10, 10), (10, 11)):
        with pytest.raises(ValueError):
            chunk_config(size, overlap)


@pytest.mark.parametrize("n,size,overlap", [(200, 50, 10), (100, 20, 5), (40, 50, 10), (1, 5, 0)])
def test_window_count_and_overlap(spark, n, size, overlap):
    text = " ".join(str(i) for i in range(n))
    got = pieces(token_chunk(contents(spark, (text, {})), size, overlap))
    assert len(got) == math.ceil(n / (size - overlap))
    for a, b in zip(got, got[1:]):
        tail = a.split()[size - overlap :]
        assert b.split()[: len(tail)] == tail


def test_windows_without_overlap_restore_the_text(spark):
    text = "  A b\n\n c\td   e \r\nf  "
    assert "".join(pieces(token_chunk(contents(spark, (text, {})), 2, 0))) == text


def test_empty_text_gives_nothing_and_metadata_is_copied(spark):
    df = token_chunk(contents(spark, ("", {"a": "1"}), ("x", {"b": "2"})), 5, 1)
    assert [r.metadata for r in df.collect()] == [{"b": "2"}]


CODE = """LIMIT = 3

class Queue:
    items = []

def drain(queue):
    while queue.items:
        yield queue.items.pop()
"""


def test_python_symbols(spark):
    df = symbol_chunk(contents(spark, (CODE, {"language": "python"})), 512, 0)
    rows = df.orderBy("chunk_index").collect()
    assert [(r.symbol_type, r.symbol_name) for r in rows] == [
        ("module", None),
        ("class", "Queue"),
        ("function", "drain"),
    ]
    assert "".join(r.content for r in rows) == CODE


def test_large_symbol_is_cut_and_keeps_its_name(spark):
    body = "def total(rows):\n" + "    rows.append(sum(rows))\n" * 90 + "    return rows\n"
    rows = symbol_chunk(contents(spark, (body, {"language": "python"})), 40, 8).collect()
    assert len(rows) > 1 and {(r.symbol_type, r.symbol_name) for r in rows} == {("function", "total")}


def test_javascript_export_class_is_no_start_but_typescript_has_it(spark):
    text = "export class A {}\nexport async function f() {}\nclass B {}\n"
    df = symbol_chunk(
        contents(spark, (text, {"language": "javascript"}), (text, {"language": "typescript"}))
    )
    got = {}
    for r in df.orderBy("source_id", "chunk_index").collect():
        got.setdefault(r.source_id, []).append((r.symbol_type, r.symbol_name))
    assert got["0"] == [("module", None), ("function", "f"), ("class", "B")]
    assert got["1"] == [("class", "A"), ("function", "f"), ("class", "B")]


def test_other_language_and_no_symbol_fall_back(spark):
    df = symbol_chunk(
        contents(spark, ("a b c", {"language": "unknown"}), ("x = 1", {"language": "python"})), 2, 0
    )
    assert {r.symbol_type for r in df.collect()} == {None}
    assert df.count() == 4


def test_chunk_contents_puts_symbols_into_metadata(spark):
    df = chunk_contents(contents(spark, (CODE, {"language": "python"}), ("plain", {"k": "v"})))
    metas = [r.metadata for r in df.orderBy("source_id", "chunk_index").collect()]
    assert metas[1] == {"language": "python", "symbol_type": "class", "symbol_name": "Queue"}
    assert metas[0] == {"language": "python", "symbol_type": "module"}
    assert metas[-1] == {"k": "v"}
    assert df.select("chunk_id").distinct().count() == df.count()


def test_language_tags(spark):
    paths = {"a/b.PY": "python", "x.tsx": "typescript", "y.txt": "unknown", ".bash": "unknown"}
    df = tag_language(contents(spark, *[("t", {"file_path": p}) for p in paths]))
    assert {r.metadata["file_path"]: r.metadata["language"] for r in df.collect()} == paths


@pytest.mark.parametrize(
    "title,name",
    [
        ("Quarterly Sales, North", "quarterly-sales-north.md"),
        ("etc/hosts [old] <v2>", "etc-hosts-old-v2.md"),
        ("..draft__of - things..", "draft-of-things.md"),
        ("Straße Nº 7 – ½", "straße-nº-7-½.md"),
        ("漢字 と kana", "漢字-と-kana.md"),
        ("one\ttwo\n", "one-two.md"),
        ("?!", ".md"),
    ],
)
def test_file_names(spark, title, name):
    row = spark.range(1).select(page_filename(F.lit(title)).alias("n")).first()
    assert row.n == name


@settings(max_examples=300, deadline=None)
@given(
    st.text("ab*?[]!^.-/\\", min_size=1, max_size=6),
    st.text("ab^!.-/\\[]", max_size=6),
)
def test_glob_agrees_with_fnmatch(glob, path):
    if "[" in glob:  # class corner cases (reversed ranges) are errors in one engine only
        try:
            pattern = re.compile(rf"(?s)\A(?:{glob_regex(glob)})\Z")
        except re.error:
            return
        if re.search(r"\[[^\]]*-|&&|~~|\|\|", glob):
            return
    else:
        pattern = re.compile(rf"(?s)\A(?:{glob_regex(glob)})\Z")
    assert bool(pattern.match(path)) == fnmatch.fnmatchcase(path, glob)


def test_any_glob_empty():
    assert any_glob([]) is None


def test_postings_fold_and_count(spark):
    pages = spark.createDataFrame(
        [("p", "kb", "Café", "the Cafe THE", ["x"])],
        "page_id string, kb_id string, title string, content string, tags array<string>",
    )
    got = {r.term: (r.tf, r.doc_len) for r in build_postings(pages).collect()}
    assert got == {"cafe": (2, 5), "the": (2, 5), "x": (1, 5)}


def test_embedding_is_unit_length_and_ordered(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b a"), (3, ""), (4, "c c c")], "i int, content string")
    got = {r.i: r.embedding for r in embed(df, embedder=hashed_bag(16)).collect()}
    assert got[1] == got[2] and len(got[1]) == 16
    assert math.isclose(sum(x * x for x in got[1]), 1, abs_tol=1e-6)
    assert set(got[3]) == {0.0}
    assert max(got[4]) == 1.0


def test_dimensions(spark):
    assert model_dimension("text-embedding-3-large") == 3072
    assert model_dimension("something else") == 1536
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "embedding array<float>")
    good, rejects = check_dimension(df, 2)
    assert (good.count(), rejects.count()) == (1, 2)


def test_start_of_two_lines_is_one_boundary(spark):
    text = "// head\nexport\nfunction first() {}\nexport async\nfunction second() {}\nclass Third {}\n"
    rows = symbol_chunk(contents(spark, (text, {"language": "javascript"}), ("class\nOnly {}", {"language": "javascript"})), 512, 0)
    got = sorted((r.source_id, r.chunk_index, r.symbol_type, r.symbol_name, r.content) for r in rows.collect())
    assert [g[2:4] for g in got] == [("module", None), ("function", "first"), ("function", "second"), ("class", "Third"), ("class", "Only")]
    assert "".join(g[4] for g in got[:4]) == text


def test_marks_after_letters_stay_in_the_word(spark):
    df = spark.createDataFrame([("Cafe\u0301 nai\u0308ve caf\u00e9",)], "t string")
    assert df.select(terms(F.col("t"))).first()[0] == ["cafe", "naive", "cafe"]


def test_bag_hashes_a_term_once_a_batch(monkeypatch):
    rows = [["a", "b", "a"], [], None, ["c", "a"] * 40, ["b"]] * 9
    buckets = {t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 8 for t in "abc"}
    want = []
    for row in rows:
        counts = [sum(buckets[t] == b for t in row or []) for b in range(8)]
        norm = sum(n * n for n in counts) ** 0.5 or 1.0
        want.append([float(np.float32(n / norm)) for n in counts])
    hashed = []
    md5 = hashlib.md5
    monkeypatch.setattr(embedding.hashlib, "md5", lambda t: hashed.append(t) or md5(t))
    for cells in (1 << 20, 24, 1):
        monkeypatch.setattr(embedding, "BAG_CELLS", cells)
        assert embedding.bag_vectors(pa.array(rows, pa.list_(pa.string())), 8).to_pylist() == want
        assert sorted(hashed) == [b"a", b"b", b"c"]
        hashed.clear()
    assert embedding.bag_vectors(pa.array([], pa.list_(pa.string())), 8).to_pylist() == []
