"""Removal of repeated byte strings against a plain scan."""

import hashlib
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lorespark.llm import repeats
from lorespark.llm.repeats import repeats_query, sliding_min

SCHEMA = "doc_id long, text string, spans int"


def brute(rows, length=100):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (text or "").encode("utf-8", "surrogatepass")
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            string = data[i : i + length]
            if string in seen:
                gone[i : i + length] = [True] * length
            seen.add(string)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats_query(df).collect()}
    assert got == brute(rows)
    return got


def test_repeats_of_all_kinds(spark):
    rng = random.Random(5)
    words = [f"w{i}é" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = prose(60), "-" * 350
    rows = [(i, prose(rng.randrange(5, 80)) + passage[rng.randrange(100) :] + prose(20)) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    rows += [(200, line), (201, "a" + line), (202, "ab" * 120), (203, "ba" * 120), (204, passage * 3)]
    rows += [(300, None), (301, ""), (302, "x" * 99), (303, "x" * 100), (304, "x" * 100), (None, passage)]
    got = check(spark, rows)
    assert got[None][1] and got[304][1] == 100 and got[303][1] == 0


def test_texts_longer_than_a_part(spark, monkeypatch):
    # Runs in this process: tasks carry the module by value.
    monkeypatch.setattr(repeats, "PART", 300)
    rng = random.Random(6)
    text = "".join(rng.choice("abcdef ") for _ in range(2000))
    check(spark, [(1, text), (2, text[500:1500]), (3, text[::-1] + text[100:900])])


def test_repeated_rows_and_no_rows(spark):
    text = "some words " * 5 + "that stand once in the text and are long enough to be looked at as a whole string of bytes"
    df = spark.createDataFrame([(1, text, 1)] * 2, SCHEMA)
    assert [r.n_removed for r in repeats_query(df).collect()] == [0, 0]
    assert repeats_query(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_rows_of_one_batch(spark):
    text = "some words " * 5 + "that stand once in the text and are long enough to be looked at as a whole string of bytes"
    other = "".join(random.Random(7).choices("abcdef ", k=300))
    rows = [(1, text, 1)] * 2 + [(None, other, 1)] * 3 + [(4, text + other, 1)] * 2
    for parts in (1, 7):
        df = spark.createDataFrame(rows, SCHEMA).repartition(7).coalesce(parts)
        got = sorted((r.doc_id or 9, r.n_bytes, r.n_removed) for r in repeats_query(df).collect())
        assert got == [(1, len(text), 0)] * 2 + [(4, len(text + other), len(text))] * 2 + [(9, 300, 300)] * 3
    alone = spark.createDataFrame([(None, other, 1)] * 3, SCHEMA).coalesce(1)
    assert [r.n_removed for r in repeats_query(alone).collect()] == [0, 0, 0]


def test_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats_query(docs).collect()}
    assert got == brute(rows)


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 1 << 60, 300).astype(np.uint64)
    for width in (1, 2, 5, 64, 69):
        assert (sliding_min(x, width) == [x[i : i + width].min() for i in range(len(x) - width + 1)]).all()


def test_copies_of_a_batch_travel_as_runs():
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefgh ", k=4000)) for _ in range(3)]
    batch = pd.DataFrame([(i, 0, texts[i % 3]) for i in range(30)], columns=["doc", "mark", "text"])
    (rows,) = repeats._stretch_rows(iter([batch]), 100)
    runs = rows[rows["repeated"]]
    assert list(zip(runs["doc"], runs["start"], runs["counts"] // 101)) == [(i, 0, 3901) for i in range(3, 30)]
    assert (rows["doc"][~rows["repeated"]] < 3).all()


def test_near_copies(spark):
    rng = random.Random(9)
    text = "".join(rng.choices("abcdefgh ", k=1500))
    rows = []
    for i in range(40):
        own = list(text)
        for at in rng.sample(range(1500), rng.choice([1, 5, 20])):
            own[at] = rng.choice("XYZ")
        rows.append((i, "".join(own[rng.randrange(200) :])))
    check(spark, rows)


def test_texts_of_one_id(spark, monkeypatch):
    rng = random.Random(10)
    one, two, three = ("".join(rng.choices("abcdefgh ", k=300)) for _ in range(3))
    rows = [(1, one + two), (1, two + three), (1, two + three), (2, three), (None, one), (None, one + "!")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)
    assert {r.mark == 0 for r in marked(df).collect() if r.doc == 2} == {True}
    for most in (10, 0):
        monkeypatch.setattr(repeats, "FETCH_ROWS", most)
        got = sorted((r.doc_id or 9, r.n_bytes, r.n_removed) for r in repeats_query(df).collect())
        first = sum(n for i, _, n in got if i == 1)
        # `two` goes from one of the texts of id 1: from the single row or from both equal ones.
        assert first in (300, 600) and got[3:] == [(2, 300, 300), (9, 300, 300), (9, 301, 300)]


def marked(df):
    return repeats._marked(df.select(F.col("doc_id").alias("doc"), "text", F.xxhash64("text").alias("mark")))
