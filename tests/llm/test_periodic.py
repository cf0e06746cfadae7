import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from lorespark.llm import periodic


def brute(words):
    """Start, length and period of every maximal run, by comparing all places of each period."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(
                q % p == 0 and s <= i and i + length <= s + m for s, m, p in found if p < q
            ):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def sample(rng, trial):
    letters = ["ab", "abc", "abcdefgh", "a"][trial % 4]
    words = [rng.choice(letters) for _ in range(rng.randrange(0, 60))]
    for _ in range(rng.randrange(0, 4)):
        unit = [rng.choice(letters) for _ in range(rng.randrange(1, 9))]
        if words and rng.random() < 0.4:
            a = rng.randrange(len(words))
            unit = words[a : a + rng.randrange(1, 12)]
        at = rng.randrange(0, len(words) + 1)
        words[at:at] = unit * rng.randrange(1, 8) + unit[: rng.randrange(0, len(unit) + 1)]
    return words


def test_runs_agree_with_brute_force():
    rng = random.Random(3)
    for trial in range(600):
        docs = [sample(rng, rng.randrange(4)) for _ in range(rng.randrange(1, 6))]
        docs += [docs[0]] * rng.randrange(0, 3)
        number = {}
        ids = np.array([number.setdefault(w, len(number)) for d in docs for w in d], np.int64)
        got = periodic.find_runs(ids, np.cumsum([0, *(len(d) for d in docs)]))
        want = [(k, *r) for k, d in enumerate(docs) for r in brute(d)]
        assert [tuple(r) for r in got.tolist()] == want, docs


def test_grammar_holds_the_text_and_no_pair_twice():
    rng = random.Random(4)
    for trial in range(100):
        words = np.array([ord(w) for w in sample(rng, trial)] or [1], np.int64)
        rule, start, middle, stop, leaf, leaf_stop = periodic.repair(words, np.array([0, len(words)]))
        assert leaf.tolist() == [0, *leaf_stop[:-1].tolist()] and leaf_stop[-1] == len(words)
        spelled = {}
        for r, a, m, b in zip(rule.tolist(), start.tolist(), middle.tolist(), stop.tolist()):
            assert a < m < b
            assert spelled.setdefault(r, words[a:b].tolist()) == words[a:b].tolist()
        left = [tuple(words[a:b]) for a, b in zip(leaf, leaf_stop)]
        pairs = [p for p in zip(left, left[1:]) if p[0] != p[1]]
        by_symbol = {}
        for r, a, b in zip(rule.tolist(), start.tolist(), stop.tolist()):
            by_symbol[(a, b)] = r
        names = [by_symbol.get((a, b), words[a]) for a, b in zip(leaf.tolist(), leaf_stop.tolist())]
        pairs = [p for p in zip(names, names[1:]) if p[0] != p[1]]
        assert len(pairs) == len(set(pairs))


def test_long_texts_of_one_pattern():
    for unit, times in (([1], 50_000), ([1, 2, 3], 20_000), (list(range(700)), 40)):
        ids = np.array([9999] + unit * times + [8888], np.int64)
        got = periodic.find_runs(ids, np.array([0, len(ids)]))
        assert got.tolist() == [[0, 1, len(unit) * times, len(unit)]]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


def check(spark, rows, monkeypatch, block=50):
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n_runs int, kept string")
    got = [tuple(r) for r in periodic.runs_query(docs).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted((expected(*r) for r in rows), key=key)


def test_query_agrees_with_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " \t".join(sample(rng, i))) for i in range(300)]
    rows += [(301, None), (302, ""), (303, " \n "), (None, "a a a a a a"), (304, "é " * 9), (304, "é " * 9), (305, "x y " * 8)]
    check(spark, rows, monkeypatch)


def test_blocks_long_texts_and_empty_tables(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(sample(rng, i))) for i in range(40)] + [(99, "one two three " * 30_000), (100, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    small = periodic.periodic_runs(docs, block_words=64).collect()
    large = periodic.periodic_runs(docs).collect()
    assert sorted(small) == sorted(large)
    long = next(r for r in large if r.doc_id == 99)
    assert (long.n_words, [tuple(r) for r in long.runs], long.kept) == (90_000, [(0, 90_000, 3)], "one two three")
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    assert periodic.runs_query(docs.filter(F.lit(False))).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in periodic.runs_query(docs).collect())
    want = sorted(expected(r.doc_id, r.text) for r in docs.collect() if len((r.text or "").split()) < 900)
    ids = {w[0] for w in want}
    assert [g for g in got if g[0] in ids] == want
