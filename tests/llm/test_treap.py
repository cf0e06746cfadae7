import math
import random
import re

import numpy as np
import pytest

from lorespark.llm import treap


def terms(text):
    return re.findall(treap.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """Every document scored for every distinct item."""
    split = [(d, terms(t)) for d, t in docs]
    split = [(d, w) for d, w in split if w]
    n_docs, n_terms = len(split), sum(len(w) for _, w in split)
    out = []
    for name, text in set(items):
        found = []
        for d, w in split:
            score = 0
            for t in set(terms(text)):
                df, tf = sum(t in x for _, x in split), w.count(t)
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                m = 100 - 50 + (50 * len(w) * n_docs) // n_terms
                score += weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(name, i + 1, None if x[1] else x[2], -x[0]) for i, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def sample(rng, n):
    return " ".join(rng.choice("the of And tree Baum été 漢 x1 fox,quick".split()) for _ in range(n))


def tables(spark):
    rng = random.Random(2)
    docs = [(i * 7 % 101, sample(rng, rng.randrange(0, 30)) + f" word{i % 9} rare{i}") for i in range(101)]
    docs += [(200, None), (201, ""), (202, "?! ."), (203, "same same"), (203, "same same"), (204, "same same"), (None, "same same")]
    docs += [(205, "long " * 3000 + "rare5"), (None, "rare7 the")]
    items = [(f"i{j}", sample(rng, 3) + f" rare{j * 10} word{j}") for j in range(8)]
    items += [("none", None), ("empty", ""), ("absent", "nowhere"), ("same", "same"), ("same", "same"), ("same", "rare7"), (None, "long the")]
    return docs, items


def frames(spark, docs, items, parts=3):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, score int, term string").repartition(parts)
    return d, spark.createDataFrame([(*r, 2) for r in items], "item_id string, text string, rank int")


@pytest.mark.parametrize("k,job,few", [(50, 1 << 18, 1 << 13), (3, 10, 4)])
def test_ranks_agree_with_brute_force(spark, monkeypatch, k, job, few):
    monkeypatch.setattr(treap, "JOB_TERMS", job)
    monkeypatch.setattr(treap, "PASS_TERMS", few)
    docs, items = tables(spark)
    got = treap.ranked_search(*frames(spark, docs, items), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, k)


def test_empty_tables(spark):
    docs, items = frames(spark, *tables(spark))
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("doc_id between 200 and 202"), items)):
        assert treap.ranked_search(d, i).collect() == []


def test_grid_holds_every_entry():
    rng = np.random.default_rng(1)
    for rows, columns in ((1, 1), (3, 40), (700, 5), (64, 64)):
        cells = np.unique(rng.integers(0, rows * columns, rows * columns // 2 + 1))
        r, c = cells // columns, cells % columns
        v = rng.integers(1, 1000, len(cells))
        grid = treap.Grid.of(*treap.build(r, c, v))
        found = []

        def walk(cell, level, row, column, above):
            assert grid.largest[cell] <= above
            if level == grid.levels:
                found.append((row, column, int(grid.largest[cell])))
                return int(grid.largest[cell])
            mask, child, best = int(grid.quarters[cell]), int(grid.first[cell]), 0
            for bit in range(4):
                if mask >> bit & 1:
                    best = max(best, walk(child, level + 1, row * 2 + (bit >> 1), column * 2 + (bit & 1), grid.largest[cell]))
                    child += 1
            assert best == grid.largest[cell]
            return best

        walk(0, 0, 0, 0, 1 << 40)
        assert sorted(found) == sorted(zip(r.tolist(), c.tolist(), v.tolist()))


@pytest.mark.parametrize("step", [1, 50, 1 << 19])
def test_descent_finds_the_best(monkeypatch, step):
    monkeypatch.setattr(treap, "STEP_ENTRIES", step)
    rng = np.random.default_rng(step)
    rows, columns = 50, 300
    cells = np.unique(rng.integers(0, rows * columns, 4000))
    r, c, v = cells // columns, cells % columns, rng.integers(1, 6, len(cells))
    table = np.zeros((rows, columns), np.int64)
    table[r, c] = v
    grid = treap.Grid.of(*treap.build(r, c, v))
    item = np.repeat(np.arange(6), 7)
    row = np.concatenate([rng.choice(rows, 7, replace=False) for _ in range(6)])
    weight = rng.integers(1, 4, len(item))
    best = treap.Best(6, 10)
    treap.descend(grid, item, row, weight, best, np.arange(columns))
    for i in range(6):
        scores = (table[row[item == i]] * weight[item == i][:, None]).sum(0)
        want = sorted((-int(s), d) for d, s in enumerate(scores) if s > 0)[:10]
        mine = best.item == i
        assert list(zip((-best.score[mine]).tolist(), best.doc[mine].tolist())) == want
