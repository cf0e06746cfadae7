"""Near-duplicate vectors against all pairs."""

import numpy as np

from lorespark.llm import embedding_dups
from lorespark.llm.embedding_dups import BLOCK, embedding_links

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute(rows, threshold=0.98):
    good = [
        r for r in rows
        if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
    ]
    links, parent = {}, {r[0]: r[0] for r in rows}

    def end(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(good):
        for b in good[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links.setdefault(a[0], set()).add(b[0])
                    links.setdefault(b[0], set()).add(a[0])
                    x, y = sorted((end(a[0]), end(b[0])))
                    parent[y] = x
    return {r[0]: (len(links.get(r[0], ())), end(r[0])) for r in rows}, links


def test_close_vectors_and_odd_rows(spark):
    random = np.random.default_rng(3)
    rows = []
    for g in range(60):
        base = random.standard_normal(32)
        for k in range(1 + g % 4):
            noise = 0.02 if k % 2 else 0
            rows.append((len(rows), (base + noise * random.standard_normal(32)).tolist(), g % 3, "x"))
    rows += [(1000 + i, v, 1, "x") for i, v in enumerate(
        [None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] * 32, [float("inf")] * 32, [1.0, 2.0], [2.0, 4.0]])]
    rows += [(2000, rows[0][1], None, "x"), (2001, rows[0][1], 0, "x"), (2002, rows[0][1], 2, "x")]
    expected, _ = brute(rows)
    got = embedding_links(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_a_group_larger_than_a_block(spark):
    random = np.random.default_rng(4)
    base = random.standard_normal(16)
    size = BLOCK + 200
    rows = [(i, (base + 1e-3 * random.standard_normal(16)).tolist(), 0, "x") for i in range(size)]
    got = embedding_links(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component_id for r in got} == {0}
    assert sum(r.n_links for r in got) >= 0.9 * size * (size - 1)


def test_no_rows(spark):
    assert embedding_links(spark.createDataFrame([], SCHEMA)).collect() == []


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label, "") for r in table.collect()]
    expected, _ = brute(rows)
    got = {r.vec_id: r for r in embedding_links(table).collect()}
    assert set(got) == set(expected)
    assert all(got[v].n_links <= n for v, (n, _) in expected.items())
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(n for n, _ in expected.values())


def test_substrings_are_shortened_until_the_recall_is_met():
    sample = np.random.default_rng(3).standard_normal((500, 32))
    codes = embedding_dups.Codes(sample, 24, 0.9, 0.995)
    assert 0 < codes.bits < 24 and codes.tables <= embedding_dups.MOST_TABLES
    # The same pairs as in the search for the tables.
    one = embedding_dups.units(sample)
    aside = np.random.default_rng(codes.seed).standard_normal(one.shape)
    aside = embedding_dups.units(aside - (aside * one).sum(1, keepdims=True) * one)
    two = 0.9 * one + np.sqrt(1 - 0.81) * aside
    assert (codes.values(one) == codes.values(two)).any(1).mean() >= 0.995


def planted(random, n, width, cosine, centre):
    """Pairs of vectors at ``cosine`` whose first lie around ``centre``."""
    one = centre + random.standard_normal((n, width))
    unit = embedding_dups.units(one)
    aside = random.standard_normal((n, width))
    aside = embedding_dups.units(aside - (aside * unit).sum(1, keepdims=True) * unit)
    return unit, cosine * unit + np.sqrt(1 - cosine**2) * aside


def test_pairs_at_the_threshold_are_found_in_every_width(spark):
    random = np.random.default_rng(11)
    crowd = 3 * np.ones(64) + random.standard_normal((1500, 64))
    rows = [(i, v.tolist(), 0, "") for i, v in enumerate(crowd)]
    for width, label in [(48, 0), (48, 1), (24, 0), (64, 1)]:
        for cosine in (0.981, 0.985, 0.99):
            for centre in (0.0, 0.5):
                for a, b in zip(*planted(random, 50, width, cosine, centre)):
                    rows += [(len(rows), a.tolist(), label, ""), (len(rows) + 1, b.tolist(), label, "")]
    expected = brute_blocks(rows)
    got = {r.vec_id: r.n_links for r in embedding_links(spark.createDataFrame(rows, SCHEMA)).collect()}
    for width, label in [(48, 0), (48, 1), (24, 0), (64, 1)]:
        ids = [r[0] for r in rows if len(r[1]) == width and r[2] == label]
        wanted = sum(expected[i] for i in ids)
        assert wanted >= 590 and 0.95 * wanted <= sum(got[i] for i in ids) <= wanted


def brute_blocks(rows, threshold=0.98):
    """The number of links of each row, a block of equal label and width at a time."""
    links, blocks = {}, {}
    for r in rows:
        blocks.setdefault((r[2], len(r[1])), []).append(r)
    for block in blocks.values():
        unit = embedding_dups.units(np.array([r[1] for r in block], np.float32).astype(float))
        near = (unit @ unit.T >= threshold).sum(1) - 1
        links |= {r[0]: int(n) for r, n in zip(block, near)}
    return links
