import re
import string

import xxhash
from brute import groups, spark_rows

from lorespark.llm import simhash

FOLDER = "/root/testdata/sf0.001"


def brute_print(text):
    low = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    pairs = [(i, j) for i, p in prints for j, q in prints if (p ^ q).bit_count() <= 2]
    group = groups([i for i, _ in prints], pairs)
    return sorted((i, f"{p:016x}", group[i]) for i, p in prints)


def test_agrees_with_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert spark_rows(simhash.simhash(docs)) == want


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "ß é 漢字 x"), (7, "a " * 70000), (7, "a " * 70000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, print int, component_id string")
    got = spark_rows(simhash.simhash(docs))
    assert got == brute(rows)
    assert [r[2] for r in got] == [1, 1, 1, 4, 4, 6, 7, 7]
    assert spark_rows(simhash.simhash(docs.limit(0))) == []
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 4, 6, 7]


def test_null_ids_form_no_crash(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (2, "q r s t"), (None, "q r s t")], "doc_id long, text string")
    assert sorted(map(str, (r.doc_id for r in simhash.drop_near_copies(docs).collect()))) == ["2", "None"]


def test_links_of_crowded_keys(spark):
    import random

    rng = random.Random(3)
    values = {0}
    while len(values) < 400:
        v = rng.choice(sorted(values))
        values.add(v ^ (1 << rng.randrange(40)) ^ (rng.random() < 0.5) << rng.randrange(64))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "print long")
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    for hot in (2, 16, 1000):
        got = [tuple(r) for r in simhash.links(prints, hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def brute_set(text):
    low = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_kept(rows, least=0.8):
    sets = [(i, brute_set(t)) for i, t in rows]
    same = lambda p, q: len(p & q) >= least * len(p | q) - 1e-9
    group = groups([i for i, _ in rows], [(i, j) for i, p in sets for j, q in sets if i < j and same(p, q)])
    return sorted(set(group.values()))


def test_near_copies_against_brute_force(spark):
    import random

    from lorespark.llm import shingle_sets

    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    line = [rng.choice(words) for _ in range(30)]
    rows = []
    for base in range(40):
        text = line + [rng.choice(words) for _ in range(rng.randrange(0, 120))]
        for copy in range(3 if base else 90):
            copied = list(text)
            for _ in range(rng.randrange(0, 4)):
                copied[rng.randrange(len(copied))] = rng.choice(words)
            rows.append((len(rows), " ".join(copied)))
    rows += [(900, "a b c"), (901, "A  b c"), (902, "a b"), (903, None), (904, " ")]
    # Four of five shingles in common: just the bound.
    rows += [(910, "p q r s t u v w"), (911, "p q r s t u v w x"), (912, "p q r s t u v x y z")]
    want = brute_kept(rows)
    assert len(want) < len({fingerprint for _, fingerprint, _ in brute(rows)}) and 911 not in want and 912 in want
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == want
    # Few sets a shingle, so that they are compared in turns.
    nodes = shingle_sets.durable(shingle_sets.set_rows(docs, 5, 0.8))
    found = shingle_sets.similar_groups(docs, nodes, 5, 0.8, hot=3)
    kept = nodes.join(found, "node", "left").selectExpr("doc_id", "coalesce(root, node) root").groupBy("root").agg({"doc_id": "min"})
    assert sorted(r[1] for r in kept.collect()) == want


def test_near_copies_of_the_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = brute_kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == want


def test_near_copies_go_through_fingerprints(spark, monkeypatch):
    """Linked and equal fingerprints are what is compared first; the sets confirm them."""
    from lorespark.llm import shingle_sets

    line = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(line)), (2, " ".join(line + ["end"])), (3, " ".join(f"v{i}" for i in range(400)))]
    # The same shingles in other numbers: one set, two fingerprints at most.
    rows += [(4, "a b c d e f " * 9), (5, "a b c d e f " * 10 + "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = {r.doc_id: r for r in shingle_sets.set_rows(docs, 5, 0.8).collect()}
    apart = (nodes[1].print ^ nodes[2].print) & (1 << 64) - 1
    assert nodes[1].print == simhash.majority(simhash.shingle_hashes(rows[0][1], 5)) and apart.bit_count() <= 2
    tried = []
    similar = shingle_sets._similar

    def watched(pairs, *rest):
        tried.append({frozenset(r) for r in pairs.collect()})
        return similar(pairs, *rest)

    monkeypatch.setattr(shingle_sets, "_similar", watched)
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == [1, 3, 4]
    assert tried[0] == {frozenset((nodes[1].node, nodes[2].node))} and not any(tried[0] & more for more in tried[1:])


def test_a_group_of_linked_fingerprints_gives_few_pairs(spark):
    from lorespark.llm import shingle_sets

    # One bit each away from zero: every two of them are linked.
    nodes = spark.createDataFrame([(i, 1 << i) for i in range(60)], "node long, print long")
    pairs = [tuple(r) for r in shingle_sets._print_pairs(nodes).collect()]
    assert sorted(b for _, b in pairs) == list(range(1, 60)) and {a for a, _ in pairs} == {0}


def test_filter_of_keys_lets_through_what_is_among_them(spark):
    from pyspark.sql import functions as F

    from lorespark.functions.frames import may_be_in

    rows = spark.range(5000).select("id", F.xxhash64("id").alias("key"))
    passed = rows.filter(may_be_in(rows.filter("id % 10 = 0").select("key"))("key"))
    ids = {r.id for r in passed.collect()}
    assert ids >= set(range(0, 5000, 10)) and len(ids) < 510
    assert rows.filter(may_be_in(rows.limit(0).select("key"))("key")).isEmpty()


def test_texts_that_stay_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 9) for i in range(50)] + [(99, "some words of text 3 " * 9)], "doc_id long, text string")
    left = simhash.drop_near_copies(docs)
    assert sorted(r.doc_id for r in left.collect()) == list(range(50))
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    joins = [part for part in plan.split("Join Left")[1:] if part.startswith(("Anti", "Semi"))]
    assert joins and all("passes(" in part.split("Relation")[0] for part in joins)


def test_only_what_decides_the_rows_stays_on_disk(spark, tmp_path, monkeypatch):
    from lorespark import session

    monkeypatch.setattr(session, "scratch_folder", lambda _: str(tmp_path))
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "q r s")], "doc_id long, text string")
    left = simhash.drop_near_copies(docs)
    assert len(list(tmp_path.iterdir())) == 1
    assert sorted(r.doc_id for r in left.collect()) == [1, 3]
    session.durable(docs)  # outside of the block tables last
    assert len(list(tmp_path.iterdir())) == 2


def test_sketches_spare_comparisons_and_lose_no_pair(spark, monkeypatch):
    """A group of texts that are alike, but not enough to be linked, is not compared all with all."""
    import random

    from lorespark.llm import shingle_sets

    rng = random.Random(8)
    line = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        words = list(line)
        for at in rng.sample(range(0, 150, 6), rng.choice((1, 3, 4))):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    sets = {i: set(shingle_sets.shingle_set(t, 5).tolist()) for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group, tried = groups(list(sets), near), []
    similar = shingle_sets._similar

    def watched(pairs, *rest):
        tried.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(shingle_sets, "_similar", watched)
    left = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == sorted({group[i] for i in sets})
    apart = sum(group[a] != group[b] for a in sets for b in sets if a < b)
    assert near and apart > 500 and tried[-1] < apart / 2
    for a, b in near:
        one, two = (shingle_sets.sketch(shingle_sets.shingle_set(rows[i][1], 5)) for i in (a, b))
        assert sum(int(x).bit_count() for x in (one ^ two).view("uint64")) <= len(sets[a] ^ sets[b])


def test_exploded_keys_are_not_broadcast(spark, monkeypatch):
    """Spark takes them to be as many as the fingerprints, which are 64 times fewer."""
    stored, durable = [], simhash.durable

    def watched(df, *rest):
        stored.append(df._jdf.queryExecution().executedPlan().toString())
        return durable(df, *rest)

    monkeypatch.setattr(simhash, "durable", watched)
    prints = spark.range(500).withColumnRenamed("id", "print")
    assert int(prints._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 10000
    got = {tuple(r) for r in simhash.links(prints).collect()}
    assert got == {(a, b) for b in range(500) for a in range(b) if (a ^ b).bit_count() <= 2}
    joined = [plan for plan in stored if "Generate explode" in plan]
    assert joined and not any("Broadcast" in plan for plan in joined)


def test_frequent_shingles_are_found_before_they_reach_the_driver(spark, monkeypatch):
    from collections import Counter

    from pyspark.sql import functions as F

    from lorespark.llm import shingle_sets

    monkeypatch.setattr(shingle_sets, "MOST_FREQUENT", 40)
    rows = [(i, f"no {i} " + " ".join(f"w{j}" for j in range(i % 97))) for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    share = docs.filter(F.pmod(F.xxhash64("text"), F.lit(shingle_sets.SHARE)) == 0).collect()
    times = Counter(k for r in share for k in shingle_sets.shingle_set(r.text, 5).view("int64").tolist())
    want = sorted((k for k in times if times[k] >= shingle_sets.FREQUENT), key=lambda k: (-times[k], k))
    assert len(want) > 40
    collected, to_pandas = [], type(docs).toPandas

    def watched(df):
        collected.append(df._jdf.queryExecution().executedPlan().toString())
        return to_pandas(df)

    monkeypatch.setattr(type(docs), "toPandas", watched)
    keys, rank = shingle_sets._frequent(docs, 5)
    assert (keys[:-1] < keys[1:]).all()
    assert keys[rank.argsort()].view("int64").tolist() == want[:40][::-1]
    assert len(collected) == 1 and "TakeOrdered" not in collected[0]


def test_members_of_keys_are_not_broadcast_to_be_paired(spark):
    """Their files are small where keys and fingerprints repeat, and crowded keys are exploded again."""
    prints = spark.range(500).withColumnRenamed("id", "print")
    for hot in (2, 1000):
        plan = simhash.links(prints, hot)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_first_sets_of_fingerprints_are_not_broadcast(spark):
    from lorespark.llm import shingle_sets

    nodes = spark.range(300).selectExpr("id + 1000 node", "id div 2 print")
    pairs = shingle_sets._print_pairs(nodes)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    # Each set of an odd id has the print of the one before; each print is linked to the least near it.
    least = {b: min((a for a in range(b) if (a ^ b).bit_count() <= 2), default=None) for b in range(150)}
    want = {(i + 999, i + 1000) for i in range(1, 300, 2)} | {(1000 + 2 * a, 1000 + 2 * b) for b, a in least.items() if a is not None}
    assert {tuple(r) for r in pairs.collect()} == want
