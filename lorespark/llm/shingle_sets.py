"""Texts whose sets of word shingles are similar: SimHash links first, then an exact prefix join.

Fingerprints of the shingles that differ in two bits or fewer are found through their deletion
variants, and the pairs are confirmed by the whole sets. What is similar without such fingerprints
is found by the join, which need not compare what is linked already. Two sets of Jaccard similarity ``s`` or more share ``k`` of the first ``n - ceil(s n) + k`` of their
``n`` shingles, whatever the order, as long as all sets use the same one. So sets are indexed by
these only, and pairs that share enough of them are compared by the whole sets; ``k`` grows with
``n``, and of two sets the smaller decides. Shingles that are frequent in a share of the texts come
last in the order; this decides how much meets by chance, never what is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.frames import may_be_in
from lorespark.llm.components import components
from lorespark.llm.simhash import links as print_links
from lorespark.llm.simhash import majority, shingle_hashes
from lorespark.session import durable

SHARE = 16
FREQUENT = 4
MOST_FREQUENT = 1 << 17
HOT = 64
BATCH = 256
ROUNDS = 2
STEP = 20
# Words of 64 bits of the sketch of a set.
SKETCH = [f"sketch{i}" for i in range(8)]


def shingle_set(text: str | None, n: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, n))


def set_name(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One bit for each of 512 classes of shingles: whether the set holds an odd number of them."""
    size = 64 * len(SKETCH)
    odd = np.bincount((hashes % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def may_be_similar(similarity: float) -> Column:
    """False only for sets of sizes ``n1, n2`` that are not similar, by their sketches.

    A shingle that one set alone has turns one bit, so sets differ in no fewer shingles than sketches in bits.
    """
    bits = sum((F.bit_count(F.col(f"{c}1").bitwiseXOR(F.col(f"{c}2"))) for c in SKETCH), F.lit(0))
    return bits <= (F.col("n1") + F.col("n2")) * ((1 - similarity) / (1 + similarity)) + 1e-6


def first_shingles(hashes: np.ndarray, similarity: float, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles a set is indexed by: rare ones by hash, then those of ``frequent`` by ``rank``."""
    n = len(hashes)
    size = n - math.ceil(similarity * n - 1e-9) + 1 + n // STEP if n else 0
    at = np.minimum(np.searchsorted(frequent, hashes), max(len(frequent) - 1, 0))
    often = frequent[at] == hashes if len(frequent) else np.zeros(len(hashes), bool)
    last = hashes[often][np.argsort(rank[at[often]])] if often.any() else hashes[:0]
    return np.concatenate([hashes[~often][:size], last])[:size]


def _frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles met in several texts of a share of the table, and their places from rare to frequent."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), BATCH):
                sets = [shingle_set(t, shingle) for t in frame["text"][start : start + BATCH]]
                yield pd.DataFrame({"key": np.concatenate(sets).view(np.int64)})

    share = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SHARE)) == 0)
    met = share.mapInPandas(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    top = met.filter(F.col("times") >= FREQUENT).orderBy(F.desc("times"), "key").limit(MOST_FREQUENT)
    # Stored first: collected at once, the driver would merge as many rows of each partition.
    top = durable(top).toPandas().sort_values(["times", "key"], ascending=[False, True])
    keys = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], -order


def set_rows(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``docs(..., text)`` with ``mark, node, print, n, first`` and ``SKETCH`` in place of ``text``: a hash of
    the text, the name of its set, the fingerprint of its shingles, the size of the set, the shingles that
    index it, and its sketch. Equal sets have equal names."""
    frequent, rank = _frequent(docs, shingle)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, prints, sizes, firsts = [], [], [], [np.zeros(0, np.int64)]
            sketches = [np.zeros((0, len(SKETCH)), np.int64)]
            # Only the indexing shingles of a batch are held, whole sets of a few texts at a time.
            for start in range(0, len(texts), BATCH):
                hashes = [shingle_hashes(t, shingle) for t in texts.slice(start, BATCH).to_pylist()]
                prints += [majority(h) for h in hashes]
                sets = [np.unique(h) for h in hashes]
                names += [set_name(s) for s in sets]
                sizes += [len(s) for s in sets]
                sketches += [sketch(s)[None] for s in sets]
                firsts += [first_shingles(s, similarity, frequent, rank).view(np.int64) for s in sets]
            ends = pa.array(np.cumsum([len(f) for f in firsts]), pa.int32())
            first = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(firsts)))
            numbers = [pa.array(x, pa.int64()) for x in (names, prints, sizes)]
            words = [pa.array(w) for w in np.ascontiguousarray(np.concatenate(sketches).T)]
            yield pa.StructArray.from_arrays([*numbers, first, *words], ["node", "print", "n", "first", *SKETCH])

    named = F.arrow_udf(run, ", ".join(["node long, print long, n long, first array<long>", *(f"{c} long" for c in SKETCH)]))
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*rest, F.xxhash64("text").alias("mark"), named("text").alias("_set")).select(*rest, "mark", "_set.*")


def _contents(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``node, shingles`` of the texts whose ``mark`` is wanted, copies once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = [i for i, m in enumerate(batch.column("mark").to_pylist()) if not (m in seen or seen.add(m))]
            for start in range(0, len(new), BATCH):
                texts = batch.column("text").take(pa.array(new[start : start + BATCH]))
                sets = [shingle_set(t, shingle) for t in texts.to_pylist()]
                ends = pa.array(np.cumsum([0, *(len(s) for s in sets)]), pa.int32())
                shingles = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([set_name(s) for s in sets], pa.int64()), shingles], ["node", "shingles"])

    # Texts that are not wanted stay where they are; the join drops the few that pass the filter.
    marked = docs.select(F.xxhash64("text").alias("mark"), "text")
    texts = marked.filter(may_be_in(wanted)("mark")).join(wanted, "mark", "left_semi")
    return durable(texts.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"]))


def _similar(pairs: DataFrame, contents: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``a, b`` whose whole sets are similar."""
    one = contents.select(F.col("node").alias("a"), F.col("shingles").alias("one"))
    two = contents.select(F.col("node").alias("b"), F.col("shingles").alias("two"))
    both = F.size(F.array_intersect("one", "two"))
    return durable(
        pairs.join(one, "a").join(two, "b")
        .withColumn("both", both)
        .filter(F.col("both") / (F.size("one") + F.size("two") - F.col("both")) >= similarity)
        .select("a", "b")
    )


def _pair(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _print_pairs(nodes: DataFrame) -> DataFrame:
    """``a, b``: sets of ``nodes(node, print)`` to compare since their fingerprints are linked or equal.

    Sets of equal fingerprints are paired with the first of them, which stands for all in the index,
    and each fingerprint with the smallest one that it is linked to; so a large group of near copies
    gives no more pairs than it has fingerprints. What these do not confirm is left to the join.
    """
    firsts = durable(nodes.groupBy("print").agg(F.min("node").alias("first")))
    # A broadcast of numbers takes some eight times the file that Spark goes by, and here there would be several at once.
    equal = nodes.hint("merge").join(firsts, "print").filter("node <> first").select(*_pair(F.col("node"), F.col("first")))
    one, two = (firsts.select(F.col("print").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab")
    near = print_links(firsts.select("print")).groupBy("b").agg(F.min("a").alias("a")).hint("merge").join(one, "a").hint("merge").join(two, "b")
    return equal.unionByName(near.select(*_pair(F.col("first_a"), F.col("first_b"))))


def similar_groups(docs: DataFrame, rows: DataFrame, shingle: int, similarity: float, hot: int = HOT) -> DataFrame:
    """``node, root`` of every set that is linked to another; ``rows`` are the stored ``set_rows`` of ``docs``.

    A group is what similar pairs reach. Sets with linked fingerprints are compared first. Where over ``hot`` sets meet under a shingle, they are
    compared to one of them first, and later only with sets that they are not yet linked to; so a
    large group of near copies takes few comparisons. In the end every pair that shares enough
    indexing shingles has been compared, is linked already, or is too far apart by its sketches.
    """
    met = Window.partitionBy("key")
    # Copies of a set have the same shingles; one of them is indexed.
    shared = durable(
        rows.select("node", "first").dropDuplicates(["node"]).select("node", F.explode("first").alias("key"))
        .withColumn("low", F.min("node").over(met)).withColumn("high", F.max("node").over(met))
        .filter("low < high").select("node", "key")
    )
    sizes = rows.groupBy("node").agg(*(F.min(c).alias(c) for c in ("mark", "print", "n", *SKETCH)))
    wanted = durable(
        shared.groupBy("node").agg(F.count(F.lit(1)).alias("keys")).join(sizes, "node")
        .filter(F.col("keys") >= 1 + F.floor(F.col("n") * similarity / STEP - 1e-6)).drop("keys")
    )
    contents = _contents(docs, wanted.select("mark"), shingle)
    members = shared.join(wanted.select("node", "n"), "node")
    tested = durable(_print_pairs(wanted.select("node", "print")))
    links = _similar(tested, contents, similarity)
    found = components(links, "a", "b")
    for turn in range(ROUNDS + 1):
        rooted = members.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = rooted.groupBy("key").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("here"),
            F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("center"),
            F.min_by("root", F.xxhash64("node", F.lit(turn))).alias("at"),
        ).filter("low < high")
        last = turn == ROUNDS
        if not last:
            crowded = durable(rooted.join(apart.filter(F.col("here") > hot).select("key", "center", "at"), "key"))
            last = crowded.isEmpty()
        if last:
            held = rooted.select("node", "n", "key", "root").join(apart.select("key"), "key")
            held = durable(held.join(wanted.select("node", *SKETCH), "node"))
            one, two = (held.select("key", *(F.col(c).alias(c + s) for c in ("node", "n", "root", *SKETCH))) for s in "12")
            near = (F.col("root1") < F.col("root2")) & (F.least("n1", "n2") >= F.greatest("n1", "n2") * similarity - 1e-6)
            pairs = (
                one.join(two, "key").filter(near & may_be_similar(similarity))
                .select(*_pair(F.col("node1"), F.col("node2")), F.least("n1", "n2").alias("n"))
                .groupBy("a", "b", "n").agg(F.count(F.lit(1)).alias("keys"))
                .filter(F.col("keys") >= 1 + F.floor(F.col("n") / STEP)).select("a", "b")
            )
        else:
            pairs = crowded.filter("root <> at").select(*_pair(F.col("node"), F.col("center"))).distinct()
        pairs = durable(pairs.join(tested, ["a", "b"], "left_anti"))
        links = links.unionByName(_similar(pairs, contents, similarity))
        found = components(links, "a", "b")
        if last:
            break
        tested = tested.unionByName(pairs)
    return found
