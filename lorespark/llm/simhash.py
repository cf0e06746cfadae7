"""SimHash near-duplicates through deletion-variant signatures.

Two 64-bit fingerprints that differ in at most two bits agree, but for one bit at most, in one of
their two 32-bit halves. Each fingerprint is indexed under both halves with each bit left out in
turn: 64 keys. Equal keys are joined and the pairs verified.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lorespark.functions.frames import may_be_in
from lorespark.llm.components import components
from lorespark.session import durable, passing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SEED = 42
BLOCK = 1 << 15


def shingle_hashes(text: str | None, n: int = 3) -> np.ndarray:
    """XXH64 of each run of ``n`` words, repeats included; of all words if there are fewer."""
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    line = " ".join(words).encode("utf-8", "surrogatepass")
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(line)]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[n - 1 :]) if len(words) >= n else [(0, len(line))]
    return np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(text: str | None) -> int:
    return majority(shingle_hashes(text))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes, as a signed integer; 0 without hashes."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), BLOCK):
        part = hashes[start : start + BLOCK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _without(value: Column, bit: Column) -> Column:
    return value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))


def links(prints: DataFrame, hot: int = 64) -> DataFrame:
    """``a, b``: every pair of distinct values of ``prints(print)`` that differ in at most two bits.

    A key met by over ``hot`` fingerprints is refined before its members are paired: the half
    outside the key differs in two bits at most, so it agrees but for one bit in one of its
    16-bit quarters, and is indexed by those in the same way. Nothing is dropped.
    """
    low = F.col("print").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("print", 32)
    keyed = (
        prints.select("print", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
        .withColumn("half", _without(F.when(F.col("bit") < 32, low).otherwise(high), F.col("bit") % 32))
        .select("print", F.shiftleft(F.col("bit").cast("long"), 32).bitwiseOR(F.col("half")).alias("key"))
    )
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    # Spark takes exploded rows to be as many as those before, and stored ones to be as small as their files, so it
    # would broadcast what is many times larger. Hence the hints, here and below.
    members = durable(keyed.hint("merge").join(shared, "key"))

    def pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
        one = rows.select(*keys, F.col("print").alias("a"))
        two = rows.select(*keys, F.col("print").alias("b"))
        close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
        # Halves that agree wholly meet under 32 keys; one of them is enough.
        bit = F.shiftright("key", 32).cast("int")
        apart = F.col("a").bitwiseXOR(F.col("b"))
        differs = F.call_function("shiftrightunsigned", apart, bit).bitwiseAND(F.lit(1)) == 1
        whole = F.when(bit < 32, apart.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(apart, 32)) == 0
        return one.hint("merge").join(two, keys).filter(close & (differs | (whole & (bit % 32 == 0)))).select("a", "b")

    other = F.when(F.shiftright("key", 32) < 32, high).otherwise(low)
    quarter = F.when(F.col("bit") < 16, other.bitwiseAND(F.lit(0xFFFF))).otherwise(F.shiftrightunsigned(other, 16))
    refined = (
        members.filter(F.col("members") > hot)
        .select("print", "key", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
        .withColumn("part", _without(quarter, F.col("bit") % 16))
    )
    return (
        pairs(members.filter(F.col("members") <= hot), ["key"])
        .unionByName(pairs(refined, ["key", "bit", "part"]))
        .distinct()
    )


def simhash_groups(rows: DataFrame) -> DataFrame:
    """Add ``root`` and ``component_id`` to ``rows(doc_id, print)``: the group's smallest
    fingerprint and the smallest id reachable through links.

    Equal fingerprints are reduced to one row before they are indexed, so copies cost nothing.
    """
    firsts = durable(rows.groupBy("print").agg(F.min("doc_id").alias("first")))
    found = components(links(firsts.select("print")), "a", "b")
    rooted = firsts.join(found, firsts["print"] == found["node"], "left").select(
        "print", "first", F.coalesce("root", "print").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.join(least, "root").select("print", "root", "component_id"), "print")


def simhash(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``.

    Null, empty and blank texts have fingerprint zero and are linked like any other; a null id
    never names a group unless all ids in it are null; repeated rows give repeated results.
    Other columns are ignored.
    """
    rows = durable(docs.select("doc_id", fingerprints("text").alias("print")))
    return simhash_groups(rows).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each group: that of its smallest ``doc_id``.

    Texts are linked if the Jaccard similarity of their sets of ``shingle``-word shingles is at
    least ``similarity``, or if both have no words. Fingerprints of those shingles are linked through
    their deletion variants first and confirmed by the sets; pairs at the bound differ in ten of 64
    bits and often in more, too many to index, so for those not linked yet an exact join follows.
    Among rows of that id the one with the least digest of its columns stays, so of repeated rows
    exactly one. Null ids come last. Only rows that go are looked up in the documents, and only what
    may be such a row is shuffled for it. Of the tables stored on the way only the one that says which
    rows stay is left behind.
    """
    from lorespark.llm.shingle_sets import set_rows, similar_groups  # it imports this module

    digest = F.xxhash64(*docs.columns)
    with passing(docs.sparkSession):
        rows = durable(set_rows(docs.select("doc_id", digest.alias("digest"), "text"), shingle, similarity))
        found = similar_groups(docs, rows, shingle, similarity)
        rows = rows.select("doc_id", "digest", "node")
        grouped = rows.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
        order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("digest"))
        kept = grouped.groupBy("root").agg(F.min(order).alias("kept"))
        kept = kept.select(F.col("kept.doc_id").alias("_id"), F.col("kept.digest").alias("_digest"))
        stays = durable(
            rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("times"))
            .join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
            .select(F.col("doc_id").alias("_simhash_id"), F.col("digest").alias("_simhash_digest"),
                    F.col("_digest").isNotNull().alias("stays"), "times"),
            lasting=True,
        )
    same = lambda other: docs["doc_id"].eqNullSafe(other["_simhash_id"]) & (digest == other["_simhash_digest"])
    gone = stays.filter("not stays or times > 1")
    touched = may_be_in(gone.select("_simhash_digest"))(digest)
    once = docs.filter(~touched).unionByName(docs.filter(touched).join(gone, same(gone), "left_anti"))
    repeated = stays.filter("stays and times > 1")
    again = docs.filter(touched).withColumn("_simhash_digest", digest).join(
        repeated.withColumnRenamed("_simhash_digest", "_digest"),
        F.col("doc_id").eqNullSafe(F.col("_simhash_id")) & (F.col("_simhash_digest") == F.col("_digest")),
        "left_semi",
    )
    return once.unionByName(again.dropDuplicates(["doc_id", "_simhash_digest"]).select(*docs.columns))
