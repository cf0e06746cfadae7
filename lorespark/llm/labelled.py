"""Bounded labelled samples for training, and the held-out rule of the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARES = 16
CLASS_BYTES = 1 << 24


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def least(rows: DataFrame, per_class: int, *key: str) -> DataFrame:
    """The ``per_class`` distinct rows of each ``_label`` with the least hash of ``key``, and ``_rank``.

    They are found in shares of each class first, so that one task ranks ``SHARES * per_class``
    rows at most, however many partitions the tables have.
    """
    order = (F.xxhash64(*key), *key)
    share = F.pmod(F.xxhash64(*key), F.lit(SHARES))
    in_share, rank = Window.partitionBy("_label", share).orderBy(*order), Window.partitionBy("_label").orderBy(*order)
    return (
        rows.distinct()
        .withColumn("_rank", F.row_number().over(in_share)).filter(F.col("_rank") <= per_class)
        .withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= per_class)
    )


def sample_texts(
    docs: DataFrame, labels: DataFrame, per_class: int, most_bytes: int = CLASS_BYTES
) -> list[tuple[str, object]]:
    """Up to ``per_class`` whole texts of each class of ``labels(doc_id, label)``, as ``(text, label)``.

    Ids with the least hash are taken, of their distinct texts again those with the least hash, and
    of these as many as make up ``most_bytes`` of UTF-8 in a class; a rerun takes the same. A text
    longer than that alone, null labels and null texts are not learned from. At most
    ``per_class`` rows of a class, ``most_bytes`` together, reach the driver, also where one id
    has very many rows. The sample's size does not grow with the tables.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("label").alias("_label"))
    ids = least(known.filter("_label is not null and _id is not null"), per_class, "_id").drop("_rank")
    texts = (
        docs.select(F.col("doc_id").alias("_id"), "text").filter("text is not null")
        .join(F.broadcast(ids), "_id").withColumn("_hash", F.xxhash64("text"))
    )
    sizes = texts.select("_id", "_label", "_hash", F.octet_length("text").alias("_bytes"))
    so_far = Window.partitionBy("_label").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    chosen = (
        least(sizes.filter(F.col("_bytes") <= most_bytes), per_class, "_id", "_hash")
        .withColumn("_sum", F.sum("_bytes").over(so_far)).filter(F.col("_sum") <= most_bytes)
        .select("_id", "_label", "_hash")
    )
    rows = texts.join(F.broadcast(chosen), ["_id", "_label", "_hash"]).select("_id", "_label", "text").distinct().collect()
    return [(r["text"], r["_label"]) for r in sorted(rows, key=lambda r: (str(r["_label"]), r["_id"], r["text"]))]


def zero_or_one(labels: DataFrame) -> DataFrame:
    """The rows that say 0 or 1; any other label says nothing."""
    return labels.filter(F.col("label").isin(0, 1))


def label_odds(labels: DataFrame) -> float:
    """How many rows of label 1 there are for each of label 0; 1 if either is missing."""
    one, zero = labels.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    return one / zero if one and zero else 1.0
