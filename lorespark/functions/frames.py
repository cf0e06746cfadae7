"""Frame helpers: spreading, upserts, bounded collection, ranks of unbounded groups."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lorespark.session import durable

# Rows of ids and numbers, some 200 bytes each, that are sent to every task at most.
FETCH_ROWS = 100_000
# Bits of a filter of keys: 4 MiB, whatever the number of keys.
FILTER_BITS = 1 << 25


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a small input enough partitions for all cores before CPU-heavy narrow work.

    An input that already has one split per core is returned untouched, so a large table is
    never shuffled for this. Hashing on the row key keeps retries deterministic.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(cores, *keys)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the greatest by ``order``; aggregated map-side first."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(row).select(*keys, "row.*").select(*df.columns)


def earliest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(row).select(*keys, "row.*").select(*df.columns)


def replace_rows(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """``updates`` plus the rows of ``base`` whose key is not among them."""
    kept = base.join(updates.select(*keys), keys, "left_anti")
    return kept.unionByName(updates.select(*base.columns))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str) -> DataFrame:
    """The first ``k`` rows per group with their 1-based rank.

    The rank filter is planned as a per-partition group limit before the shuffle, so a hot
    group sends at most ``k`` rows per task.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def fetch(rows: DataFrame, wide: DataFrame, key: str, most: int = FETCH_ROWS) -> DataFrame:
    """``rows`` with the columns of ``wide`` for their ``key``, without shuffling ``wide``.

    ``rows`` are stored and counted first. Up to ``most`` of them go to every task that reads
    ``wide``; more meet it by whatever join the planner finds.
    """
    stored = durable(rows)
    if stored.count() <= most:
        return wide.join(F.broadcast(stored), key)
    return stored.join(wide, key)


def may_be_in(keys: DataFrame, bits: int = FILTER_BITS) -> Callable[[Column], Column]:
    """Whether a hash may be among those of ``keys``, a frame of one column of hashes without nulls.

    What is among them always passes; of the rest, as many as the share of ``bits`` that is set. So
    wide rows that a join would drop need not be shuffled for it. The filter has the same size for
    any number of keys, and travels with the tasks.
    """
    place = F.pmod(F.col(keys.columns[0]), F.lit(bits))
    word = F.shiftright(place, 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    found = keys.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("set")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found["word"].to_numpy()] = found["set"].to_numpy()
    held = words.view(np.uint8)

    def passes(hashes: pa.Array) -> pa.Array:
        at = hashes.to_numpy(zero_copy_only=False) % bits
        return pa.array((held[at >> 3] >> (at & 7)) & 1 == 1)

    return F.arrow_udf(passes, BooleanType())


def reject(bad: DataFrame, column: str, message: str) -> None:
    """Raise if the frame has a row, naming a few of the offending values."""
    seen = [str(r[0]) for r in bad.select(column).limit(5).collect()]
    if seen:
        raise ValueError(f"{message}: {', '.join(sorted(seen))}")


def bounded_parts(df: DataFrame, group: list[str], value: str, part_rows: int) -> DataFrame:
    """Add ``part`` so that no ``(group, part)`` holds many more than ``part_rows`` rows.

    Groups that fit get part 0. Larger ones are split by a hash of ``value``, so collecting
    per ``(group, part)`` stays bounded however large the group is.
    """
    hot = (
        df.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > part_rows)
        .select(*group, F.ceil(F.col("_n") / part_rows).cast("int").alias("_parts"))
    )
    part = F.pmod(F.xxhash64(value), F.col("_parts")).cast("int")
    return (
        df.join(hot, group, "left")
        .withColumn("part", F.coalesce(part, F.lit(0)))
        .drop("_parts")
    )


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Exact ``row_number`` for groups too large for one task.

    Rows are range-partitioned by ``(group, order)``, stored, counted per group and partition,
    and each row gets the count of the partitions before it plus its place in its own. The
    stored step fixes the partition borders that both later reads rely on. ``order`` must end
    in a unique column.
    """
    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(
        df.repartitionByRange(shuffles, *group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_slot", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    before = Window.partitionBy(*group).orderBy("_slot").rowsBetween(
        Window.unboundedPreceding, -1
    )
    slots = (
        placed.groupBy(*group, "_slot")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        placed.join(slots, [*group, "_slot"])
        .withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1)
        .drop("_slot", "_at", "_first", "_before")
    )
