"""Mixing sources to target weights by hash-threshold histograms.

Every row has a place on a line, the first 60 bits of a digest of its ``doc_id``. A source takes
its rows up to one threshold on that line, so a larger budget always takes a superset of a smaller
one, a rerun takes the same rows, and no row is sorted: histograms of sizes over 4,096 stretches
of the line find the stretch in which the budget ends, and only the rows of that stretch are
counted again, 4,096 times finer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.session import durable

WORD = r"[^\x20\x09-\x0D]+"
LINE_BITS = 60
STEP_BITS = 12


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column) -> Column:
    """The row's place on the line, in ``[0, 2^60)``; null ids share the place of the empty string."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, LINE_BITS // 4), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2
) -> DataFrame:
    """One row per source: ``source, source_size, target``.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` times
    the size of all. No target exceeds ``most`` times its source's size; what is over is shared
    again by weight. With ``level = most * size / weight``, a source stops at its limit if and
    only if everything shared out at its own level stays within the budget, so no loop is needed.
    The windows hold one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighted = totals.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    ).withColumn("level", F.col("source_size") * most / F.col("weight"))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    upto, after = by_level.rowsBetween(Window.unboundedPreceding, 0), by_level.rowsBetween(1, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    limits = (
        weighted.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("shared", F.sum(F.col("source_size") * most).over(upto)
                    + F.col("level") * F.coalesce(F.sum("weight").over(after), F.lit(0)))
        .withColumn("full", F.col("shared") <= F.col("budget"))
    )
    full_size = F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size") * most)).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    return limits.withColumn("per_weight", (F.col("budget") - full_size) / open_weight).select(
        "source",
        "source_size",
        F.when(F.col("full"), (F.col("source_size") * most).cast("double"))
        .otherwise(F.least((F.col("source_size") * most).cast("double"), F.col("weight") * F.col("per_weight")))
        .alias("target"),
    )


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Add ``whole`` and ``below`` to the targets: a row of the source is taken ``whole`` times,
    and once more if its place is less than ``below``.

    ``rows`` holds ``source, size, place`` and is read once per level; a level after the first
    reads only rows in the stretch where their source's budget ends. Rows at one place are taken
    together, if at least half of their size still fits.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets.withColumn("whole", whole.cast("long")).select(
        "*",
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"),
        F.lit(0).cast("long").alias("from"),
        F.lit(0).cast("long").alias("below"),
        F.lit(True).alias("open"),
    )
    names = state.columns
    state = durable(state)
    for shift in range(LINE_BITS - STEP_BITS, -1, -STEP_BITS):
        there = state.filter("open").select(F.col("source").alias("_source"), "from", "left")
        inside = rows.join(there, F.col("source").eqNullSafe(F.col("_source"))).filter(
            F.shiftright("place", shift + STEP_BITS) == F.shiftright("from", shift + STEP_BITS)
        )
        stretch = F.shiftright("place", shift).alias("stretch")
        histogram = inside.groupBy("source", stretch).agg(
            F.sum("size").alias("size"), F.min("place").alias("first"), F.max("place").alias("last"),
            F.first("left").alias("left"),
        )
        before = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
        counted = histogram.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        ends = (
            counted.filter(F.col("before") + F.col("size") > F.col("left"))
            .groupBy(F.col("source").alias("_source"))
            .agg(F.min_by(F.struct("stretch", "before", "size", "first", "last"), "stretch").alias("end"))
        )
        end = F.col("end")
        one_place = end["first"] == end["last"]
        fits = end["before"] + end["size"] / 2 <= F.col("left")
        below = (
            F.when(~F.col("open"), F.col("below"))
            .when(end.isNull(), F.shiftleft(F.shiftright("from", shift + STEP_BITS) + 1, shift + STEP_BITS))
            .when(one_place, end["first"] + F.when(fits, 1).otherwise(0))
            .otherwise(F.col("below"))
        )
        state = durable(
            state.join(ends, F.col("source").eqNullSafe(F.col("_source")), "left").select(
                "source", "source_size", "target", "whole",
                (F.col("left") - F.coalesce(end["before"], F.lit(0))).alias("left"),
                F.coalesce(F.shiftleft(end["stretch"], shift), F.col("from")).alias("from"),
                below.cast("long").alias("below"),
                (F.col("open") & end.isNotNull() & ~one_place).alias("open"),
            ).select(*names)
        )
        if state.filter("open").isEmpty():
            break
    return state.select("source", "source_size", "target", "whole", "below")


def copies(place_: Column) -> Column:
    """How often a row is taken, given its source's ``whole`` and ``below``."""
    return F.col("whole") + F.when(place_ < F.col("below"), 1).otherwise(0)


def mix_sizes(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs(doc_id, text, source)``.

    Null and empty texts have size 0 and a null source is a source of its own. Repeated rows
    share a place and are taken together. An empty table gives no rows; other columns are ignored.
    """
    rows = durable(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), place(F.col("doc_id")).alias("place"))
    )
    limits = thresholds(rows, source_targets(rows, **settings)).withColumnRenamed("source", "_source")
    return rows.join(limits, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("place"))).alias("taken")
    )


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed documents, with the columns of ``docs``; a row taken twice stands twice.

    Decisions are those of ``mix_sizes``. The texts are read twice and never shuffled while the
    table of sources is small enough to be sent to every task.
    """
    rows = durable(
        docs.select("source", n_words(F.col("text")).alias("size"), place(F.col("doc_id")).alias("place"))
    )
    limits = thresholds(rows, source_targets(rows, **settings)).select(
        F.col("source").alias("_mix_source"), F.col("whole").alias("_mix_whole"), F.col("below").alias("_mix_below")
    )
    taken = F.col("_mix_whole") + F.when(place(F.col("doc_id")) < F.col("_mix_below"), 1).otherwise(0)
    return (
        docs.join(limits, F.col("source").eqNullSafe(F.col("_mix_source")))
        .withColumn("_mix_copies", taken.cast("int"))
        .filter(F.col("_mix_copies") > 0)
        .withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), F.col("_mix_copies"))))
        .select(*docs.columns)
    )


SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as place
  from documents),
totals as (
  select source, sum(size)::bigint as source_size,
    [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
  from sized group by source),
levels as (select *, source_size * 2 / weight::double as level, (sum(source_size) over ())::double * 1.5 as budget from totals),
shares as (
  select *, (sum(source_size * 2) over w)::double
      + level * coalesce(sum(weight) over (order by level, source nulls last rows between 1 following and unbounded following), 0)::double <= budget as is_full
  from levels window w as (order by level, source nulls last rows between unbounded preceding and current row)),
targets as (
  select source, source_size, case when is_full then (source_size * 2)::double
    else least((source_size * 2)::double, weight * ((budget - coalesce(sum(case when is_full then source_size * 2 end) over (), 0)::double)
      / (sum(case when not is_full then weight end) over ())::double)) end as target
  from shares),
wholes as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from targets),
places as (select source, place, sum(size) as size from sized group by source, place),
extra as (
  select p.source, p.place,
    coalesce(sum(p.size) over (partition by p.source order by p.place rows between unbounded preceding and 1 preceding), 0)::double
      + p.size::double / 2 <= w.target - w.whole * w.source_size as more
  from places p join wholes w on p.source is not distinct from w.source)
select s.doc_id, s.size, w.source_size, w.target,
  (s.size * (w.whole + case when e.more then 1 else 0 end))::bigint as taken
from sized s join wholes w on s.source is not distinct from w.source
join extra e on s.source is not distinct from e.source and s.place = e.place
"""
