"""Array expressions that evaluate their input once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda variable is materialised, a plain column expression used inside a nested lambda
    would be evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def run_lengths(values: Column) -> Column:
    """``array<struct<item,n>>``: the distinct items of an array with how often each occurs.

    Sorts and reads off the runs, so it is ``n log n`` and needs no shuffle.
    """

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return bind(
            starts,
            lambda p: F.transform(
                p,
                lambda start, j: F.struct(
                    F.get(s, start).alias("item"),
                    (F.coalesce(F.get(p, j + 1), F.size(s)) - start).alias("n"),
                ),
            ),
        )

    return bind(
        F.sort_array(values),
        lambda s: F.when(F.size(s) > 0, runs(s)),
    )
