"""Connected components of a table of links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.session import durable


def _follow(parents: DataFrame) -> DataFrame:
    """Point every node at the end of its chain of parents, halving the chains in each round."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = durable(
            parents.join(above, "parent", "left").select(
                "node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")
            )
        )
        parents = jumped.select("node", "parent")
        if jumped.filter("moved").isEmpty():
            return parents


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node, root`` for every linked node; ``root`` is the smallest node it can reach.

    Each round hangs every node on its smallest neighbour, follows the chains to their ends,
    and replaces the links by links between those ends, until none is left. Rounds shrink the
    table quickly; every step is stored, so a lost executor costs one step. A node that is its
    own root stands in the result too. Links to nulls are ignored.
    """
    a, b = F.col(left), F.col(right)
    links = durable(
        links.filter(a != b).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
        .filter("high is not null and low is not null").distinct()
    )
    rounds = []
    while not links.isEmpty():
        parents = _follow(durable(links.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("parent"))))
        rounds.append(parents)
        high = parents.select(F.col("node").alias("high"), F.col("parent").alias("high_end"))
        low = parents.select(F.col("node").alias("low"), F.col("parent").alias("low_end"))
        ends = links.join(high, "high", "left").join(low, "low", "left").select(
            F.coalesce("high_end", "high").alias("x"), F.coalesce("low_end", "low").alias("y")
        )
        links = durable(
            ends.filter("x <> y").select(F.greatest("x", "y").alias("high"), F.least("x", "y").alias("low")).distinct()
        )
    if not rounds:
        return links.select(F.col("high").alias("node"), F.col("low").alias("root"))

    def then(found: DataFrame, parents: DataFrame) -> DataFrame:
        further = parents.select(F.col("node").alias("parent"), F.col("parent").alias("end"))
        moved = found.join(further, "parent", "left").select("node", F.coalesce("end", "parent").alias("parent"))
        return moved.unionByName(parents)

    found = reduce(then, rounds).select("node", F.col("parent").alias("root"))
    return durable(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()))
