"""Commit tables to one document per commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.frames import top_k
from lorespark.functions.text import isoformat
from lorespark.schemas import MAX_COMMITS

# Changed files that one document part may list.
PART_CHANGES = 10_000


def commit_documents(
    commits: DataFrame, changes: DataFrame, max_commits: int = MAX_COMMITS
) -> DataFrame:
    """``(repo, sha, age, part, text, author, date)`` for the newest commits of each repo.

    ``commits(repo, sha, author, email, date, message)``;
    ``changes(repo, sha, ord, change_type, a_path, b_path)`` against the first parent, ``ord``
    counting from 0. A commit with very many changes continues in further parts.
    """
    newest = top_k(commits, ["repo"], [F.col("date").desc(), F.col("sha")], max_commits, "age")
    kind = F.col("change_type")
    line = (
        F.when(kind == "A", F.concat(F.lit("  + "), "b_path"))
        .when(kind == "D", F.concat(F.lit("  - "), "a_path"))
        .when(kind == "M", F.concat(F.lit("  M "), "b_path"))
        .when(kind == "R", F.concat(F.lit("  R "), "a_path", F.lit(" -> "), "b_path"))
        .otherwise(
            F.concat(
                F.lit("  "), kind, F.lit(" "),
                F.when(F.length("b_path") > 0, F.col("b_path")).otherwise(F.col("a_path")),
            )
        )
    )
    keys = ["repo", "sha"]
    listed = (
        changes.join(newest.select(*keys), keys, "left_semi")
        .withColumn("part", F.floor(F.col("ord") / PART_CHANGES).cast("int"))
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("lines"))
        .select(
            *keys, "part",
            F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("listing"),
        )
    )
    when = isoformat(F.col("date"))
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("Commit: "), "sha"),
        F.concat(F.lit("Author: "), "author", F.lit(" <"), "email", F.lit(">")),
        F.concat(F.lit("Date: "), when),
        F.concat(F.lit("Message: "), F.regexp_replace("message", r"^\s+|\s+$", "")),
    )
    files = F.concat(F.lit("\n\nChanged files:\n"), "listing")
    return (
        newest.join(listed, keys, "left")
        .withColumn("part", F.coalesce("part", F.lit(0)))
        .select(
            *keys,
            (F.col("age") - 1).alias("age"),
            "part",
            F.concat(head, F.coalesce(files, F.lit(""))).alias("text"),
            "author",
            when.alias("date"),
        )
    )
