"""Markdown export: a plan of (path, text) rows, and the sink that writes it."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lorespark.functions.text import file_stem, isoformat


def page_filename(title: Column) -> Column:
    return F.concat(file_stem(title), F.lit(".md"))


def _items(values: Column) -> Column:
    lines = F.array_join(F.transform(values, lambda v: F.concat(F.lit("  - "), v)), "\n")
    return F.when(F.size(values) > 0, lines).otherwise(F.lit("  []"))


def frontmatter() -> Column:
    """YAML header of a page row with ``tags`` and ``source_ids`` arrays."""
    return F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit("id: "), "page_id"),
        F.concat(F.lit("title: "), "title"),
        F.concat(F.lit("page_type: "), "page_type"),
        F.lit("tags:"),
        _items(F.coalesce("tags", F.array().cast("array<string>"))),
        F.concat(F.lit("created_at: "), isoformat(F.col("created_at"))),
        F.concat(F.lit("updated_at: "), isoformat(F.col("updated_at"))),
        F.lit("sources:"),
        _items(F.coalesce("source_ids", F.array().cast("array<string>"))),
        F.lit("---"),
    )


def export_since(pages: DataFrame, since: Column | None = None) -> DataFrame:
    """Pages changed at or after ``since``; all of them when it is not given."""
    return pages if since is None else pages.filter(F.col("updated_at") >= since)


def path_part(name: Column) -> Column:
    """A string as one step of a path; a hash keeps altered ones apart."""
    plain = F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "-")
    return F.when(plain == name, name).otherwise(
        F.concat_ws("--", plain, F.substring(F.sha2(name, 256), 1, 12))
    )


def export_plan(views: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``(kb_id, page_id, path, collides, text)`` of page views.

    Where several pages of a kb have the same file name, the first created keeps it and the
    others get ``--<page id>`` before the extension; a plain name never holds two dashes. The
    further parts of a page view too large for one row get ``--part-<n>``.
    ``names`` are the pages the names are decided among, by default the views themselves: an
    incremental export passes all pages, so that names do not depend on what changed.
    """
    everyone = (views if names is None else names).select(
        "kb_id", page_filename(F.col("title")).alias("name"), "created_at", "page_id"
    )
    keys = ["kb_id", "name"]
    shared = (
        everyone.groupBy(*keys)
        .agg(
            (F.min("page_id") != F.max("page_id")).alias("several"),
            F.min_by("page_id", F.struct("created_at", "page_id")).alias("owner"),
        )
        .filter("several")
        .drop("several")
    )
    suffixed = F.concat(
        F.regexp_replace("name", r"\.md$", ""),
        F.lit("--"),
        path_part(F.col("page_id")),
        F.lit(".md"),
    )
    collides = F.col("owner").isNotNull()
    name = F.when(collides & (F.col("owner") != F.col("page_id")), suffixed).otherwise(
        F.col("name")
    )
    if "part" in views.columns:
        later = F.concat(F.lit("--part-"), (F.col("part") + 1).cast("string"), F.lit(".md"))
        name = F.when(F.col("part") > 0, F.regexp_replace(name, r"\.md$", later)).otherwise(name)
    return (
        views.withColumn("name", page_filename(F.col("title")))
        .join(shared, keys, "left")
        .select(
            "kb_id",
            "page_id",
            F.concat_ws("/", path_part(F.col("kb_id")), name).alias("path"),
            collides.alias("collides"),
            F.concat(frontmatter(), F.lit("\n"), "content", F.lit("\n")).alias("text"),
        )
    )


def write_markdown(plan: DataFrame, directory: str) -> None:
    """Write one file per row under ``directory``, from the executors.

    A file is written beside its place and moved there, so a task that runs twice leaves the
    same tree. ``directory`` must be reachable from every executor.
    """

    def write(rows: Iterator[Row]) -> None:
        files, root = pafs.FileSystem.from_uri(directory)
        made = set()
        for row in rows:
            target = posixpath.join(root, row["path"])
            folder = posixpath.dirname(target)
            if folder not in made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            with files.open_output_stream(f"{target}.part") as out:
                out.write(row["text"].encode("utf-8"))
            files.move(f"{target}.part", target)

    plan.select("path", "text").foreachPartition(write)
