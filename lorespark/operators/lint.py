"""Consistency checks over the page graph, and their repair.

Checks never write. Every issue carries its targets in columns, so repair does not parse
messages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.operators.wiki import (
    INDEX_LINES,
    build_index,
    extract_wikilinks,
    orphan_pages,
    stored_indexes,
    write_index,
)
from lorespark.schemas import LINT_TYPES
from lorespark.session import durable

ISSUE = [
    "kb_id",
    "type",
    "severity",
    "page_id",
    "message",
    "auto_fixable",
    "target_title",
    "target_source",
]


def _issues(
    df: DataFrame,
    kind: str,
    message: Column,
    fixable: bool,
    page: str | None = "page_id",
    title: str | None = None,
    source: str | None = None,
) -> DataFrame:
    def column(name: str | None) -> Column:
        return F.col(name) if name else F.lit(None).cast("string")

    return df.select(
        "kb_id",
        F.lit(kind).alias("type"),
        F.lit("warning").alias("severity"),
        column(page).alias("page_id"),
        message.alias("message"),
        F.lit(fixable).alias("auto_fixable"),
        column(title).alias("target_title"),
        column(source).alias("target_source"),
    )


def lint_orphans(pages: DataFrame, links: DataFrame) -> DataFrame:
    message = F.format_string("Page '%s' has no inbound links.", "title")
    return _issues(orphan_pages(pages, links), "orphan_page", message, False)


def missing_titles(pages: DataFrame) -> DataFrame:
    """``(kb_id, title, page_id)``: linked titles without a page, with the first page linking."""
    keys = ["kb_id", "title"]
    linked = (
        extract_wikilinks(pages)
        .groupBy(*keys)
        .agg(F.min_by("page_id", F.struct("created_at", "page_id")).alias("page_id"))
    )
    return linked.join(pages.select(*keys).distinct(), keys, "left_anti")


def lint_missing_pages(pages: DataFrame) -> DataFrame:
    message = F.format_string("Wikilink [[%s]] points to a non-existent page.", "title")
    return _issues(missing_titles(pages), "missing_page", message, True, title="title")


def lint_stale_refs(pages: DataFrame, page_sources: DataFrame, sources: DataFrame) -> DataFrame:
    stale = page_sources.join(sources.select("source_id"), "source_id", "left_anti")
    rows = stale.join(pages.select("page_id", "kb_id", "title"), "page_id")
    message = F.format_string("Page '%s' references deleted source '%s'.", "title", "source_id")
    return _issues(rows, "stale_ref", message, True, source="source_id")


def lint_coverage_gaps(pages: DataFrame, page_sources: DataFrame, sources: DataFrame) -> DataFrame:
    used = (
        page_sources.join(pages.select("page_id", "kb_id"), "page_id")
        .select("kb_id", "source_id")
        .distinct()
    )
    bare = sources.join(used, ["kb_id", "source_id"], "left_anti")
    message = F.format_string("Source '%s' (%s) has no wiki pages.", "uri", "source_id")
    return _issues(bare, "coverage_gap", message, False, page=None, source="source_id")


def lint_index_drift(pages: DataFrame, part_rows: int = INDEX_LINES) -> DataFrame:
    """One issue per kb whose stored index is absent or differs from the generated one."""
    stored = stored_indexes(pages).select(
        "kb_id",
        "title",
        F.col("page_id").alias("stored_id"),
        F.col("content").alias("stored_content"),
    )
    both = build_index(pages, part_rows).join(stored, ["kb_id", "title"], "full")
    differs = ~F.col("content").eqNullSafe(F.col("stored_content"))
    first = F.min_by("stored_id", "title")
    judged = both.groupBy("kb_id").agg(
        F.max(differs).alias("differs"), first.alias("page_id"), F.count("stored_id").alias("kept")
    )
    listed = (
        pages.filter(F.col("page_type") != "index").select("kb_id").distinct()
        .withColumn("listed", F.lit(True))
    )
    drift = judged.join(listed, "kb_id", "left").filter(
        F.col("differs") & ((F.col("kept") > 0) | F.col("listed"))
    )
    message = F.when(
        F.col("kept") > 0, F.lit("Index page is out of sync with actual pages.")
    ).otherwise(F.lit("No index page exists, but the KB has pages."))
    return _issues(drift, "index_drift", message, True)


def lint_issues(
    pages: DataFrame, links: DataFrame, page_sources: DataFrame, sources: DataFrame
) -> DataFrame:
    checks = [
        lint_orphans(pages, links),
        lint_missing_pages(pages),
        lint_stale_refs(pages, page_sources, sources),
        lint_coverage_gaps(pages, page_sources, sources),
        lint_index_drift(pages),
    ]
    return reduce(DataFrame.unionByName, checks)


def lint_report(
    pages: DataFrame,
    links: DataFrame,
    page_sources: DataFrame,
    sources: DataFrame,
    checked_at: Column,
    kbs: DataFrame | None = None,
) -> DataFrame:
    """One row per kb: issues by type, number of pages and of outbound links, time.

    Without ``kbs``, every kb with a page or a source is reported.
    """
    counts = pages.groupBy("kb_id").agg(F.count(F.lit(1)).alias("page_count"))
    out = (
        links.join(pages.select(F.col("page_id").alias("from_page_id"), "kb_id"), "from_page_id")
        .groupBy("kb_id")
        .agg(F.count(F.lit(1)).alias("link_count"))
    )
    found = lint_issues(pages, links, page_sources, sources).groupBy("kb_id").agg(
        F.count(F.lit(1)).alias("issues"),
        *[F.count_if(F.col("type") == t).alias(f"{t}s") for t in LINT_TYPES],
        F.count_if("auto_fixable").alias("fixable"),
    )
    if kbs is None:
        kbs = counts.select("kb_id").union(sources.select("kb_id")).distinct()
    base = kbs.select("kb_id")
    report = base.join(counts, "kb_id", "left").join(out, "kb_id", "left").join(found, "kb_id", "left")
    return report.na.fill(0).withColumn("checked_at", checked_at)


def fix_missing_pages(pages: DataFrame, issues: DataFrame, now: Column) -> DataFrame:
    """Add a stub page for each missing title that still has no page."""
    keys = ["kb_id", "title"]
    wanted = (
        issues.filter(F.col("type") == "missing_page")
        .select("kb_id", F.col("target_title").alias("title"))
        .distinct()
        .join(pages.select(*keys).distinct(), keys, "left_anti")
    )
    stubs = wanted.select(
        F.sha2(F.concat_ws(":", F.lit("stub"), "kb_id", "title"), 256).alias("page_id"),
        "kb_id",
        "title",
        F.concat(
            F.lit("# "), F.col("title"), F.lit("\n\n_Stub page — auto-generated by linter._\n")
        ).alias("content"),
        F.lit("entity").alias("page_type"),
        F.array().cast("array<string>").alias("tags"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    return pages.unionByName(stubs.select(*pages.columns))


def fix_stale_refs(page_sources: DataFrame, issues: DataFrame) -> DataFrame:
    """Drop the associations named by stale-reference issues."""
    stale = issues.filter(F.col("type") == "stale_ref").select(
        "page_id", F.col("target_source").alias("source_id")
    )
    keys = ["page_id", "source_id"]
    return page_sources.join(stale, keys, "left_anti").select(*page_sources.columns)


def lint_fix(
    pages: DataFrame,
    links: DataFrame,
    page_sources: DataFrame,
    sources: DataFrame,
    now: Column,
    issues: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repair what can be repaired: ``(pages, page_sources, fixed issues)``.

    Issues and repaired pages are stored, since each is read several times. Missing pages come
    first, then stale references, then the index over the repaired pages. Only
    kbs with an index issue, or whose pages the repair itself changed, get a new index.
    """
    if issues is None:
        issues = lint_issues(pages, links, page_sources, sources)
    fixed = durable(issues.filter("auto_fixable"))
    repaired = durable(fix_missing_pages(pages, fixed, now))
    refs = fix_stale_refs(page_sources, fixed)
    touched = fixed.filter(F.col("type").isin("index_drift", "missing_page")).select("kb_id")
    touched = touched.distinct()
    inside = repaired.join(touched, "kb_id", "left_semi").select(*pages.columns)
    outside = repaired.join(touched, "kb_id", "left_anti").select(*pages.columns)
    return outside.unionByName(write_index(inside, now)), refs, fixed
