"""Pages, links, source associations and the generated index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.frames import bounded_parts, earliest, numbered, reject
from lorespark.functions.text import wikilinks
from lorespark.schemas import INDEX_TITLE, PAGE_TYPES

# Neighbours that one row of a page view may hold, and lines that one index page may hold:
# a few megabytes and some tens of megabytes of text.
PART_ROWS = 100_000
INDEX_LINES = 500_000


def add_pages(
    pages: DataFrame, links: DataFrame, page_sources: DataFrame, new: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Append pages that carry ``source_ids`` and ``outbound_links`` arrays.

    Returns the three tables; edges are distinct.
    """
    edges = new.select(
        F.col("page_id").alias("from_page_id"), F.explode("outbound_links").alias("to_page_id")
    )
    used = new.select("page_id", F.explode("source_ids").alias("source_id"))
    return (
        pages.unionByName(new.select(*pages.columns)),
        add_links(links, edges),
        add_page_sources(page_sources, used),
    )


def update_pages(pages: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """Partial update: a null in ``patches(page_id, title, content, tags)`` keeps the old value."""
    reject(patches.join(pages, "page_id", "left_anti"), "page_id", "page not found")
    patch = patches.select(
        "page_id", *[F.col(c).alias(f"_{c}") for c in ("title", "content", "tags")],
        F.lit(True).alias("_patched"),
    )
    joined = pages.join(patch, "page_id", "left")
    for c in ("title", "content", "tags"):
        joined = joined.withColumn(c, F.coalesce(f"_{c}", c))
    stamped = F.when(F.col("_patched"), now).otherwise(F.col("updated_at"))
    return joined.withColumn("updated_at", stamped).select(*pages.columns)


def delete_pages(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Remove pages with their postings, associations and links in both directions.

    ``tables`` may hold ``pages``, ``postings``, ``page_sources`` and ``links``; others pass.
    """
    ids = ids.select("page_id").distinct()
    out = dict(tables)
    for name in ("pages", "postings", "page_sources"):
        if name in out:
            columns = out[name].columns
            out[name] = out[name].join(ids, "page_id", "left_anti").select(*columns)
    if "links" in out:
        kept = out["links"]
        for end in ("from_page_id", "to_page_id"):
            kept = kept.join(ids.withColumnRenamed("page_id", end), end, "left_anti")
        out["links"] = kept.select("from_page_id", "to_page_id")
    return out


def list_pages(
    pages: DataFrame, kb_id: str | None = None, page_type: str | None = None
) -> DataFrame:
    if kb_id is not None:
        pages = pages.filter(F.col("kb_id") == kb_id)
    if page_type is not None:
        pages = pages.filter(F.col("page_type") == page_type)
    return pages


def pages_by_title(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """The page of each ``(kb_id, title)``; of several, the first created."""
    keys = ["kb_id", "title"]
    wanted = titles.select(*keys).distinct()
    found = earliest(
        pages.join(wanted, keys, "left_semi").select(*keys, "created_at", "page_id"),
        keys,
        ["created_at", "page_id"],
    )
    return pages.join(found.select("page_id"), "page_id", "left_semi")


def page_view(
    pages: DataFrame, links: DataFrame, page_sources: DataFrame, part_rows: int = PART_ROWS
) -> DataFrame:
    """Pages with sorted arrays ``source_ids``, ``inbound`` and ``outbound``.

    A page with more than ``part_rows`` neighbours comes as several rows, told apart by
    ``part``, each with a share of them; every other page is one row with part 0.
    """
    edges = (
        links.select(
            F.col("from_page_id").alias("page_id"),
            F.lit("outbound").alias("kind"),
            F.col("to_page_id").alias("other"),
        )
        .unionByName(
            links.select(
                F.col("to_page_id").alias("page_id"),
                F.lit("inbound").alias("kind"),
                F.col("from_page_id").alias("other"),
            )
        )
        .unionByName(
            page_sources.select(
                "page_id", F.lit("source").alias("kind"), F.col("source_id").alias("other")
            )
        )
    )

    def side(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("other"))))

    sides = (
        bounded_parts(edges, ["page_id"], "other", part_rows)
        .groupBy("page_id", "part")
        .agg(
            side("source").alias("source_ids"),
            side("inbound").alias("inbound"),
            side("outbound").alias("outbound"),
        )
    )
    none = F.array().cast("array<string>")
    out = pages.join(sides, "page_id", "left").withColumn("part", F.coalesce("part", F.lit(0)))
    for c in ("source_ids", "inbound", "outbound"):
        out = out.withColumn(c, F.coalesce(c, none))
    return out


def _pairs_without(pairs: DataFrame, gone: DataFrame) -> DataFrame:
    keys = pairs.columns
    return pairs.join(gone.select(*keys), keys, "left_anti").select(*keys)


def add_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Insert edges; those already there change nothing."""
    return links.unionByName(new.select(*links.columns)).dropDuplicates()


def remove_links(links: DataFrame, gone: DataFrame) -> DataFrame:
    return _pairs_without(links, gone)


def add_page_sources(page_sources: DataFrame, new: DataFrame) -> DataFrame:
    return page_sources.unionByName(new.select(*page_sources.columns)).dropDuplicates()


def remove_page_sources(page_sources: DataFrame, gone: DataFrame) -> DataFrame:
    return _pairs_without(page_sources, gone)


def page_sources_of(page_sources: DataFrame, pages: DataFrame) -> DataFrame:
    return page_sources.join(pages.select("page_id"), "page_id", "left_semi")


def linked_pages(pages: DataFrame, links: DataFrame, direction: str = "outbound") -> DataFrame:
    """Full page rows one hop away: ``of_page_id`` is the page asked about."""
    ends = {
        "outbound": ("from_page_id", "to_page_id"),
        "inbound": ("to_page_id", "from_page_id"),
    }
    if direction not in ends:
        raise ValueError(f"direction must be 'outbound' or 'inbound', got {direction!r}")
    near, far = ends[direction]
    hops = links.select(F.col(near).alias("of_page_id"), F.col(far).alias("page_id"))
    return hops.join(pages, "page_id").select("of_page_id", *pages.columns)


def orphan_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages other than index pages that no link points to."""
    targets = links.select(F.col("to_page_id").alias("page_id")).distinct()
    return pages.filter(F.col("page_type") != "index").join(targets, "page_id", "left_anti")


def extract_wikilinks(pages: DataFrame) -> DataFrame:
    """``(kb_id, page_id, pos, title)`` of every ``[[Title]]`` in page contents."""
    return pages.select(
        "kb_id",
        "page_id",
        *[c for c in ("created_at",) if c in pages.columns],
        F.posexplode(wikilinks(F.col("content"))).alias("pos", "title"),
    )


def _section(page_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for i, t in enumerate(PAGE_TYPES) for x in (t, i)])
    return F.try_element_at(table, page_type)


def stored_indexes(pages: DataFrame) -> DataFrame:
    """Index pages by title, part by part: the first page of that title, if it is an index."""
    titled = pages.filter(
        (F.col("title") == INDEX_TITLE) | F.col("title").rlike(rf"^{INDEX_TITLE} \(\d+\)$")
    )
    first = earliest(
        titled.select("kb_id", "title", "created_at", "page_id", "page_type", "content"),
        ["kb_id", "title"],
        ["created_at", "page_id"],
    )
    return first.filter(F.col("page_type") == "index").drop("page_type")


def index_title(part: Column) -> Column:
    more = F.concat(F.lit(f"{INDEX_TITLE} ("), (part + 1).cast("string"), F.lit(")"))
    return F.when(part == 0, F.lit(INDEX_TITLE)).otherwise(more)


def build_index(pages: DataFrame, part_rows: int = INDEX_LINES) -> DataFrame:
    """``(kb_id, part, page_id, title, content, is_new)``: the index page of each kb.

    Sections follow the order of page types, titles are sorted. An index that exists keeps
    its id. A kb with more than ``part_rows`` pages gets its index in consecutive parts
    (``Index``, ``Index (2)``, ...), because one string cannot hold a kb of any size.
    """
    entries = pages.filter(F.col("page_type") != "index").select(
        "kb_id", _section(F.col("page_type")).alias("section"), "page_type", "title", "page_id"
    )
    kbs = pages.select("kb_id").distinct()
    large = (
        entries.groupBy("kb_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > part_rows)
        .select("kb_id")
    )
    rows = entries.withColumn("part", F.lit(0))
    if not large.isEmpty():
        order = ["section", "title", "page_id"]
        far = numbered(entries.join(large, "kb_id", "left_semi"), ["kb_id"], order, "at")
        rows = rows.join(large, "kb_id", "left_anti").unionByName(
            far.withColumn("part", F.floor((F.col("at") - 1) / part_rows).cast("int")).drop("at")
        )
    lines = F.transform(
        F.array_sort(F.collect_list("title")),
        lambda t: F.concat(F.lit("- [["), t, F.lit("]]\n")),
    )
    sections = rows.groupBy("kb_id", "part", "section", "page_type").agg(
        F.concat(
            F.lit("## "),
            F.initcap("page_type"),
            F.lit("\n\n"),
            F.array_join(lines, ""),
        ).alias("body")
    )
    bodies = sections.groupBy("kb_id", "part").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("section", "body"))), lambda s: s["body"]),
            "\n",
        ).alias("body")
    )
    head = F.when(F.col("part") == 0, F.lit("# Index\n")).otherwise(F.lit(""))
    gap = F.when((F.col("part") == 0) & F.col("body").isNotNull(), F.lit("\n")).otherwise(F.lit(""))
    built = (
        kbs.join(bodies, "kb_id", "left")
        .withColumn("part", F.coalesce("part", F.lit(0)))
        .withColumn("content", F.concat(head, gap, F.coalesce("body", F.lit(""))))
        .withColumn("title", index_title(F.col("part")))
    )
    stored = stored_indexes(pages).select("kb_id", "title", F.col("page_id").alias("_old"))
    fresh = F.sha2(F.concat_ws(":", "kb_id", "title"), 256)
    return built.join(stored, ["kb_id", "title"], "left").select(
        "kb_id",
        "part",
        F.coalesce("_old", fresh).alias("page_id"),
        "title",
        "content",
        F.col("_old").isNull().alias("is_new"),
    )


def write_index(pages: DataFrame, now: Column, part_rows: int = INDEX_LINES) -> DataFrame:
    """The pages table with every index page brought up to date; surplus index parts go."""
    index = build_index(pages, part_rows)
    surplus = stored_indexes(pages).join(index, ["kb_id", "title"], "left_anti").select("page_id")
    fresh = index.filter("is_new").select(
        "page_id",
        "kb_id",
        "title",
        "content",
        F.lit("index").alias("page_type"),
        F.array().cast("array<string>").alias("tags"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    patch = index.filter("not is_new").select(
        "page_id", F.col("content").alias("_content"), F.lit(True).alias("_hit")
    )
    kept = (
        pages.join(surplus, "page_id", "left_anti")
        .join(patch, "page_id", "left")
        .withColumn("content", F.coalesce("_content", "content"))
        .withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at")))
        .select(*pages.columns)
    )
    return kept.unionByName(fresh.select(*pages.columns))
