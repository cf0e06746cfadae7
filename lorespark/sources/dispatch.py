"""All source kinds through one door.

A reader turns sources into rows of one stream: ``source_id, kb_id, part, text, metadata, error``.
A row has a text, or the error that stands in its way. So a pass over the sources gives both, and
one bad source does not end the others.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.frames import reject
from lorespark.schemas import MAX_COMMITS
from lorespark.sources.commits import commit_documents
from lorespark.sources.files import read_codebase, read_files, read_tree
from lorespark.sources.html import extract_pages
from lorespark.sources.metadata import merge_metadata
from lorespark.sources.responses import response_documents
from lorespark.sources.tables import table_cards

# Room for the parts of one commit in the part number of a source.
PARTS_PER_COMMIT = 1_000

Reader = Callable[[DataFrame], DataFrame]

FILE_READERS: dict[str, Reader] = {
    "file": read_files,
    "directory": read_tree,
    "codebase": read_codebase,
}


def _by_uri(sources: DataFrame, documents: DataFrame, key: str, metadata: Column, missing: str) -> DataFrame:
    """The rows of documents that belong to the source whose ``uri`` equals ``key``.

    ``documents`` may bring an ``error``; a document without text counts as read. A source that
    meets no document at all gets the error ``missing`` and its uri.
    """
    user = sources.select("source_id", "kb_id", F.col("uri").alias(key), F.col("metadata").alias("_user"))
    part = F.col("part") if "part" in documents.columns else F.lit(0)
    error = F.col("error") if "error" in documents.columns else F.lit(None).cast("string")
    found = documents.withColumns({"_part": part, "_error": error, "_met": F.lit(True)})
    unmet = F.when(F.col("_met").isNull(), F.concat_ws(": ", F.lit(missing), F.col(key)))
    return (
        user.join(found, key, "left")
        .withColumn("error", F.coalesce("_error", unmet))
        .filter((F.length("text") > 0) | F.col("error").isNotNull())
        .select(
            "source_id",
            "kb_id",
            F.coalesce("_part", F.lit(0)).cast("int").alias("part"),
            F.when(F.col("error").isNull(), F.col("text")).alias("text"),
            merge_metadata(metadata, F.col("_user")).alias("metadata"),
            "error",
        )
    )


def _strings(*names: str) -> Column:
    return F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])


def website_reader(pages: DataFrame) -> Reader:
    """Reader over fetched ``pages(url, html)``."""

    def read(sources: DataFrame) -> DataFrame:
        read = extract_pages(pages)
        empty = pages.join(read, "url", "left_anti").select("url")
        both = read.unionByName(empty, allowMissingColumns=True)
        return _by_uri(sources, both, "url", _strings("url", "title"), "not fetched")

    return read


def api_reader(responses: DataFrame) -> Reader:
    """Reader over fetched ``responses(url, status_code, content_type, body)``."""

    def read(sources: DataFrame) -> DataFrame:
        documents, rejects = response_documents(responses, empty=True)
        status = F.coalesce(F.col("status_code").cast("string"), F.lit("missing"))
        refused = rejects.drop("body").withColumn("error", F.concat(F.lit("status "), status, F.lit(": "), "url"))
        both = documents.unionByName(refused, allowMissingColumns=True)
        return _by_uri(sources, both, "url", _strings("url", "status_code", "content_type"), "not fetched")

    return read


def commit_reader(
    commits: DataFrame, changes: DataFrame, max_commits: int = MAX_COMMITS
) -> Reader:
    """Reader over commit tables; the ``uri`` of a source is the ``repo``.

    ``max_commits`` in the metadata of a source goes before the reader's own.
    """

    def read(sources: DataFrame) -> DataFrame:
        own = F.coalesce(F.try_element_at("metadata", F.lit("max_commits")).try_cast("int"), F.lit(max_commits))
        most = sources.agg(F.max(own)).first()[0] or max_commits
        documents = commit_documents(commits, changes, most).withColumnsRenamed(
            {"repo": "repo_path", "sha": "commit_sha"}
        )
        limits = sources.select("source_id", own.alias("_most"))
        documents = documents.withColumn("part", F.col("age") * PARTS_PER_COMMIT + F.col("part"))
        shown = _strings("repo_path", "commit_sha", "author", "date")
        rows = _by_uri(sources, documents, "repo_path", shown, "no such repository")
        age = F.floor(F.col("part") / PARTS_PER_COMMIT)
        return rows.join(limits, "source_id").filter(age < F.col("_most")).drop("_most")

    return read


def table_reader(tables: Mapping[str, Mapping[str, DataFrame]], **options: object) -> Reader:
    """Reader over databases: connection ``uri`` -> table name -> frame."""

    def read(sources: DataFrame) -> DataFrame:
        spark = sources.sparkSession
        cards = None
        for uri, held in tables.items():
            if not held:
                continue
            order = {name: i for i, name in enumerate(sorted(held))}
            part = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
            card = (
                table_cards(spark, held, **options)
                .withColumn("connection_string", F.lit(uri))
                .withColumn("part", part[F.col("table")])
                .withColumnRenamed("table", "table_name")
            )
            cards = card if cards is None else cards.unionByName(card)
        # A database without tables is known all the same.
        known = spark.createDataFrame(
            [(uri, None, None, 0) for uri in tables],
            "connection_string string, table_name string, text string, part int",
        )
        cards = known if cards is None else cards.unionByName(known)
        return _by_uri(
            sources, cards, "connection_string", _strings("connection_string", "table_name"), "no such database"
        )

    return read


def read_or_fail(sources: DataFrame, readers: Mapping[str, Reader] | None = None) -> DataFrame:
    """Texts and errors of sources of any kind; each kind's reader sees only its own rows.

    Files need no setup; fetched or tabular kinds come in through ``readers``, which may also give
    rows without an ``error``. A kind that no reader covers is an error of the call.
    """
    known = {**FILE_READERS, **(readers or {})}
    reject(
        sources.filter(~F.col("source_type").isin(list(known))),
        "source_type",
        "no reader for source type",
    )
    present = [
        r[0] for r in sources.select("source_type").distinct().limit(len(known)).collect()
    ]
    parts = [known[kind](sources.filter(F.col("source_type") == kind)) for kind in present]
    if not parts:
        parts = [known["file"](sources)]
    none = F.lit(None).cast("string")
    tagged = [p if "error" in p.columns else p.withColumn("error", none) for p in parts]
    return reduce(DataFrame.unionByName, tagged)


def contents_and_errors(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contents, and ``source_id, error``, of rows that were read; store them before."""
    contents = tagged.filter("error is null").drop("error")
    return contents, tagged.filter("error is not null").select("source_id", "error")


def read_sources(sources: DataFrame, readers: Mapping[str, Reader] | None = None) -> DataFrame:
    """Contents of sources of any kind, without what could not be read; see ``read_or_fail``."""
    return contents_and_errors(read_or_fail(sources, readers))[0]
