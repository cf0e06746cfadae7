"""From source rows to chunks, vectors, summary pages and run records."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.frames import reject
from lorespark.operators.chunking import assign_chunk_ids, symbol_chunk
from lorespark.operators.embedding import Embedder, embed
from lorespark.operators.lifecycle import Tables, drop_chunks, get_sources
from lorespark.schemas import CHUNK_OVERLAP, CHUNK_SIZE, PHASES, SOURCE_TYPES
from lorespark.session import durable
from lorespark.sources.dispatch import Reader, contents_and_errors, read_or_fail

CHUNK_COLUMNS = [
    "chunk_id",
    "source_id",
    "kb_id",
    "part",
    "chunk_index",
    "content",
    "metadata",
]
# Fixed value: characters of the first chunk shown on a summary page.
PREVIEW = 500


def chunk_contents(
    contents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Chunks with ids, in one pass: contents tagged with a language are split at symbols.

    A symbol's type and name go into the metadata of its chunks.
    """
    pieces = symbol_chunk(contents, size, overlap)
    symbol = F.map_from_arrays(
        F.array(F.lit("symbol_type"), F.lit("symbol_name")),
        F.array("symbol_type", "symbol_name"),
    )
    own = F.map_filter("metadata", lambda k, _: ~k.isin("symbol_type", "symbol_name"))
    tagged = F.map_concat(own, F.map_filter(symbol, lambda _, v: v.isNotNull()))
    metadata = F.when(F.col("symbol_type").isNull(), F.col("metadata")).otherwise(tagged)
    return assign_chunk_ids(pieces.withColumn("metadata", metadata)).select(*CHUNK_COLUMNS)


def vectors_of(chunks: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Vector rows of chunks; the kb is a column, so search can be scoped to it."""
    return embed(chunks, "content", embedder).select(
        F.col("chunk_id").alias("vec_id"),
        "kb_id",
        "embedding",
        F.col("content").alias("document"),
        "metadata",
    )


def first_chunks(chunks: DataFrame) -> DataFrame:
    """``(source_id, chunk_count, preview)``; only the preview is shuffled, not the text."""
    head = F.substring("content", 1, PREVIEW)
    return chunks.groupBy("source_id").agg(
        F.count(F.lit(1)).cast("int").alias("chunk_count"),
        F.min_by(head, F.struct("part", "chunk_index")).alias("preview"),
    )


def source_summaries(sources: DataFrame, chunks: DataFrame, now: Column) -> DataFrame:
    """A summary page per source, with its association in ``source_id``."""
    counted = sources.drop("chunk_count").join(first_chunks(chunks), "source_id", "left")
    preview = F.when(
        F.col("preview").isNotNull(),
        F.concat(F.lit("\n## Content Preview\n\n"), "preview", F.lit("...")),
    ).otherwise(F.lit(""))
    content = F.concat(
        F.lit("# "),
        "uri",
        F.lit("\n\nSource type: "),
        "source_type",
        F.lit("\n\nChunks ingested: "),
        F.coalesce("chunk_count", F.lit(0)).cast("string"),
        F.lit("\n"),
        preview,
    )
    return counted.select(
        F.sha2(F.concat_ws(":", F.lit("summary"), "source_id"), 256).alias("page_id"),
        "kb_id",
        F.concat(F.lit("Source: "), "uri").alias("title"),
        content.alias("content"),
        F.lit("summary").alias("page_type"),
        F.array().cast("array<string>").alias("tags"),
        now.alias("created_at"),
        now.alias("updated_at"),
        "source_id",
    )


def mark_sources(
    sources: DataFrame, chunks: DataFrame, errors: DataFrame, now: Column
) -> DataFrame:
    """Status, chunk count and time after ingest; no chunks is still a success.

    ``errors(source_id, error)`` names the sources that failed; those keep their old count
    and time.
    """
    counts = chunks.groupBy("source_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    failed = errors.groupBy("source_id").agg(F.min("error").alias("_error"))
    bad = F.col("_error").isNotNull()
    return (
        sources.join(counts, "source_id", "left")
        .join(failed, "source_id", "left")
        .withColumn("status", F.when(bad, "failed").otherwise("ingested"))
        .withColumn(
            "chunk_count",
            F.when(bad, F.col("chunk_count")).otherwise(F.coalesce("_n", F.lit(0))),
        )
        .withColumn("ingested_at", F.when(bad, F.col("ingested_at")).otherwise(now))
        .select(*sources.columns)
    )


def ingest_events(sources: DataFrame, errors: DataFrame, now: Column) -> DataFrame:
    """The run log of an ingest: each phase started and completed, or failed at reading."""
    steps = [(p, s) for p in PHASES for s in ("running", "completed")]
    failing = steps[:3] + [("read_source", "failed")]

    def log(rows: list[tuple[str, str]]) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(i).cast("long").alias("seq"),
                    F.lit(p).alias("phase"),
                    F.lit(s).alias("status"),
                )
                for i, (p, s) in enumerate(rows)
            ]
        )

    failed = errors.groupBy("source_id").agg(F.min("error").alias("_error"))
    return (
        sources.join(failed, "source_id", "left")
        .withColumn(
            "step",
            F.explode(F.when(F.col("_error").isNull(), log(steps)).otherwise(log(failing))),
        )
        .select(
            F.sha2(F.concat_ws(":", F.lit("run"), "source_id", now.cast("string")), 256).alias(
                "run_id"
            ),
            "kb_id",
            "source_id",
            "step.*",
            now.alias("ts"),
            F.when(F.col("step.status") == "failed", F.col("_error")).alias("error"),
        )
    )


@dataclass
class Ingested:
    """What one ingest adds; append each frame to its table."""

    sources: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    pages: DataFrame
    page_sources: DataFrame
    run_events: DataFrame


def ingest(
    kbs: DataFrame,
    sources: DataFrame,
    contents: DataFrame,
    now: Column,
    errors: DataFrame | None = None,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    embedder: Embedder | None = None,
    store: Callable[[DataFrame], DataFrame] = durable,
) -> Ingested:
    """Ingest any number of sources whose text the readers delivered as ``contents``.

    Unknown knowledge bases and source types are errors. A source named in ``errors`` is
    marked failed and logged, and does not stop the others. ``store`` writes the chunks and
    gives them back, so that vectors, counts and summaries do not read and cut the texts
    again; pass a function that appends to the chunks table to write them only once.
    """
    reject(sources.join(kbs, "kb_id", "left_anti"), "kb_id", "unknown knowledge base")
    reject(
        sources.filter(~F.col("source_type").isin(SOURCE_TYPES)),
        "source_type",
        "unknown source type",
    )
    if errors is None:
        errors = sources.sparkSession.createDataFrame([], "source_id string, error string")
    failed = errors.select("source_id")
    good = sources.join(failed, "source_id", "left_anti")
    kept = contents.join(failed, "source_id", "left_anti").select(*contents.columns)
    chunks = store(chunk_contents(kept, size, overlap))
    summaries = source_summaries(good, chunks, now)
    return Ingested(
        sources=mark_sources(sources, chunks, errors, now),
        chunks=chunks,
        vectors=vectors_of(chunks, embedder),
        pages=summaries.drop("source_id"),
        page_sources=summaries.select("page_id", "source_id"),
        run_events=ingest_events(sources, errors, now),
    )


def ingest_sources(
    kbs: DataFrame,
    sources: DataFrame,
    now: Column,
    readers: Mapping[str, Reader] | None = None,
    **options: object,
) -> Ingested:
    """Read sources of any kind and ingest what was read.

    Sources are read once; what was read is stored and then parted into contents and errors. A
    source with an error is marked failed, its run log says why, and nothing of it is kept.
    """
    contents, errors = contents_and_errors(durable(read_or_fail(sources, readers)))
    return ingest(kbs, sources, contents, now, errors, **options)


def append_ingested(tables: Tables, added: Ingested) -> Tables:
    """Tables after an ingest; rows of the same source or page are replaced."""
    out = dict(tables)
    keys = {
        "sources": ["source_id"],
        "chunks": ["chunk_id"],
        "vectors": ["vec_id"],
        "pages": ["page_id"],
        "page_sources": ["page_id", "source_id"],
    }
    for name, key in keys.items():
        new, old = getattr(added, name), out.get(name)
        if old is not None:
            old = old.join(new.select(*key), key, "left_anti").select(*old.columns)
        out[name] = new if old is None else old.unionByName(new.select(*old.columns))
    events = out.get("run_events")
    out["run_events"] = (
        added.run_events
        if events is None
        else events.unionByName(added.run_events.select(*events.columns))
    )
    return out


def refresh_sources(
    tables: Tables, ids: DataFrame, contents: DataFrame, now: Column, **options: object
) -> Tables:
    """Re-ingest sources in place: old chunks and vectors go, the source keeps its id."""
    chosen = get_sources(tables["sources"], ids)
    cleared = drop_chunks(tables, ids)
    fresh = contents.join(ids.select("source_id"), "source_id", "left_semi")
    added = ingest(tables["kbs"], chosen, fresh.select(*contents.columns), now, **options)
    return append_ingested(cleared, added)
