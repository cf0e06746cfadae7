"""Knowledge bases and their sources as bulk table edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.frames import reject
from lorespark.operators.wiki import delete_pages

Tables = dict[str, DataFrame]


def create_kbs(kbs: DataFrame, new: DataFrame) -> DataFrame:
    """Append knowledge bases; a name that is taken, also within ``new``, is an error."""
    both = kbs.select("name").unionByName(new.select("name"))
    taken = both.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    reject(taken.join(new, "name", "left_semi"), "name", "knowledge base name already used")
    return kbs.unionByName(new.select(*kbs.columns))


def kb_info(kbs: DataFrame, sources: DataFrame, pages: DataFrame) -> DataFrame:
    """Knowledge bases in order of creation with ``source_count`` and ``page_count``."""
    n_sources = sources.groupBy("kb_id").agg(F.count(F.lit(1)).alias("source_count"))
    n_pages = pages.groupBy("kb_id").agg(F.count(F.lit(1)).alias("page_count"))
    return (
        kbs.join(n_sources, "kb_id", "left")
        .join(n_pages, "kb_id", "left")
        .na.fill(0, ["source_count", "page_count"])
        .orderBy("created_at", "kb_id")
    )


def _without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids, key, "left_anti").select(*df.columns)


def delete_kb(tables: Tables, ids: DataFrame) -> Tables:
    """Remove knowledge bases from every table, vectors, links and associations included."""
    ids = ids.select("kb_id").distinct()
    out = dict(tables)
    if "pages" in out:
        doomed = out["pages"].join(ids, "kb_id", "left_semi").select("page_id")
        out = delete_pages(out, doomed)
    if "page_sources" in out and "sources" in out:
        gone = out["sources"].join(ids, "kb_id", "left_semi").select("source_id")
        out["page_sources"] = _without(out["page_sources"], gone, "source_id")
    for name in ("run_events", "chunks", "vectors", "sources", "kbs"):
        if name in out:
            out[name] = _without(out[name], ids, "kb_id")
    return out


def list_sources(sources: DataFrame, kb_id: str) -> DataFrame:
    return sources.filter(F.col("kb_id") == kb_id)


def get_sources(sources: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the given sources; an id without a source is an error."""
    reject(ids.join(sources, "source_id", "left_anti"), "source_id", "source not found")
    return sources.join(ids.select("source_id"), "source_id", "left_semi")


def list_chunks(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks of the given sources."""
    return chunks.join(sources.select("source_id"), "source_id", "left_semi")


def drop_chunks(tables: Tables, ids: DataFrame) -> Tables:
    """Remove the chunks of sources and the vectors made from them."""
    ids = ids.select("source_id").distinct()
    out = dict(tables)
    if "vectors" in out and "chunks" in out:
        old = list_chunks(out["chunks"], ids).select(F.col("chunk_id").alias("vec_id"))
        out["vectors"] = _without(out["vectors"], old, "vec_id")
    if "chunks" in out:
        out["chunks"] = _without(out["chunks"], ids, "source_id")
    return out


def remove_sources(tables: Tables, ids: DataFrame) -> Tables:
    """Remove sources with vectors, runs, chunks and associations; pages stay."""
    reject(ids.join(tables["sources"], "source_id", "left_anti"), "source_id", "source not found")
    ids = ids.select("source_id").distinct()
    out = drop_chunks(tables, ids)
    for name in ("run_events", "page_sources", "sources"):
        if name in out:
            out[name] = _without(out[name], ids, "source_id")
    return out
