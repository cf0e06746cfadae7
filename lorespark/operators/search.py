"""Semantic, normalized and hybrid search over chunks and pages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.frames import fetch, latest, top_k
from lorespark.operators.embedding import Embedder, embed, embed_queries
from lorespark.operators.keyword import SCORE_PLACES, keyword_search
from lorespark.operators.vectors import vector_topk
from lorespark.schemas import KEYWORD_WEIGHT, TOP_K, VECTOR_WEIGHT
from lorespark.session import durable

RESULT = ["query_id", "kb_id", "rank", "content", "source_id", "source_type", "score", "metadata"]


def similarity(distance: Column) -> Column:
    """Cosine distance as a score between 0 and 1."""
    return F.least(F.greatest(1 - distance, F.lit(0.0)), F.lit(1.0))


def semantic_search(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    embedder: Embedder | None = None,
    where: Mapping[str, object] | None = None,
) -> DataFrame:
    """Nearest chunks per query as results. Chunks without an embedding get one here.

    Ranking reads ids and vectors; contents are fetched for the ranked rows only.
    """
    vectors = chunks if "embedding" in chunks.columns else embed(chunks, "content", embedder)
    if "embedding" not in queries.columns:
        queries = embed_queries(queries, embedder)
    found = vector_topk(vectors.withColumnRenamed("chunk_id", "vec_id"), queries, k, where)
    shown = chunks.select(
        F.col("chunk_id").alias("vec_id"),
        "kb_id",
        "content",
        F.to_json("metadata").alias("metadata"),
    )
    return fetch(found, shown, "vec_id").select(
        "query_id",
        "kb_id",
        "rank",
        "content",
        F.col("vec_id").alias("source_id"),
        F.lit("chunk").alias("source_type"),
        similarity(F.col("distance")).alias("score"),
        "metadata",
    )


def normalize_scores(results: DataFrame) -> DataFrame:
    """Min-max scores within each query and source type; a set of equal scores becomes 1.

    A set is one ranked result list, so a window holds no more rows than its ``k``.
    """
    sets = Window.partitionBy("query_id", "source_type")
    low, span = F.min("score").over(sets), F.max("score").over(sets) - F.min("score").over(sets)
    return results.withColumn(
        "score", F.when(span > 0, (F.col("score") - low) / span).otherwise(F.lit(1.0))
    )


def merge_results(
    semantic: DataFrame,
    keyword: DataFrame,
    k: int = TOP_K,
    vector_weight: float = VECTOR_WEIGHT,
    keyword_weight: float = KEYWORD_WEIGHT,
) -> DataFrame:
    """Weighted union of two normalized result lists, matched on equal content.

    When several keyword rows share a content the lowest one gives the bonus; each chunk with
    that content gets it; keyword rows without a chunk partner stay as rows of their own.
    """
    keys = ["query_id", "content"]
    bonus = latest(
        keyword.select(*keys, "rank", F.col("score").alias("bonus")), keys, ["rank"]
    ).drop("rank")
    left = semantic.join(bonus, keys, "left").withColumn(
        "score",
        vector_weight * F.col("score") + F.coalesce(keyword_weight * F.col("bonus"), F.lit(0.0)),
    )
    alone = keyword.join(semantic.select(*keys).distinct(), keys, "left_anti").withColumn(
        "score", keyword_weight * F.col("score")
    )
    both = (
        left.select(*RESULT, F.lit(0).alias("origin"))
        .unionByName(alone.select(*RESULT, F.lit(1).alias("origin")))
        .withColumn("score", F.round("score", SCORE_PLACES))
        .withColumnRenamed("rank", "place")
    )
    order = [F.col("score").desc(), F.col("origin"), F.col("place")]
    return top_k(both, ["query_id"], order, k, "rank").select(*RESULT)


def hybrid_search(
    chunks: DataFrame,
    pages: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    vector_weight: float = VECTOR_WEIGHT,
    keyword_weight: float = KEYWORD_WEIGHT,
    embedder: Embedder | None = None,
) -> DataFrame:
    """Semantic and keyword search together, twice ``k`` fetched from each before merging.

    The two short lists are stored before they meet, since the merge reads each twice.
    """
    semantic = durable(normalize_scores(semantic_search(chunks, queries, 2 * k, embedder)))
    keyword = durable(normalize_scores(keyword_search(pages, queries, 2 * k)))
    return merge_results(semantic, keyword, k, vector_weight, keyword_weight)


def results_json(results: DataFrame) -> DataFrame:
    """One JSON object per result, with its citation fields."""
    return results.select(
        "query_id",
        "rank",
        F.to_json(F.struct("content", "source_id", "source_type", "score", "metadata")).alias(
            "json"
        ),
    )
