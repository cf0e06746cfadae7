"""Fetched HTTP responses to contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.sources.jsontext import indent_json


def response_documents(responses: DataFrame, empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(documents, rejects)`` of ``responses(url, status_code, content_type, body, ...)``.

    Error statuses and missing ones are rejected, JSON bodies re-indented, empty bodies dropped
    unless ``empty`` keeps them.
    """
    failed = F.coalesce(F.col("status_code") >= 400, F.lit(True))
    is_json = F.coalesce(F.col("content_type").contains("json"), F.lit(False))
    kept = [c for c in responses.columns if c != "body"]
    good = responses.filter(~failed)
    plain = good.filter(~is_json).select(*kept, F.col("body").alias("text"))
    json = good.filter(is_json).select(*kept, indent_json(F.col("body")).alias("text"))
    documents = plain.unionByName(json)
    if not empty:
        documents = documents.filter(F.length("text") > 0)
    return documents, responses.filter(failed)
