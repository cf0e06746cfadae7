"""The registry of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorespark.functions.text import FOLD_FROM, FOLD_TO, TERM, TOKEN_UNIT
from lorespark.plans.fixtures import Model, with_views

Query = Callable[[Model], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, views: list[str] | None = None, sql: str | None = None):
    """Register a query over the model tables with the SQL it must agree with."""

    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, folder: build(Model(spark, folder))
        if sql is not None:
            SQL[name] = with_views(views or [], sql)
        return build

    return register


def sql_terms(text: str) -> str:
    return f"regexp_extract_all(translate(lower({text}), '{FOLD_FROM}', '{FOLD_TO}'), '{TERM}')"


def sql_tokens(text: str) -> str:
    return f"regexp_extract_all({text}, '{TOKEN_UNIT}')"
