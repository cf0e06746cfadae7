"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorespark.llm import (
    decontamination, embedding_dups, language, mixing, packing, periodic, quality, repeats, simhash, token_files,
    toxicity, treap, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op3_mix_sources", mixing.SQL)
def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, folder, "documents"))


@query("op4_simhash")
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash(table(spark, folder, "documents"))


@query("op8_decontaminate", decontamination.SQL)
def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_counts(table(spark, folder, "documents"))


@query("op7_pack_tokens")
def op7_pack_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_files(table(spark, folder, "documents"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_query(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op6_quality")
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_query(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_language")
def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_query(table(spark, folder, "documents"))


@query("op1_embedding_dups")
def op1_embedding_dups(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dups.embedding_links(table(spark, folder, "embeddings"))


@query("op10_remove_repeats")
def op10_remove_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.repeats_query(table(spark, folder, "documents"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.runs_query(table(spark, folder, "documents"))


@query("op13_warc", warc.SQL)
def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.warc_query(table(spark, folder, "pages"))


@query("op11_ranked_search", treap.SQL)
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return treap.ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
