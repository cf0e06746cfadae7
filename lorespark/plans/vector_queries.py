"""Queries over vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.operators.embedding import check_dimension, embed
from lorespark.operators.vectors import (
    ann_recall,
    assign_cells,
    count_vectors,
    delete_by_ids,
    get_by_ids,
    train_cells,
    upsert_vectors,
    vector_topk,
    vector_topk_ann,
    where_equals,
)
from lorespark.plans.fixtures import Model
from lorespark.plans.registry import query, sql_terms

K = 5


def _topk_sql(condition: str, k: int = K) -> str:
    return f"""with pair as (
      select query_id, vec_id,
        round(1 - list_cosine_similarity(v.embedding, q.embedding), 10) + 0.0 as distance
      from m_vectors v join m_vector_queries q on {condition}),
    ranked as (
      select *, row_number() over (partition by query_id order by distance, vec_id)::int as rank from pair)
    select query_id, vec_id, rank, round(distance, 6) + 0.0 as distance from ranked where rank <= {k}"""


def _shown(found: DataFrame) -> DataFrame:
    distance = (F.round("distance", 6) + F.lit(0.0)).alias("distance")
    return found.select("query_id", "vec_id", "rank", distance)


@query("vector_topk", ["m_vectors", "m_vector_queries"], _topk_sql("true"))
def vector_topk_all(m: Model) -> DataFrame:
    return _shown(vector_topk(m.vectors(), m.vector_queries(), K, scoped=False))


@query(
    "vector_topk_filtered",
    ["m_vectors", "m_vector_queries"],
    _topk_sql("v.kb_id = q.kb_id and v.shelf = 's1'"),
)
def vector_topk_filtered(m: Model) -> DataFrame:
    return _shown(vector_topk(m.vectors(), m.vector_queries(), K, where={"shelf": "s1"}))


@query(
    "vector_topk_batch", ["m_vectors", "m_vector_queries"], _topk_sql("v.kb_id = q.kb_id")
)
def vector_topk_batch(m: Model) -> DataFrame:
    return _shown(vector_topk(m.vectors(), m.vector_queries(), K))


@query(
    "vector_topk_tiled", ["m_vectors", "m_vector_queries"], _topk_sql("v.kb_id = q.kb_id")
)
def vector_topk_tiled(m: Model) -> DataFrame:
    """The way taken when the queries are too many to travel with the tasks."""
    found = vector_topk(m.vectors(), m.vector_queries(), K, resident_queries=0, tile=64)
    return _shown(found)


@query("vector_ann_recall")
def vector_ann_recall(m: Model) -> DataFrame:
    exact = vector_topk(m.vectors(), m.vector_queries(), K)
    return ann_recall(exact, vector_topk_ann(m.vectors(), m.vector_queries(), K))


@query(
    "vector_ann_reached",
    ["m_vectors", "m_vector_queries"],
    "select kb_id, count(*) as queries, true as reached from m_vector_queries group by kb_id",
)
def vector_ann_reached(m: Model) -> DataFrame:
    """Whether the probed cells hold nine in ten of each kb's exact neighbours."""
    found = vector_ann_recall(m).join(m.vector_queries().select("query_id", "kb_id"), "query_id")
    return found.groupBy("kb_id").agg(
        F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= 0.9).alias("reached")
    )


@query(
    "vector_ann",
    ["m_vectors", "m_vector_queries"],
    _topk_sql("v.shelf = 's1'"),
)
def vector_ann(m: Model) -> DataFrame:
    """Filtered and over all kbs; with every cell probed the answer is the exact one."""
    vectors = m.vectors()
    cells = train_cells(vectors, K, scoped=False)
    found = vector_topk_ann(
        assign_cells(vectors, cells), m.vector_queries(), K, cells, len(cells.lift), {"shelf": "s1"}, scoped=False
    )
    return _shown(found)


@query(
    "vector_where",
    ["m_vectors"],
    "select vec_id, kb_id from m_vectors where shelf = 's2' and kb_id = 'kb3'",
)
def vector_where(m: Model) -> DataFrame:
    return where_equals(m.vectors(), {"shelf": "s2", "kb_id": "kb3"}).select("vec_id", "kb_id")


def _updates(m: Model) -> DataFrame:
    """New documents for a third of the vectors, in two versions, and new ids for another."""
    v = m.vectors()
    n = F.col("vec_id").cast("long")
    versions = F.explode(F.array(F.lit(1), F.lit(2))).alias("version")
    changed = v.filter(n % 3 == 0).select("*", versions)
    added = v.filter(n % 3 == 1).withColumn("vec_id", F.concat(F.lit("n"), "vec_id"))
    both = changed.unionByName(added.withColumn("version", F.lit(1)))
    document = F.concat(F.lit("v"), F.col("version").cast("string"), F.lit(" "), F.col("vec_id"))
    return both.withColumn("document", document)


@query(
    "vector_upsert",
    ["m_vectors"],
    """select vec_id, kb_id, 'v2 ' || vec_id as document from m_vectors where vec_id::int % 3 = 0
       union all
       select vec_id, kb_id, 'doc ' || vec_id from m_vectors where vec_id::int % 3 <> 0
       union all
       select 'n' || vec_id, kb_id, 'v1 n' || vec_id from m_vectors where vec_id::int % 3 = 1""",
)
def vector_upsert(m: Model) -> DataFrame:
    updated = upsert_vectors(m.vectors(), _updates(m), "version")
    return updated.select("vec_id", "kb_id", "document")


def _chosen(m: Model) -> DataFrame:
    """Ids named by another table, some of which no vector has."""
    return m.table("labels").filter("quality = 1").select(F.col("doc_id").cast("string").alias("vec_id"))


@query(
    "vector_get",
    ["m_vectors"],
    """select vec_id, kb_id, shelf from m_vectors
       where vec_id in (select doc_id::varchar from labels where quality = 1)""",
)
def vector_get(m: Model) -> DataFrame:
    found = get_by_ids(m.vectors(), _chosen(m))
    return found.select("vec_id", "kb_id", F.col("metadata")["shelf"].alias("shelf"))


@query(
    "vector_delete",
    ["m_vectors"],
    """select vec_id, kb_id from m_vectors
       where vec_id not in (select doc_id::varchar from labels where quality = 1)""",
)
def vector_delete(m: Model) -> DataFrame:
    return delete_by_ids(m.vectors(), _chosen(m)).select("vec_id", "kb_id")


@query(
    "vector_count",
    ["m_vectors"],
    """select k.kb_id, count(v.vec_id) as vectors
       from (select distinct 'kb' || l_linenumber as kb_id from lineitem
             union select distinct 'kb' || label from embeddings) k
       left join m_vectors v using (kb_id) group by k.kb_id""",
)
def vector_count(m: Model) -> DataFrame:
    orders = m.table("lineitem").select(F.col("l_linenumber").cast("string").alias("n"))
    labels = m.table("embeddings").select(F.col("label").cast("string").alias("n"))
    kbs = orders.union(labels).select(F.concat(F.lit("kb"), "n").alias("kb_id")).distinct()
    return count_vectors(m.vectors(), kbs)


@query(
    "vector_dims",
    ["m_vectors"],
    """select kb_id, count(*) filter (where len(e) = 64) as good,
              count(*) filter (where len(e) <> 64) as rejected
       from (select kb_id, case when vec_id like '%7' then embedding[1:63] else embedding end as e
             from m_vectors) group by kb_id""",
)
def vector_dims(m: Model) -> DataFrame:
    short = F.when(F.col("vec_id").endswith("7"), F.slice("embedding", 1, 63))
    mixed = m.vectors().withColumn("embedding", F.coalesce(short, "embedding"))
    good, rejects = check_dimension(mixed, 64)
    both = good.select("kb_id", F.lit(1).alias("ok")).unionByName(
        rejects.select("kb_id", F.lit(0).alias("ok"))
    )
    return both.groupBy("kb_id").agg(
        F.sum("ok").alias("good"), F.sum(1 - F.col("ok")).alias("rejected")
    )


def hashed_sql(name: str, source: str, key: str, text: str, dim: int = 64) -> str:
    """CTEs ``<name>_bucket`` (non-zero cells) of the hashed bag of words of ``source``."""
    return f"""
{name}_term as (select {key}, unnest({sql_terms(text)}) as t from {source}),
{name}_count as (
  select {key}, (('0x' || substr(md5(t), 1, 8))::bigint % {dim})::int as bucket, count(*) as n
  from {name}_term group by all),
{name}_norm as (select {key}, sqrt(sum(n * n)) as norm from {name}_count group by {key}),
{name}_bucket as (
  select {key}, bucket, (n / norm)::float::double as value
  from {name}_count join {name}_norm using ({key}))
"""


@query(
    "hash_embeddings",
    ["m_contents"],
    f"""with {hashed_sql('e', 'm_contents', 'source_id', 'text')}
    select source_id, bucket, round(value, 6) as value from e_bucket""",
)
def hash_embeddings(m: Model) -> DataFrame:
    vectors = embed(m.contents().select("source_id", "text"), "text")
    cell = F.transform(
        "embedding",
        lambda v, i: F.struct(
            i.alias("bucket"), F.round(v.cast("double"), 6).alias("value")
        ),
    )
    return vectors.select("source_id", F.inline(F.filter(cell, lambda c: c["value"] != 0)))
