"""Queries over knowledge bases, ingest, the run log, export and streams."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import isoformat
from lorespark.operators import export, ingest, lifecycle, runs, wiki
from lorespark.plans.fixtures import Model, minute
from lorespark.plans.registry import query
from lorespark.plans.text_queries import CHUNKS_SQL, OVERLAP, SIZE
from lorespark.plans.wiki_views import START
from lorespark.session import scratch_folder
from lorespark.sources.dispatch import api_reader, commit_reader
from lorespark.streaming.ingest import ingest_stream, latest_chunks, stream_contents
from lorespark.streaming.runs import ROCKSDB, store_run_states, stream_run_events

NOW = 525_600


def _now() -> Column:
    return minute(F.lit(NOW))


def _counted(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table and kb (empty for tables without a kb)."""

    def rows(name: str, df: DataFrame) -> DataFrame:
        kb = F.col("kb_id") if "kb_id" in df.columns else F.lit("")
        return df.groupBy(kb.alias("kb_id")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("table_name"), "kb_id", "n"
        )

    return reduce(DataFrame.unionByName, [rows(n, df) for n, df in sorted(tables.items())])


@query(
    "kb_info",
    ["m_kbs", "m_pages", "m_sources"],
    """select k.kb_id, k.name, count(distinct s.source_id) as source_count,
         (select count(*) from m_pages p where p.kb_id = k.kb_id) as page_count
       from m_kbs k left join m_sources s using (kb_id) group by k.kb_id, k.name""",
)
def kb_info(m: Model) -> DataFrame:
    info = lifecycle.kb_info(m.kbs(), m.sources(), m.pages(wide=False))
    return info.select("kb_id", "name", "source_count", "page_count")


@query(
    "kb_create",
    ["m_kbs"],
    """select kb_id, name from m_kbs
       union all select distinct 'seg-' || c_mktsegment, c_mktsegment from customer""",
)
def kb_create(m: Model) -> DataFrame:
    new = m.table("customer").select("c_mktsegment").distinct().select(
        F.concat(F.lit("seg-"), "c_mktsegment").alias("kb_id"),
        F.col("c_mktsegment").alias("name"),
        minute(F.lit(0)).alias("created_at"),
    )
    return lifecycle.create_kbs(m.kbs(), new).select("kb_id", "name")


def _tables(m: Model) -> dict[str, DataFrame]:
    chunks = m.contents().select(
        F.concat(F.lit("c"), "source_id").alias("chunk_id"), "source_id", "kb_id"
    )
    return {
        "kbs": m.kbs(),
        "sources": m.sources(),
        "pages": m.pages(wide=False),
        "links": m.links(),
        "page_sources": m.page_sources(),
        "chunks": chunks,
        "vectors": chunks.select(F.col("chunk_id").alias("vec_id"), "kb_id"),
    }


@query(
    "kb_delete",
    ["m_kbs", "m_sources", "m_pages", "m_links", "m_page_sources"],
    """with gone as (select kb_id from m_kbs where kb_id in ('src1', 'src3', 'src8')),
    dead as (select page_id from m_pages where kb_id in (from gone)),
    lost as (select source_id from m_sources where kb_id in (from gone)),
    alive as (select * from m_pages where kb_id not in (from gone))
    select 'kbs' as table_name, kb_id, count(*) as n from m_kbs where kb_id not in (from gone) group by kb_id
    union all
    select 'sources', kb_id, count(*) from m_sources where kb_id not in (from gone) group by kb_id
    union all select 'pages', kb_id, count(*) from alive group by kb_id
    union all select 'chunks', kb_id, count(*) from alive group by kb_id
    union all select 'vectors', kb_id, count(*) from alive group by kb_id
    union all
    select 'links', '', count(*) from m_links
    where from_page_id not in (from dead) and to_page_id not in (from dead)
    union all
    select 'page_sources', '', count(*) from m_page_sources
    where page_id not in (from dead) and source_id not in (from lost)""",
)
def kb_delete(m: Model) -> DataFrame:
    ids = m.kbs().filter(F.col("kb_id").isin("src1", "src3", "src8"))
    return _counted(lifecycle.delete_kb(_tables(m), ids))


@query(
    "source_remove",
    ["m_kbs", "m_sources", "m_pages", "m_links", "m_page_sources"],
    """with lost as (select source_id from m_sources where kb_id = 'src2'),
    kept as (select * from m_pages where page_id not in (from lost))
    select 'kbs' as table_name, kb_id, count(*) as n from m_kbs group by kb_id
    union all
    select 'sources', kb_id, count(*) from m_sources where source_id not in (from lost) group by kb_id
    union all select 'pages', kb_id, count(*) from m_pages group by kb_id
    union all select 'chunks', kb_id, count(*) from kept group by kb_id
    union all select 'vectors', kb_id, count(*) from kept group by kb_id
    union all select 'links', '', count(*) from m_links
    union all select 'page_sources', '', count(*) from m_page_sources where source_id not in (from lost)""",
)
def source_remove(m: Model) -> DataFrame:
    ids = lifecycle.list_sources(m.sources(), "src2")
    return _counted(lifecycle.remove_sources(_tables(m), ids))


@query(
    "sources_get",
    ["m_sources"],
    """select s.source_id, s.kb_id, s.uri, count(c.doc_id) as chunks
       from m_sources s left join documents c on c.doc_id::varchar = s.source_id
       where s.source_id in (select distinct l_suppkey::varchar from lineitem)
       group by all""",
)
def sources_get(m: Model) -> DataFrame:
    sources = m.sources()
    used = m.table("lineitem").select(F.col("l_suppkey").cast("string").alias("source_id")).distinct()
    known = used.join(sources, "source_id", "left_semi")
    found = lifecycle.get_sources(sources, known)
    chunks = lifecycle.list_chunks(_tables(m)["chunks"], found)
    counts = chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("chunks"))
    return (
        found.join(counts, "source_id", "left")
        .na.fill(0, ["chunks"])
        .select("source_id", "kb_id", "uri", "chunks")
    )


SUMMARY_SQL = f"""
with {CHUNKS_SQL},
counted as (
  select source_id, count(*) as n, arg_min(content, chunk_index) as head from chunk group by source_id)
"""


SUMMARY_TEXT = """'# doc/' || doc_id || '.txt' || chr(10) || chr(10) || 'Source type: file'
      || chr(10) || chr(10) || 'Chunks ingested: ' || coalesce(n, 0) || chr(10)
      || case when n is not null then chr(10) || '## Content Preview' || chr(10) || chr(10)
           || head[1:500] || '...' else '' end"""


@query(
    "source_summary",
    ["m_contents"],
    f"""{SUMMARY_SQL}
    select doc_id::varchar as source_id, source as kb_id, 'Source: doc/' || doc_id || '.txt' as title,
      {SUMMARY_TEXT} as content
    from documents left join counted on source_id = doc_id::varchar""",
)
def source_summary(m: Model) -> DataFrame:
    chunks = ingest.chunk_contents(m.contents(), SIZE, OVERLAP)
    pages = ingest.source_summaries(m.doc_sources(), chunks, _now())
    return pages.select("source_id", "kb_id", "title", "content")


def _errors(m: Model) -> DataFrame:
    """Sources that another table marks as bad count as failed to read."""
    return m.table("labels").filter("toxic = 1").select(
        F.col("doc_id").cast("string").alias("source_id"),
        F.concat(F.lit("cannot read "), F.col("doc_id").cast("string")).alias("error"),
    )


@query(
    "source_status",
    ["m_contents"],
    f"""{SUMMARY_SQL}
    select doc_id::varchar as source_id, source as kb_id,
      case when bad then 'failed' else 'ingested' end as status,
      case when bad then 0 else coalesce(n, 0) end::int as chunk_count,
      case when bad then null else strftime({START} + to_minutes({NOW}), '%Y-%m-%d %H:%M:%S') end as ingested_at
    from (select *, doc_id in (select doc_id from labels where toxic = 1) as bad from documents)
      left join counted on source_id = doc_id::varchar""",
)
def source_status(m: Model) -> DataFrame:
    chunks = ingest.chunk_contents(m.contents(), SIZE, OVERLAP)
    marked = ingest.mark_sources(m.doc_sources(), chunks, _errors(m), _now())
    ingested = F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested_at")
    return marked.select("source_id", "kb_id", "status", "chunk_count", ingested)


INGEST_SQL = f"""
{SUMMARY_SQL},
bad as (select distinct doc_id from labels where toxic = 1),
good as (select * from documents where doc_id not in (from bad))
select 'chunks' as table_name, kb_id, count(*) as n from chunk
where source_id not in (select doc_id::varchar from bad) group by kb_id
union all
select 'vectors', kb_id, count(*) from chunk
where source_id not in (select doc_id::varchar from bad) group by kb_id
union all
select 'pages', source, count(*) from good group by source
union all
select 'sources', source, count(*) from documents group by source
union all
select 'page_sources', '', count(*) from good
union all
select 'run_events', source, sum(case when doc_id in (from bad) then 4 else 12 end)
from documents group by source
"""


@query("ingest", ["m_contents"], INGEST_SQL)
def ingest_all(m: Model) -> DataFrame:
    added = ingest.ingest(
        m.kbs(), m.doc_sources(), m.contents(), _now(), _errors(m), SIZE, OVERLAP
    )
    return _counted({k: v for k, v in vars(added).items()})


#: What becomes of a document as a source: by its id, texts that are fetched, refused or not there
#: at all, and files that lie in a folder, are missing, or cannot be parsed or located.
ROLES = 11
ERRORS_SQL = f"""
with role as (
  select source_id, kb_id, source_id::bigint % {ROLES} as r,
    case when source_id::bigint % {ROLES} <= 2 then text
      when source_id::bigint % {ROLES} = 9
        then regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') || chr(10) end as text
  from m_contents),
{CHUNKS_SQL.replace('from m_contents', 'from role where text is not null')},
cut as (select source_id, count(*) as n, sum(length(content)) as chars from chunk group by source_id)
select source_id, kb_id, case when r between 3 and 8 then 'failed' else 'ingested' end as status,
  coalesce(n, 0)::int as chunk_count, coalesce(chars, 0)::bigint as chars,
  case r when 3 then 'status 404: http://docs/' || source_id
    when 4 then 'not fetched: http://docs/' || source_id
    when 5 then 'no such repository: repo/' || source_id
    when 6 then 'no such file: /no/such/folder/' || source_id || '.txt'
    when 7 then 'unsupported file type: /no/such/folder/' || source_id || '.pdf'
    when 8 then 'not a location: nowhere://docs/' || source_id || '.txt' end as error
from role left join cut using (source_id)
"""


@query("ingest_errors", ["m_contents"], ERRORS_SQL)
def ingest_errors(m: Model) -> DataFrame:
    """Every document as a source of some kind, read through the readers; many cannot be read."""
    spark = m.spark
    docs = m.documents().withColumn("role", F.pmod("doc_id", F.lit(ROLES)))
    folder = f"{scratch_folder(spark)}/{uuid.uuid4().hex}-files"
    lying = m.spread_documents().filter(F.pmod("doc_id", F.lit(ROLES)) == 9).select(
        F.concat(F.lit("doc_id="), F.col("doc_id").cast("string"), F.lit("/text.txt")).alias("path"),
        F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"),
    )
    export.write_markdown(lying, folder)
    name = F.col("doc_id").cast("string")
    role = F.col("role")
    responses = docs.filter("role <= 3").select(
        F.concat(F.lit("http://docs/"), name).alias("url"),
        F.when(role == 3, 404).otherwise(200).alias("status_code"),
        F.lit("text/plain").alias("content_type"),
        F.col("text").alias("body"),
    )
    uri = (
        F.when(role <= 4, F.concat(F.lit("http://docs/"), name))
        .when(role == 5, F.concat(F.lit("repo/"), name))
        .when(role == 6, F.concat(F.lit("/no/such/folder/"), name, F.lit(".txt")))
        .when(role == 7, F.concat(F.lit("/no/such/folder/"), name, F.lit(".pdf")))
        .when(role == 8, F.concat(F.lit("nowhere://docs/"), name, F.lit(".txt")))
        .when(role == 9, F.concat(F.lit(f"{folder}/doc_id="), name))
        .otherwise(F.concat(F.lit("/no/such/folder/"), name))
    )
    kind = (
        F.when(role <= 4, "api_endpoint").when(role == 5, "git_history")
        .when(role <= 8, "file").otherwise("directory")
    )
    kinds = docs.select(name.alias("source_id"), kind.alias("kind"), uri.alias("place"))
    sources = m.doc_sources().join(kinds, "source_id").withColumns(
        {"source_type": F.col("kind"), "uri": F.col("place")}
    ).drop("kind", "place")
    commits = spark.createDataFrame(
        [], "repo string, sha string, author string, email string, date timestamp, message string"
    )
    changes = spark.createDataFrame(
        [], "repo string, sha string, ord int, change_type string, a_path string, b_path string"
    )
    readers = {"api_endpoint": api_reader(responses), "git_history": commit_reader(commits, changes)}
    added = ingest.ingest_sources(m.kbs(), sources, _now(), readers, size=SIZE, overlap=OVERLAP)
    chars = added.chunks.groupBy("source_id").agg(F.sum(F.length("content")).alias("chars"))
    failed = added.run_events.filter("status = 'failed'").select("source_id", "error")
    return (
        added.sources.join(chars, "source_id", "left").join(failed, "source_id", "left")
        .select("source_id", "kb_id", "status", "chunk_count", F.coalesce("chars", F.lit(0)).alias("chars"), "error")
    )


@query(
    "sources_refresh",
    ["m_contents"],
    f"""with short as (select source_id, kb_id, 'again ' || kb_id as text from m_contents where kb_id = 'src4'),
    {CHUNKS_SQL.replace('from m_contents', "from m_contents where kb_id <> 'src4'")}
    select source_id, kb_id, chunk_index, content from chunk
    union all
    select source_id, kb_id, 0, text from short""",
)
def sources_refresh(m: Model) -> DataFrame:
    """Re-ingest the sources of one kb with new text; others keep their chunks."""
    contents = m.contents()
    sources = m.doc_sources()
    chunks = ingest.chunk_contents(contents, SIZE, OVERLAP)
    tables = {"kbs": m.kbs(), "sources": sources, "chunks": chunks}
    fresh = contents.withColumn("text", F.concat(F.lit("again "), "kb_id"))
    ids = lifecycle.list_sources(sources, "src4")
    after = ingest.refresh_sources(tables, ids, fresh, _now(), size=SIZE, overlap=OVERLAP)
    return after["chunks"].select("source_id", "kb_id", "chunk_index", "content")


@query(
    "run_status",
    ["m_run_events"],
    """select run_id, kb_id, phase, status,
         strftime(started, '%Y-%m-%d %H:%M:%S.%f') as started_at,
         case when status = 'completed' then strftime(ts, '%Y-%m-%d %H:%M:%S.%f') end as completed_at,
         case when status = 'failed' then error end as error
       from (select *, min(ts) over (partition by run_id) as started,
               row_number() over (partition by run_id order by ts desc, seq desc) as age
             from m_run_events) where age = 1""",
)
def run_status(m: Model) -> DataFrame:
    shown = [
        F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
        for c in ("started_at", "completed_at")
    ]
    return runs.run_status(m.run_events()).select(
        "run_id", "kb_id", "phase", "status", *shown, "error"
    )


#: Every event of a run with the accepted state before it (``p_``) and after it (``s_``).
WALK_SQL = """recursive ev as (
  select *, row_number() over (partition by run_id order by ts, seq) as rn from m_run_events),
walk as (
  select run_id, rn, seq, phase, status, pos = 0 and status = 'running' as accepted,
    null::int as p_pos, null::varchar as p_status,
    case when pos = 0 and status = 'running' then pos end::int as s_pos,
    case when pos = 0 and status = 'running' then status end as s_status
  from ev where rn = 1
  union all
  select run_id, rn, seq, phase, status, ok, s_pos, s_status, case when ok then pos else s_pos end::int,
    case when ok then status else s_status end
  from (
    select e.*, w.s_pos, w.s_status, coalesce(case
      when w.s_status is null then e.pos = 0 and e.status = 'running'
      when w.s_status = 'completed' then e.pos = w.s_pos + 1 and e.status = 'running'
      when w.s_status = 'running' then e.pos = w.s_pos and e.status in ('completed', 'failed')
      when w.s_status = 'failed' then e.pos = w.s_pos and e.status = 'running' end, false) as ok
    from walk w join ev e on e.run_id = w.run_id and e.rn = w.rn + 1))
"""
PHASES_SQL = "['initialize', 'read_source', 'chunk', 'embed', 'integrate_wiki', 'finalize']"


@query(
    "run_violations",
    ["m_run_events"],
    f"""with {WALK_SQL}
    select run_id, seq, phase, status, {PHASES_SQL}[p_pos + 1] as prev_phase, p_status as prev_status
    from walk where not accepted""",
)
def run_violations(m: Model) -> DataFrame:
    found = runs.invalid_transitions(m.run_events())
    return found.select("run_id", "seq", "phase", "status", "prev_phase", "prev_status")


@query(
    "export_names",
    ["m_pages"],
    """select page_id, 'doc-' || page_id || '-é-' || lower(page_type) || '.md' as name from m_pages""",
)
def export_names(m: Model) -> DataFrame:
    title = F.concat(F.lit("--"), "title", F.lit(": É/("), F.initcap("page_type"), F.lit(")__!"))
    return m.pages(wide=False).select("page_id", export.page_filename(title).alias("name"))


EXPORT_SQL = """
used as (
  select page_id, string_agg('  - ' || source_id, chr(10) order by source_id) as lines
  from m_page_sources group by page_id),
twice as (
  select *, title as shown, page_id as id from m_pages
  union all
  select *, upper(title) || '!', page_id || 'x' from m_pages where page_type = 'concept'),
plan as (
  select kb_id, id as page_id,
    kb_id || '/doc-' || page_id || case when id <> page_id then '--' || id else '' end || '.md' as path,
    page_type = 'concept' as collides,
    '---' || chr(10) || 'id: ' || id || chr(10) || 'title: ' || shown || chr(10)
    || 'page_type: ' || page_type || chr(10) || 'tags:' || chr(10) || '  - ' || tag || chr(10)
    || 'created_at: ' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' || chr(10)
    || 'updated_at: ' || strftime(updated_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' || chr(10)
    || 'sources:' || chr(10) || coalesce(case when id = page_id then lines end, '  []') || chr(10)
    || '---' || chr(10) || content || chr(10) as text,
    updated_at
  from twice left join used using (page_id))
"""


def _views(m: Model) -> tuple[DataFrame, DataFrame]:
    pages = m.pages()
    copies = (
        pages.filter("page_type = 'concept'")
        .withColumn("page_id", F.concat("page_id", F.lit("x")))
        .withColumn("title", F.concat(F.upper("title"), F.lit("!")))
    )
    both = pages.unionByName(copies)
    return both, wiki.page_view(both, m.links(), m.page_sources())


@query(
    "export_docs",
    ["m_pages", "m_page_sources"],
    f"with {EXPORT_SQL} select kb_id, page_id, path, collides, text from plan",
)
def export_docs(m: Model) -> DataFrame:
    return export.export_plan(_views(m)[1])


@query(
    "export_since",
    ["m_pages", "m_page_sources"],
    f"""with {EXPORT_SQL}
    select page_id, path, strftime(updated_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' as updated_at
    from plan where updated_at >= {START} + to_days(3)""",
)
def export_since(m: Model) -> DataFrame:
    pages, views = _views(m)
    since = minute(F.lit(3 * 1440))
    plan = export.export_plan(export.export_since(views, since), names=pages)
    when = pages.select("page_id", isoformat(F.col("updated_at")).alias("updated_at"))
    return plan.join(when, "page_id").select("page_id", "path", "updated_at")


@query(
    "ingest_stream",
    ["m_contents"],
    f"""with {CHUNKS_SQL}
    select sha256(source_id || ':0:' || chunk_index) as chunk_id, source_id, kb_id, chunk_index, content
    from chunk""",
)
def ingest_stream_query(m: Model) -> DataFrame:
    """The documents as arriving files; the stream stores what the batch form computes."""
    spark = m.spark
    folder, base = _arrived(m.contents())
    run = ingest_stream(
        stream_contents(spark, folder), f"{base}/chunks", f"{base}/log", size=SIZE, overlap=OVERLAP
    )
    run.awaitTermination()
    stored = latest_chunks(spark, f"{base}/chunks")
    return stored.select("chunk_id", "source_id", "kb_id", "chunk_index", "content")


@query(
    "ingest_stream_versions",
    ["m_contents"],
    f"""with {CHUNKS_SQL},
    change as (select source_id, kb_id, length(text) % 3 as kind from m_contents)
    select sha256(source_id || ':' || part || ':' || chunk_index) as chunk_id, source_id, part, chunk_index, content
    from chunk join change using (source_id), (select unnest([0, 1]) as part) where kind = 2
    union all
    select sha256(source_id || ':0:0'), source_id, 0, 0, 'replaced ' || source_id from change where kind = 0""",
)
def ingest_stream_versions(m: Model) -> DataFrame:
    """Three deliveries: all sources in two parts, a third of them anew in one part, a third emptied."""
    spark = m.spark
    contents = m.contents()
    kind = F.length("text") % 3
    version = lambda n: F.create_map(F.lit("ingest_version"), F.lit(n))
    again = contents.filter(kind == 0).withColumn("metadata", version("1"))
    again = again.withColumn("text", F.concat(F.lit("replaced "), "source_id"))
    gone = contents.filter(kind == 1).withColumn("metadata", version("2")).withColumn("text", F.lit(""))
    whole = contents.unionByName(contents.withColumn("part", F.lit(1)))
    base = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    for delivery in (whole, again, gone):
        delivery.write.mode("append").parquet(f"{base}-in")
        arriving = stream_contents(spark, f"{base}-in")
        ingest_stream(arriving, f"{base}-out/chunks", f"{base}-out/log", size=SIZE, overlap=OVERLAP).awaitTermination()
    return latest_chunks(spark, f"{base}-out/chunks").select("chunk_id", "source_id", "part", "chunk_index", "content")


def _arrived(df: DataFrame) -> tuple[str, str]:
    """A folder with the rows as files, and a fresh base folder for what a stream stores."""
    spark = df.sparkSession
    name = uuid.uuid4().hex
    folder = f"{scratch_folder(spark)}/{name}-in"
    df.write.parquet(folder)
    return folder, f"{scratch_folder(spark)}/{name}-out"


@query(
    "run_stream",
    ["m_run_events"],
    f"""with {WALK_SQL}
    select run_id, seq, phase, status, accepted, {PHASES_SQL}[s_pos + 1] as state_phase, s_status as state_status
    from walk""",
)
def run_stream(m: Model) -> DataFrame:
    """The run log as a stream: refused moves leave a run where it was."""
    spark = m.spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    folder, base = _arrived(m.run_events().withColumn("ts", F.col("ts").cast("timestamp")))
    run = store_run_states(stream_run_events(spark, folder), f"{base}/states", f"{base}/log")
    run.awaitTermination()
    return spark.read.parquet(f"{base}/states").drop("ts")
