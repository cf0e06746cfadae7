"""Queries over sources, chunking and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import any_glob
from lorespark.operators.chunking import (
    CLASS_START,
    FUNCTION_START,
    symbol_chunk,
    tag_language,
    token_chunk,
)
from lorespark.operators.ingest import chunk_contents
from lorespark.plans.fixtures import IGNORE, Model
from lorespark.plans.registry import query, sql_tokens
from lorespark.sources.commits import commit_documents
from lorespark.sources.files import EXCLUDED_DIRS, filter_paths
from lorespark.sources.html import ENTITIES, RULES, TITLE, TITLE_RULES, extract_pages
from lorespark.sources.jsontext import normalize_json
from lorespark.sources.metadata import merge_metadata
from lorespark.sources.responses import response_documents

SIZE, OVERLAP = 128, 16
STEP = SIZE - OVERLAP

CHUNKS_SQL = f"""
tok as (select source_id, kb_id, {sql_tokens('text')} as t from m_contents),
win as (select source_id, kb_id, t, unnest(range(0, len(t), {STEP})) as s from tok),
chunk as (
  select source_id, kb_id, (s // {STEP})::int as chunk_index,
         array_to_string(t[s + 1 : s + {SIZE}], '') as content
  from win)
"""


@query(
    "token_chunks",
    ["m_contents"],
    f"""with {CHUNKS_SQL}
    select sha256(source_id || ':0:' || chunk_index) as chunk_id, source_id, kb_id, chunk_index, content
    from chunk""",
)
def token_chunks(m: Model) -> DataFrame:
    chunks = chunk_contents(m.contents(), SIZE, OVERLAP)
    return chunks.select("chunk_id", "source_id", "kb_id", "chunk_index", "content")


@query(
    "chunk_stats",
    ["m_contents"],
    f"""with {CHUNKS_SQL}
    select kb_id, count(*) as chunks, count(distinct source_id) as sources,
           sum(length(content))::bigint as chars, max(chunk_index) as last_index
    from chunk group by kb_id""",
)
def chunk_stats(m: Model) -> DataFrame:
    return (
        token_chunk(m.contents(), SIZE, OVERLAP)
        .groupBy("kb_id")
        .agg(
            F.count(F.lit(1)).alias("chunks"),
            F.countDistinct("source_id").alias("sources"),
            F.sum(F.length("content")).alias("chars"),
            F.max("chunk_index").alias("last_index"),
        )
    )


CODE_SQL = """
code as (
  select doc_id::varchar as source_id, doc_id % 4 as kind,
    case when doc_id % 4 = 0 then
      'import os' || chr(10) || chr(10) || 'class C' || doc_id || ':' || chr(10) || '    pass'
      || chr(10) || chr(10) || 'def f' || doc_id || '():' || chr(10) || '    x = ''''''' || text
      || '''''''' || chr(10) || '    return 1' || chr(10)
    else
      '// ' || doc_id || chr(10) || 'class C' || doc_id || ' {}' || chr(10) || chr(10)
      || 'export async function f' || doc_id || '() {' || chr(10) || '/*' || chr(10) || text
      || chr(10) || '*/' || chr(10) || '}' || chr(10) || 'export class E' || doc_id || ' {}' || chr(10)
    end as text
  from documents)
"""


def _starts(kind: str, language: str) -> str:
    cls, fun = CLASS_START[language], FUNCTION_START[language]
    return {"class": cls, "function": fun, "any": f"{cls}|{fun}"}[kind]


def _by_kind(template: str) -> str:
    """A ``case`` over the three languages with symbol rules."""
    names = ["python", "javascript", "typescript"]
    whens = " ".join(
        "when {} then {}".format(
            i,
            template.replace("$ANY", _starts("any", n).replace("([", "(?:["))
            .replace("$CLASS", _starts("class", n))
            .replace("$FUNCTION", _starts("function", n)),
        )
        for i, n in enumerate(names)
    )
    return f"case kind {whens} end"


SYMBOL_SQL = f"""
with {CODE_SQL},
marked as (
  select source_id, kind, text,
    {_by_kind("regexp_replace(text, '(?m)^($ANY)', chr(1) || '\\1', 'g')")} as marks from code),
blocks as (
  select source_id, kind, block_no, blocks[block_no] as block
  from (select source_id, kind, string_split(marks, chr(1)) as blocks from marked where kind < 3)
       t, unnest(range(1, len(blocks) + 1)) u(block_no)),
named as (
  select source_id, kind, block_no, block,
    {_by_kind("regexp_matches(block, '^(?:$CLASS)')")} as is_class,
    {_by_kind("regexp_matches(block, '^(?:$FUNCTION)')")} as is_function,
    {_by_kind("regexp_extract(block, '^(?:$CLASS)', 1)")} as class_name,
    {_by_kind("regexp_extract(block, '^(?:$FUNCTION)', 1)")} as function_name
  from blocks where regexp_matches(block, '\\S')),
parts as (
  select source_id, block_no,
    case when is_class then 'class' when is_function then 'function' else 'module' end as symbol_type,
    case when is_class then class_name when is_function then function_name end as symbol_name,
    {sql_tokens('block')} as t, true as whole_fits from named
  union all
  select source_id, 1, null, null, {sql_tokens('text')}, false from code where kind = 3),
cut as (
  select source_id, block_no, symbol_type, symbol_name, 0 as s, array_to_string(t, '') as content
  from parts where whole_fits and len(t) <= {SIZE}
  union all
  select source_id, block_no, symbol_type, symbol_name, s, array_to_string(t[s + 1 : s + {SIZE}], '')
  from (select *, unnest(range(0, len(t), {STEP})) as s from parts
        where not whole_fits or len(t) > {SIZE}))
select source_id,
  (row_number() over (partition by source_id order by block_no, s) - 1)::int as chunk_index,
  symbol_type, symbol_name, content
from cut
"""


@query("symbol_chunks", [], SYMBOL_SQL)
def symbol_chunks(m: Model) -> DataFrame:
    chunks = symbol_chunk(tag_language(m.code()), SIZE, OVERLAP)
    return chunks.select("source_id", "chunk_index", "symbol_type", "symbol_name", "content")


@query(
    "language_tags",
    [],
    """select doc_id::varchar as source_id,
         ['python', 'javascript', 'typescript', 'unknown'][(doc_id % 4)::int + 1] as language
       from documents""",
)
def language_tags(m: Model) -> DataFrame:
    tagged = tag_language(m.code().drop("text"))
    return tagged.select("source_id", F.col("metadata")["language"].alias("language"))


def _quoted(text: str) -> str:
    return "chr(10)" if text == "\n" else "'" + text.replace("'", "''") + "'"


def _replaced(column: str, rules: list[tuple[str, str]]) -> str:
    for pattern, new in rules:
        if (pattern, new) in ENTITIES:
            column = f"replace({column}, {_quoted(pattern)}, {_quoted(new)})"
        else:
            column = f"regexp_replace({column}, {_quoted(pattern)}, {_quoted(new)}, 'g')"
    return column


@query(
    "page_text",
    [],
    f"""select * from (
      select page_id, url,
        {_replaced(f"regexp_extract(html, '{TITLE}', 1)",
                   TITLE_RULES)} as title,
        {_replaced("html", RULES)} as text
      from pages) where length(text) > 0""",
)
def page_text(m: Model) -> DataFrame:
    return extract_pages(m.spread_pages()).select("page_id", "url", "title", "text")


@query(
    "path_filter",
    [],
    f"""with raw as (
      select page_id::varchar as source_id,
        ['', '.hidden/', 'build/', 'node_modules/', 'docs/', 't1mp/'][(page_id % 6)::int + 1]
        || regexp_replace(regexp_extract(url, '^https?://([^?#]*)', 1), '/+$', '')
        || '/' || ['a.txt', 'b.log', 'x.md', '.env'][((page_id // 6) % 4)::int + 1] as rel_path
      from pages),
    seg as (select *, string_split(rel_path, '/') as s from raw),
    pre as (select *, list_transform(range(1, len(s) + 1), lambda i: array_to_string(s[1:i], '/')) as p
            from seg)
    select source_id, rel_path from pre
    where len(list_filter(s, lambda x: starts_with(x, '.'))) = 0
      and not list_has_any(s[1:len(s) - 1], [{', '.join(f"'{d}'" for d in EXCLUDED_DIRS)}])
      and len(list_filter(list_concat(p, s), lambda x: regexp_matches(x, '{any_glob(IGNORE)}'))) = 0""",
)
def path_filter(m: Model) -> DataFrame:
    return filter_paths(m.paths(), IGNORE)


@query(
    "commit_docs",
    [],
    """with c as (
      select role as repo, conv_id || '-' || turn as sha, conv_id, turn, role, text,
        timestamp '2024-01-01 00:00:00' + to_minutes(conv_id) + to_seconds(turn) as date
      from conversations),
    newest as (
      select * from (select *, row_number() over (partition by repo order by date desc, sha) as age from c)
      where age <= 100),
    lines as (
      select repo, sha, string_agg(line, chr(10) order by l_linenumber, line) as listing
      from (select n.repo, n.sha, l_linenumber,
              case l_returnflag when 'A' then '  + part/' || l_partkey
                when 'N' then '  M part/' || l_partkey
                else '  R supp/' || l_suppkey || ' -> part/' || l_partkey end as line
            from newest n join lineitem on l_orderkey = n.conv_id where n.turn > 0)
      group by repo, sha)
    select n.repo, n.sha, 0 as part,
      'Commit: ' || n.sha || chr(10)
      || 'Author: ' || upper(role[1]) || role[2:] || ' <' || role || '@example.com>' || chr(10)
      || 'Date: ' || strftime(date, '%Y-%m-%dT%H:%M:%S') || '+00:00' || chr(10)
      || 'Message: ' || regexp_replace(text, '^\\s+|\\s+$', '', 'g')
      || coalesce(chr(10) || chr(10) || 'Changed files:' || chr(10) || listing, '') as text
    from newest n left join lines l on l.repo = n.repo and l.sha = n.sha""",
)
def commit_docs(m: Model) -> DataFrame:
    return commit_documents(m.commits(), m.changes()).select("repo", "sha", "part", "text")


@query(
    "json_text",
    [],
    """select event_id,
         regexp_replace(props, '^\\{"k": ([0-9]+)\\}$', '{' || chr(10) || '  "k": \\1' || chr(10) || '}') as text
       from events""",
)
def json_text(m: Model) -> DataFrame:
    return normalize_json(m.table("events").select("event_id", F.col("props").alias("text")))


@query(
    "response_docs",
    [],
    """select 'http://api.example.com/' || doc_id as url, 200 as status_code,
         case when doc_id % 3 = 0 then 'application/json' else 'text/plain' end as content_type,
         case when doc_id % 3 = 0 then
           '{' || chr(10) || '  "id": ' || doc_id || ',' || chr(10) || '  "lang": [' || chr(10)
           || '    "' || lang || '"' || chr(10) || '  ]' || chr(10) || '}'
         else text end as text
       from documents
       where doc_id % 5 <> 4 and doc_id % 7 <> 3 and (doc_id % 3 = 0 or length(text) > 0)""",
)
def response_docs(m: Model) -> DataFrame:
    return response_documents(m.responses())[0]


@query(
    "metadata_merge",
    [],
    """select doc_id, 'lang=' || (case when doc_id % 2 = 0 then 'user' else lang end)
         || case when doc_id % 2 = 0 then ',shelf=' || source else '' end
         || ',type=.txt' as metadata
       from documents""",
)
def metadata_merge(m: Model) -> DataFrame:
    extracted = F.create_map(F.lit("lang"), F.col("lang"), F.lit("type"), F.lit(".txt"))
    user = F.when(
        F.col("doc_id") % 2 == 0,
        F.create_map(F.lit("lang"), F.lit("user"), F.lit("shelf"), F.col("source")),
    )
    merged = F.map_entries(merge_metadata(extracted, user))
    shown = F.transform(merged, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return m.documents().select(
        "doc_id", F.array_join(F.array_sort(shown), ",").alias("metadata")
    )
