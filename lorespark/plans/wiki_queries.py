"""Queries over pages, links, lint and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.operators import lint, wiki
from lorespark.plans.fixtures import Model, minute
from lorespark.plans.registry import query
from lorespark.plans.wiki_views import START, index_sql

NOW = 525_600  # minutes after the start of the fixture clock


def _now() -> Column:
    return minute(F.lit(NOW))


def _text(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias(ts)


@query(
    "page_view",
    ["m_wiki", "m_links", "m_page_sources"],
    """select page_id, kb_id, title, 0 as part,
         coalesce((select string_agg(source_id, ',' order by source_id) from m_page_sources s
                   where s.page_id = p.page_id), '') as source_ids,
         coalesce(i.ids, '') as inbound, coalesce(o.ids, '') as outbound
       from m_wiki p
       left join (select to_page_id, string_agg(from_page_id, ',' order by from_page_id) as ids
                  from m_links group by 1) i on i.to_page_id = p.page_id
       left join (select from_page_id, string_agg(to_page_id, ',' order by to_page_id) as ids
                  from m_links group by 1) o on o.from_page_id = p.page_id""",
)
def page_view(m: Model) -> DataFrame:
    view = wiki.page_view(m.indexed_pages(), m.links(), m.page_sources())
    arrays = [F.array_join(c, ",").alias(c) for c in ("source_ids", "inbound", "outbound")]
    return view.select("page_id", "kb_id", "title", "part", *arrays)


@query(
    "page_add",
    ["m_pages", "m_links", "m_page_sources"],
    """select 'page' as kind, page_id as a, kb_id as b from m_pages
       union all select 'page', 'new-' || page_id, kb_id from m_pages where page_type = 'concept'
       union all select 'link', from_page_id, to_page_id from m_links
       union all select 'link', 'new-' || page_id, page_id from m_pages where page_type = 'concept'
       union all select 'source', page_id, source_id from m_page_sources
       union all select 'source', 'new-' || page_id, 's1' from m_pages where page_type = 'concept'""",
)
def page_add(m: Model) -> DataFrame:
    pages = m.pages()
    new = (
        pages.filter("page_type = 'concept'")
        .withColumn("outbound_links", F.array("page_id", "page_id"))
        .withColumn("source_ids", F.array(F.lit("s1"), F.lit("s1")))
        .withColumn("page_id", F.concat(F.lit("new-"), "page_id"))
    )
    added, links, used = wiki.add_pages(pages, m.links(), m.page_sources(), new)
    return (
        added.select(F.lit("page").alias("kind"), F.col("page_id").alias("a"), F.col("kb_id").alias("b"))
        .union(links.select(F.lit("link"), "from_page_id", "to_page_id"))
        .union(used.select(F.lit("source"), "page_id", "source_id"))
    )


@query(
    "page_update",
    ["m_pages"],
    f"""select page_id, kb_id,
         case when page_id::bigint % 4 = 0 then 'New ' || title else title end as title,
         case when page_id::bigint % 4 = 2 then 'short' else content end as content,
         case when page_id::bigint % 4 = 0 then 'x,y' else tag end as tags,
         strftime(case when page_id::bigint % 2 = 0 then {START} + to_minutes({NOW})
           else updated_at end, '%Y-%m-%d %H:%M:%S') as updated_at
       from m_pages""",
)
def page_update(m: Model) -> DataFrame:
    n = F.col("page_id").cast("long")
    pages = m.pages()
    patches = pages.filter(n % 2 == 0).select(
        "page_id",
        F.when(n % 4 == 0, F.concat(F.lit("New "), "title")).alias("title"),
        F.when(n % 4 == 2, F.lit("short")).alias("content"),
        F.when(n % 4 == 0, F.array(F.lit("x"), F.lit("y"))).alias("tags"),
    )
    out = wiki.update_pages(pages, patches, _now())
    return out.select(
        "page_id", "kb_id", "title", "content", F.array_join("tags", ",").alias("tags"),
        _text("updated_at"),
    )


@query(
    "page_delete",
    ["m_pages", "m_links", "m_page_sources"],
    """with gone as (select page_id from m_pages where page_type = 'summary')
       select 'page' as kind, page_id as a, kb_id as b from m_pages
       where page_id not in (from gone)
       union all select 'link', from_page_id, to_page_id from m_links
       where from_page_id not in (from gone) and to_page_id not in (from gone)
       union all select 'source', page_id, source_id from m_page_sources
       where page_id not in (from gone)""",
)
def page_delete(m: Model) -> DataFrame:
    pages = m.pages()
    tables = {"pages": pages, "links": m.links(), "page_sources": m.page_sources()}
    out = wiki.delete_pages(tables, wiki.list_pages(pages, page_type="summary"))
    return (
        out["pages"]
        .select(F.lit("page").alias("kind"), F.col("page_id").alias("a"), F.col("kb_id").alias("b"))
        .union(out["links"].select(F.lit("link"), "from_page_id", "to_page_id"))
        .union(out["page_sources"].select(F.lit("source"), "page_id", "source_id"))
    )


@query(
    "pages_by_type",
    ["m_pages"],
    "select page_id, title from m_pages where kb_id = 'src3' and page_type = 'comparison'",
)
def pages_by_type(m: Model) -> DataFrame:
    return wiki.list_pages(m.pages(wide=False), "src3", "comparison").select("page_id", "title")


@query(
    "pages_by_title",
    ["m_pages"],
    """select p.kb_id, p.title, arg_min(p.page_id, (p.created_at, p.page_id)) as page_id
       from (select *, title as t from m_pages
             union all select * replace (page_id || 'x' as page_id), title from m_pages) p
       join (select distinct 'src' || (conv_id % 20) as kb_id, 'Doc ' || conv_id as title
             from conversations) w
         on p.kb_id = w.kb_id and p.title = w.title
       group by p.kb_id, p.title""",
)
def pages_by_title(m: Model) -> DataFrame:
    """Each title exists twice; the first created is found."""
    pages = m.pages()
    twice = pages.unionByName(pages.withColumn("page_id", F.concat("page_id", F.lit("x"))))
    n = F.col("conv_id")
    titles = m.table("conversations").select(
        F.concat(F.lit("src"), (n % 20).cast("string")).alias("kb_id"),
        F.concat(F.lit("Doc "), n.cast("string")).alias("title"),
    )
    return wiki.pages_by_title(twice, titles).select("kb_id", "title", "page_id")


@query(
    "links_out",
    ["m_pages", "m_links"],
    """select from_page_id as of_page_id, page_id, title from m_links join m_pages on page_id = to_page_id""",
)
def links_out(m: Model) -> DataFrame:
    found = wiki.linked_pages(m.pages(wide=False), m.links(), "outbound")
    return found.select("of_page_id", "page_id", "title")


@query(
    "links_in",
    ["m_pages", "m_links"],
    """select to_page_id as of_page_id, page_id, title from m_links join m_pages on page_id = from_page_id""",
)
def links_in(m: Model) -> DataFrame:
    found = wiki.linked_pages(m.pages(wide=False), m.links(), "inbound")
    return found.select("of_page_id", "page_id", "title")


@query(
    "links_edit",
    ["m_links"],
    """select from_page_id, to_page_id from m_links where to_page_id::bigint % 2 = 0
       union
       select to_page_id, from_page_id from m_links
       where not (from_page_id::bigint % 2 <> 0
         and exists (select 1 from m_links l where l.from_page_id = m_links.to_page_id
                     and l.to_page_id = m_links.from_page_id))""",
)
def links_edit(m: Model) -> DataFrame:
    """Add the reverse of every link, twice, then remove links that led to odd pages."""
    links = m.links()
    back = links.select(
        F.col("to_page_id").alias("from_page_id"), F.col("from_page_id").alias("to_page_id")
    )
    odd = links.filter(F.col("to_page_id").cast("long") % 2 != 0)
    return wiki.remove_links(wiki.add_links(links, back.union(back)), odd)


@query(
    "page_sources_edit",
    ["m_pages", "m_page_sources"],
    """select page_id, source_id from m_page_sources where page_id in (
         select page_id from m_pages where page_type <> 'entity')
       union
       select page_id, 'extra' from m_pages where page_type = 'concept'""",
)
def page_sources_edit(m: Model) -> DataFrame:
    pages, used = m.pages(wide=False), m.page_sources()
    concepts = wiki.list_pages(pages, page_type="concept")
    more = concepts.select("page_id", F.lit("extra").alias("source_id"))
    gone = wiki.page_sources_of(used, wiki.list_pages(pages, page_type="entity"))
    return wiki.remove_page_sources(wiki.add_page_sources(used, more.union(more)), gone)


@query(
    "orphans",
    ["m_wiki", "m_links"],
    """select page_id, kb_id, title from m_wiki
       where page_type <> 'index' and page_id not in (select to_page_id from m_links)""",
)
def orphans(m: Model) -> DataFrame:
    return wiki.orphan_pages(m.indexed_pages(), m.links()).select("page_id", "kb_id", "title")


@query("wikilinks", ["m_wikilinks"], "select kb_id, page_id, title from m_wikilinks")
def wikilinks(m: Model) -> DataFrame:
    return wiki.extract_wikilinks(m.indexed_pages()).select("kb_id", "page_id", "title")


@query(
    "index_page",
    ["m_index"],
    f"""select g.kb_id, 0 as part, 'Index' as title, g.content,
         case when s.content is null then 'new' else 'index-' || g.kb_id end as page_id
       from ({index_sql('m_pages')}) g left join m_index s using (kb_id)""",
)
def index_page(m: Model) -> DataFrame:
    built = wiki.build_index(m.indexed_pages())
    page_id = F.when(F.col("is_new"), F.lit("new")).otherwise(F.col("page_id")).alias("page_id")
    return built.select("kb_id", "part", "title", "content", page_id)


@query(
    "index_page_parts",
    ["m_pages"],
    """select kb_id, part, string_agg('- [[' || title || ']]', chr(10) order by pos) as lines
       from (select kb_id, title, pos, ((pos - 1) // 7)::int as part
             from (select kb_id, title, row_number() over (partition by kb_id
                     order by list_position(['entity', 'concept', 'summary', 'comparison', 'synthesis'],
                       page_type), title, page_id) as pos from m_pages))
       group by kb_id, part""",
)
def index_page_parts(m: Model) -> DataFrame:
    """The way taken for a kb whose index does not fit one page."""
    built = wiki.build_index(m.pages(), part_rows=7)
    lines = F.regexp_extract_all("content", F.lit(r"- \[\[[^\]]+\]\]"), F.lit(0))
    return built.select("kb_id", "part", F.array_join(lines, "\n").alias("lines"))


ISSUE_SQL = "select kb_id, type, page_id, message, auto_fixable from m_issues where type = '{}'"


def _shown(issues: DataFrame) -> DataFrame:
    return issues.select("kb_id", "type", "page_id", "message", "auto_fixable")


@query("lint_orphan", ["m_issues"], ISSUE_SQL.format("orphan_page"))
def lint_orphan(m: Model) -> DataFrame:
    return _shown(lint.lint_orphans(m.indexed_pages(), m.links()))


@query("lint_missing", ["m_issues"], ISSUE_SQL.format("missing_page"))
def lint_missing(m: Model) -> DataFrame:
    return _shown(lint.lint_missing_pages(m.indexed_pages()))


@query("lint_stale", ["m_issues"], ISSUE_SQL.format("stale_ref"))
def lint_stale(m: Model) -> DataFrame:
    return _shown(lint.lint_stale_refs(m.indexed_pages(), m.page_sources(), m.sources()))


@query("lint_coverage", ["m_issues"], ISSUE_SQL.format("coverage_gap"))
def lint_coverage(m: Model) -> DataFrame:
    return _shown(lint.lint_coverage_gaps(m.indexed_pages(), m.page_sources(), m.sources()))


@query("lint_drift", ["m_issues"], ISSUE_SQL.format("index_drift"))
def lint_drift(m: Model) -> DataFrame:
    return _shown(lint.lint_index_drift(m.indexed_pages()))


@query(
    "lint_report",
    ["m_issues"],
    """select k.kb_id, page_count, coalesce(link_count, 0) as link_count,
         coalesce(issues, 0) as issues, coalesce(orphan_pages, 0) as orphan_pages,
         coalesce(missing_pages, 0) as missing_pages, coalesce(stale_refs, 0) as stale_refs,
         coalesce(coverage_gaps, 0) as coverage_gaps, coalesce(index_drifts, 0) as index_drifts,
         coalesce(fixable, 0) as fixable
       from (select kb_id, count(*) as page_count from m_wiki group by kb_id) k
       left join (select kb_id, count(*) as link_count
                  from m_links join m_wiki on page_id = from_page_id group by kb_id) l using (kb_id)
       left join (select kb_id, count(*) as issues,
                    count(*) filter (where type = 'orphan_page') as orphan_pages,
                    count(*) filter (where type = 'missing_page') as missing_pages,
                    count(*) filter (where type = 'stale_ref') as stale_refs,
                    count(*) filter (where type = 'coverage_gap') as coverage_gaps,
                    count(*) filter (where type = 'index_drift') as index_drifts,
                    count(*) filter (where auto_fixable) as fixable
                  from m_issues group by kb_id) i using (kb_id)""",
)
def lint_report(m: Model) -> DataFrame:
    report = lint.lint_report(
        m.indexed_pages(), m.links(), m.page_sources(), m.sources(), _now()
    )
    return report.drop("checked_at")


@query(
    "fix_missing",
    ["m_missing"],
    """select kb_id, title, page_type, content from m_wiki
       union all
       select kb_id, title, 'entity',
         '# ' || title || chr(10) || chr(10) || '_Stub page — auto-generated by linter._' || chr(10)
       from m_missing""",
)
def fix_missing(m: Model) -> DataFrame:
    pages = m.indexed_pages()
    fixed = lint.fix_missing_pages(pages, lint.lint_missing_pages(pages), _now())
    return fixed.select("kb_id", "title", "page_type", "content")


@query(
    "fix_stale",
    ["m_page_sources", "m_sources"],
    """select page_id, source_id from m_page_sources
       where source_id in (select source_id from m_sources)""",
)
def fix_stale(m: Model) -> DataFrame:
    used = m.page_sources()
    issues = lint.lint_stale_refs(m.pages(wide=False), used, m.sources())
    return lint.fix_stale_refs(used, issues)


@query(
    "lint_fixed",
    ["m_issues"],
    f"""with touched as (select distinct kb_id from m_issues where type in ('index_drift', 'missing_page')),
    repaired as (
      select kb_id, title, page_type from m_pages
      union all select kb_id, title, 'entity' from m_missing),
    fresh as ({index_sql('repaired')})
    select kb_id, title, page_type, null as content from repaired
    union all
    select kb_id, 'Index', 'index', content from fresh where kb_id in (from touched)
    union all
    select kb_id, 'Index', 'index', content from m_index where kb_id not in (from touched)""",
)
def lint_fixed(m: Model) -> DataFrame:
    pages, links, used, sources = m.indexed_pages(), m.links(), m.page_sources(), m.sources()
    fixed, _, _ = lint.lint_fix(pages, links, used, sources, _now())
    shown = F.when(F.col("page_type") == "index", F.col("content")).alias("content")
    return fixed.select("kb_id", "title", "page_type", shown)
