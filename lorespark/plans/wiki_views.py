"""SQL of the views that build on the wiki pages: stored index, wikilinks, issues."""

from __future__ import annotations

START = "timestamp '2024-01-01 00:00:00'"
SECTIONS = ["entity", "concept", "summary", "comparison", "synthesis"]


def index_sql(pages: str) -> str:
    """``(kb_id, content)`` of the generated index over a pages relation."""
    return f"""
        select kb_id, '# Index' || chr(10) || string_agg(
            chr(10) || '## ' || upper(page_type[1]) || page_type[2:] || chr(10) || chr(10) || lines,
            '' order by list_position({SECTIONS}, page_type)) as content
        from (select kb_id, page_type,
                string_agg('- [[' || title || ']]' || chr(10), '' order by title) as lines
              from {pages} where page_type <> 'index' group by kb_id, page_type)
        group by kb_id"""


WIKI_VIEWS = {
    "m_index": index_sql(
        """(select * from m_pages where kb_id[4:]::int % 7 <> 3
            and (kb_id[4:]::int % 2 = 0 or page_id::bigint % 50 <> 0))"""
    ),
    "m_wiki": f"""
        select page_id, kb_id, title, content, page_type, tag, created_at, updated_at from m_pages
        union all
        select 'index-' || kb_id, kb_id, 'Index', content, 'index', null, {START}, {START}
        from m_index""",
    "m_wikilinks": r"""
        select kb_id, page_id, created_at,
          unnest(regexp_extract_all(content, '\[\[([^\[\]]+)\]\]', 1)) as title
        from m_wiki""",
    "m_missing": """
        select kb_id, title, arg_min(page_id, (created_at, page_id)) as page_id
        from m_wikilinks l
        where not exists (select 1 from m_wiki p where p.kb_id = l.kb_id and p.title = l.title)
        group by kb_id, title""",
    "m_stale": """
        select p.kb_id, p.page_id, p.title, r.source_id
        from m_page_sources r join m_wiki p using (page_id)
        where r.source_id not in (select source_id from m_sources)""",
    "m_drift": f"""
        select g.kb_id,
          case when s.content is null then null else 'index-' || g.kb_id end as page_id,
          case when s.content is null then 'No index page exists, but the KB has pages.'
            else 'Index page is out of sync with actual pages.' end as message
        from ({index_sql('m_pages')}) g left join m_index s using (kb_id)
        where s.content is distinct from g.content""",
    "m_issues": """
        select kb_id, 'orphan_page' as type, page_id,
          'Page ''' || title || ''' has no inbound links.' as message, false as auto_fixable
        from m_pages where page_id not in (select to_page_id from m_links)
        union all
        select kb_id, 'missing_page', page_id,
          'Wikilink [[' || title || ']] points to a non-existent page.', true from m_missing
        union all
        select kb_id, 'stale_ref', page_id,
          'Page ''' || title || ''' references deleted source ''' || source_id || '''.', true
        from m_stale
        union all
        select kb_id, 'coverage_gap', null,
          'Source ''' || uri || ''' (' || source_id || ') has no wiki pages.', false
        from m_sources s where not exists (
          select 1 from m_page_sources r join m_wiki p using (page_id)
          where r.source_id = s.source_id and p.kb_id = s.kb_id)
        union all
        select kb_id, 'index_drift', page_id, message, true from m_drift""",
}

_WIKI = ["m_pages", "m_index", "m_wiki"]
WIKI_NEEDS = {
    "m_index": ["m_pages"],
    "m_wiki": ["m_pages", "m_index"],
    "m_wikilinks": _WIKI,
    "m_missing": [*_WIKI, "m_wikilinks"],
    "m_stale": [*_WIKI, "m_page_sources", "m_sources"],
    "m_drift": _WIKI,
    "m_issues": [
        *_WIKI,
        "m_wikilinks",
        "m_missing",
        "m_links",
        "m_page_sources",
        "m_sources",
        "m_stale",
        "m_drift",
    ],
}
