"""Pages, links, index, lint and repair on small frames."""

import datetime

import pytest
from pyspark.sql import functions as F

from lorespark.operators import lint, wiki
from lorespark.schemas import LINKS, PAGE_SOURCES, PAGES, SOURCES

T0 = datetime.datetime(2024, 1, 1)


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def page(pid, title, content="body", kind="entity", kb="kb", minute=0, tags=()):
    at = T0 + datetime.timedelta(minutes=minute)
    return (pid, kb, title, content, kind, list(tags), at, at)


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), PAGES)


def links(spark, *rows):
    return spark.createDataFrame(list(rows), LINKS)


def used(spark, *rows):
    return spark.createDataFrame(list(rows), PAGE_SOURCES)


def sources(spark, *ids):
    return spark.createDataFrame(
        [(i, "kb", "file", f"/{i}.txt", {}, None, 0, "pending") for i in ids], SOURCES
    )


def ids(df):
    return sorted(r.page_id for r in df.collect())


def test_links_are_distinct_and_removable(spark):
    one = links(spark, ("a", "b"))
    both = wiki.add_links(one, links(spark, ("a", "b"), ("b", "a")))
    assert both.count() == 2
    assert wiki.remove_links(both, links(spark, ("a", "b"), ("x", "y"))).collect() == [("b", "a")]


def test_update_keeps_what_is_null_and_rejects_unknown(spark):
    p = pages(spark, page("a", "A", "old", tags=["t"]), page("b", "B"))
    patch = spark.createDataFrame([("a", None, "new", None)], "page_id string, title string, content string, tags array<string>")
    row = wiki.update_pages(p, patch, now()).filter("page_id = 'a'").first()
    assert (row.title, row.content, row.tags) == ("A", "new", ["t"])
    assert row.updated_at > row.created_at
    with pytest.raises(ValueError, match="page not found: zz"):
        wiki.update_pages(p, patch.withColumn("page_id", F.lit("zz")), now())


def test_delete_takes_links_of_both_directions(spark):
    p = pages(spark, page("a", "A"), page("b", "B"), page("c", "C"))
    out = wiki.delete_pages(
        {"pages": p, "links": links(spark, ("a", "b"), ("b", "c"), ("c", "a")), "page_sources": used(spark, ("a", "s"), ("b", "s"))},
        p.filter("page_id = 'b'"),
    )
    assert ids(out["pages"]) == ["a", "c"]
    assert out["links"].collect() == [("c", "a")]
    assert out["page_sources"].collect() == [("a", "s")]


def test_view_has_sorted_neighbours_and_empty_arrays(spark):
    p = pages(spark, page("a", "A"), page("b", "B"))
    rows = {r.page_id: r for r in wiki.page_view(p, links(spark, ("b", "a"), ("c", "a")), used(spark, ("a", "s2"), ("a", "s1"))).collect()}
    assert rows["a"].inbound == ["b", "c"] and rows["a"].source_ids == ["s1", "s2"]
    assert rows["b"].inbound == [] and rows["b"].outbound == ["a"]
    assert {r.part for r in rows.values()} == {0}


def test_view_of_a_hub_comes_in_bounded_parts(spark):
    p = pages(spark, page("hub", "Hub"), page("x", "X"))
    many = spark.range(1000).select(F.concat(F.lit("p"), "id").alias("from_page_id"), F.lit("hub").alias("to_page_id"))
    rows = wiki.page_view(p, many, used(spark), part_rows=100).filter("page_id = 'hub'").collect()
    assert len(rows) == 10 and max(len(r.inbound) for r in rows) < 200
    assert sorted(i for r in rows for i in r.inbound) == sorted(f"p{i}" for i in range(1000))


def test_linked_pages_directions(spark):
    p = pages(spark, page("a", "A"), page("b", "B"))
    edges = links(spark, ("a", "b"), ("a", "gone"))
    assert [r.title for r in wiki.linked_pages(p, edges).collect()] == ["B"]
    inbound = wiki.linked_pages(p, edges, "inbound")
    assert sorted((r.of_page_id, r.page_id) for r in inbound.collect()) == [("b", "a"), ("gone", "a")]
    with pytest.raises(ValueError, match="direction"):
        wiki.linked_pages(p, edges, "sideways")


def test_orphans_leave_out_index_pages(spark):
    p = pages(spark, page("l", "Linked"), page("o", "Orphan"), page("i", "Index", kind="index"))
    assert ids(wiki.orphan_pages(p, links(spark, ("o", "l")))) == ["o"]


def test_title_lookup_takes_the_first_created(spark):
    p = pages(spark, page("b", "T", minute=2), page("a", "T", minute=3), page("c", "T", kb="other"))
    wanted = spark.createDataFrame([("kb", "T"), ("kb", "none")], "kb_id string, title string")
    assert ids(wiki.pages_by_title(p, wanted)) == ["b"]


INDEX = "# Index\n\n## Entity\n\n- [[A]]\n- [[B]]\n\n## Concept\n\n- [[C]]\n"


def test_index_layout_and_identity(spark):
    p = pages(spark, page("2", "B"), page("1", "A"), page("3", "C", kind="concept"))
    row = wiki.build_index(p).first()
    assert row.content == INDEX and row.is_new and row.part == 0
    stored = wiki.write_index(p, now())
    again = wiki.build_index(stored).first()
    assert again.content == INDEX and again.page_id == row.page_id and not again.is_new
    assert wiki.write_index(stored, now()).filter("page_type = 'index'").count() == 1


def test_index_of_a_kb_with_only_an_index(spark):
    p = pages(spark, page("i", "Index", "x", "index"))
    row = wiki.build_index(p).first()
    assert (row.content, row.page_id) == ("# Index\n", "i")


def test_index_of_a_large_kb_comes_in_ordered_parts(spark):
    rows = [page(f"{i:03d}", f"T{i % 40:03d}", kind=("entity", "concept")[i % 2], kb="big") for i in range(90)]
    built = wiki.build_index(pages(spark, *rows, page("s", "Small", kb="small")), part_rows=25)
    parts = built.filter("kb_id = 'big'").orderBy("part").collect()
    assert [r.title for r in parts] == ["Index", "Index (2)", "Index (3)", "Index (4)"]
    lines = [x for r in parts for x in r.content.split("\n") if x.startswith("- ")]
    want = sorted((r[4] != "entity", r[2]) for r in rows)
    assert lines == [f"- [[{t}]]" for _, t in want]
    assert built.filter("kb_id = 'small'").first().content == "# Index\n\n## Entity\n\n- [[Small]]\n"


def messages(df):
    return sorted(r.message for r in df.collect())


def test_missing_pages_once_per_title(spark):
    p = pages(
        spark,
        page("1", "Page A", "[[Missing]] and [[Missing]], [[Page B]]", minute=1),
        page("0", "Page B", "again [[Missing]] [[bad [x] ]]", minute=2),
        page("9", "Missing", kb="other"),
    )
    rows = lint.lint_missing_pages(p).collect()
    assert [(r.page_id, r.target_title, r.auto_fixable) for r in rows] == [("1", "Missing", True)]
    assert rows[0].message == "Wikilink [[Missing]] points to a non-existent page."


def test_stale_and_uncovered_sources(spark):
    p = pages(spark, page("a", "A"))
    refs = used(spark, ("a", "s1"), ("a", "gone"))
    have = sources(spark, "s1", "s2")
    assert messages(lint.lint_stale_refs(p, refs, have)) == ["Page 'A' references deleted source 'gone'."]
    assert messages(lint.lint_coverage_gaps(p, refs, have)) == ["Source '/s2.txt' (s2) has no wiki pages."]


def test_index_drift_states(spark):
    first = page("1", "A")
    good = page("i", "Index", "# Index\n\n## Entity\n\n- [[A]]\n", "index")
    assert lint.lint_index_drift(pages(spark, first, good)).count() == 0
    drifted = lint.lint_index_drift(pages(spark, first, good, page("2", "B"))).collect()
    assert [(r.page_id, r.message) for r in drifted] == [("i", "Index page is out of sync with actual pages.")]
    absent = lint.lint_index_drift(pages(spark, first)).collect()
    assert [(r.page_id, r.message) for r in absent] == [(None, "No index page exists, but the KB has pages.")]
    assert lint.lint_index_drift(pages(spark, first).limit(0)).count() == 0


def test_repair_leaves_nothing_to_repair(spark):
    p = pages(spark, page("1", "A", "[[Missing]] [[B]]"), page("2", "B"), page("i", "Index", "old", "index"))
    edges, refs, have = links(spark, ("1", "2")), used(spark, ("1", "s1"), ("1", "gone")), sources(spark, "s1")
    fixed_pages, fixed_refs, fixed = lint.lint_fix(p, edges, refs, have, now())
    assert sorted(r.type for r in fixed.collect()) == ["index_drift", "missing_page", "stale_ref"]
    stub = fixed_pages.filter("title = 'Missing'").first()
    assert stub.content == "# Missing\n\n_Stub page — auto-generated by linter._\n"
    assert fixed_refs.collect() == [("1", "s1")]
    left = lint.lint_issues(fixed_pages, edges, fixed_refs, have)
    assert left.filter("auto_fixable").count() == 0
    only_stale = lint.lint_stale_refs(p, refs, have)
    same_pages, _, done = lint.lint_fix(p, edges, refs, have, now(), only_stale)
    assert same_pages.count() == 3 and done.count() == 1


def test_report_counts(spark):
    p = pages(spark, page("1", "A", "[[X]]"), page("2", "B"), page("i", "Index", "old", "index"))
    kbs = spark.createDataFrame([("kb",), ("empty",)], "kb_id string")
    report = lint.lint_report(p, links(spark, ("1", "2"), ("2", "1")), used(spark), sources(spark, "s"), now(), kbs)
    rows = {r.kb_id: r for r in report.collect()}
    assert (rows["kb"].page_count, rows["kb"].link_count, rows["kb"].issues) == (3, 2, 3)
    assert (rows["empty"].page_count, rows["empty"].issues) == (0, 0)


def test_add_pages_with_edges(spark):
    new = pages(spark, page("n", "N")).withColumn("source_ids", F.array(F.lit("s"))).withColumn("outbound_links", F.array(F.lit("a"), F.lit("a")))
    out, edges, refs = wiki.add_pages(pages(spark, page("a", "A")), links(spark), used(spark), new)
    assert ids(out) == ["a", "n"] and edges.collect() == [("n", "a")] and refs.collect() == [("n", "s")]
