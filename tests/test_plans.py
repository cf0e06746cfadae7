"""Physical plans: what must and must not be in them."""

import os
import re

import pytest
from compare import plan

import __spark_entry__ as entry
from lorespark.operators.embedding import embed
from lorespark.operators.ingest import chunk_contents
from lorespark.operators.keyword import (
    POSITION_FORMAT,
    bm25,
    build_positions,
    build_postings,
    doc_stats,
    keyword_search,
    match_phrases,
    query_terms,
    term_counts,
    term_hits,
)
from lorespark.operators.search import semantic_search
from lorespark.operators.vectors import vector_topk, where_equals
from lorespark.plans.fixtures import Model
from lorespark.session import durable

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")


@pytest.mark.parametrize("name", ["token_chunks", "symbol_chunks", "hash_embeddings", "postings"])
def test_text_work_stays_in_the_jvm_without_shuffle(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "Python" not in text and "Arrow" not in text
    # the only exchange spreads the single-file input over the cores
    assert text.count("Exchange") == text.count("REPARTITION_BY_NUM") <= 1


def test_top_k_is_limited_before_the_shuffle(spark):
    m = Model(spark, FOLDER)
    text = plan(vector_topk(m.vectors(), m.vector_queries(), 3))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange") == 1


def test_columns_are_pruned_and_filters_pushed(spark):
    m = Model(spark, FOLDER)
    text = plan(where_equals(m.table("embeddings"), {"label": 3}).select("vec_id"))
    assert "EqualTo(label,3)" in text and "embedding:" not in text
    text = plan(entry.queries()["links_out"](spark, FOLDER))
    assert "text:string" not in text.replace("text:string,lang", "")


def test_heavy_text_expression_is_not_run_twice(spark):
    m = Model(spark, FOLDER)
    for df in (build_postings(m.pages()), embed(m.contents(), "text").select("embedding")):
        assert plan(df).count("regexp_extract_all") == 1
    assert plan(entry.queries()["page_text"](spark, FOLDER)).count("<!--") == 1


@pytest.fixture
def no_small_tables(spark):
    """Nothing is small enough to be sent around unasked."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def moved_columns(df):
    """Names of the columns that any shuffle of the plan carries."""
    names, plans = set(), [df._jdf.queryExecution().executedPlan()]
    while plans:
        node = plans.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.inputPlan()
        if node.nodeName() == "Exchange":
            out = node.output()
            names |= {out.apply(i).name() for i in range(out.size())}
        children = node.children()
        plans += [children.apply(i) for i in range(children.size())]
    return names


def test_contents_are_not_shuffled_to_be_shown(no_small_tables):
    m = Model(no_small_tables, FOLDER)
    pages, chunks = durable(m.pages()), durable(chunk_contents(m.contents()))
    found = keyword_search(pages, m.queries())
    assert "content" not in moved_columns(found) and "BroadcastHashJoin" in plan(found)
    # matches are stored, so the plan that ranks and counts them does not score
    assert "log1p" not in plan(found).lower()
    found = semantic_search(chunks, m.queries())
    assert "content" not in moved_columns(found) and "BroadcastHashJoin" in plan(found)


def test_terms_meet_postings_by_kb_and_term(no_small_tables):
    m = Model(no_small_tables, FOLDER)
    postings = durable(build_postings(m.pages()))
    scored = plan(bm25(postings, doc_stats(m.pages()), m.queries()))
    assert scored.lower().count("log1p") == 1
    joins = re.findall(r"(?:SortMergeJoin|ShuffledHashJoin) \[([^\]]*)\]", scored)
    assert any("kb_id" in j and "term" in j for j in joins)


def test_phrases_read_no_text(no_small_tables):
    m = Model(no_small_tables, FOLDER)
    stored = durable(build_positions(m.pages()), POSITION_FORMAT)
    phrases = m.queries().selectExpr("query_id", "kb_id as in_kb", "split(text, ' ') as phrase")
    counts = term_counts(stored, phrases.selectExpr("explode(phrase) as term"))
    found = plan(match_phrases(stored, phrases, counts))
    assert "positions" in found and "content" not in found
    # ranking over the same table leaves the positions where they are
    assert "positions" not in plan(bm25(stored, doc_stats(m.pages()), m.queries()))


@pytest.mark.parametrize("heavy", [1, 7])
def test_heavy_terms_are_cut_without_a_loss(spark, heavy):
    m = Model(spark, FOLDER)
    postings = durable(build_postings(m.pages()))
    queries = m.queries().unionByName(m.queries().selectExpr("concat('all', query_id) as query_id", "null as kb_id", "text"))
    wanted = query_terms(queries).withColumnRenamed("kb_id", "in_kb")
    counts = term_counts(postings, wanted)
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "kb_id", "page_id", "term", "tf", "kb_df").collect())
    whole, cut = term_hits(postings, wanted, counts), term_hits(postings, wanted, counts, heavy)
    assert counts.agg({"n": "max"}).first()[0] > 7
    assert "_part" in plan(cut) and "_part" not in plan(whole)
    assert rows(cut) == rows(whole)
    plain = postings.join(wanted, "term").filter("in_kb is null or in_kb = kb_id")
    assert whole.count() == plain.count() > 0
