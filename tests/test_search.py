"""Vector, keyword and hybrid search on small frames, against brute force."""

import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lorespark.operators.keyword import (
    POSITION_FORMAT,
    bm25,
    build_positions,
    build_postings,
    doc_stats,
    kb_sizes,
    keyword_search,
    match_boolean,
    match_pages,
    refresh_postings,
    refresh_statistics,
    search_index,
    term_frequencies,
)
from lorespark.operators.search import (
    hybrid_search,
    merge_results,
    normalize_scores,
    results_json,
    semantic_search,
)
from lorespark.operators.vectors import (
    ann_recall,
    assign_cells,
    cosine_distance,
    count_vectors,
    get_by_ids,
    train_cells,
    upsert_vectors,
    vector_topk,
    vector_topk_ann,
    where_equals,
)
from lorespark.plans.fixtures import Model
from lorespark.schemas import QUERIES, VECTORS
from lorespark.session import durable

RESULTS = (
    "query_id string, kb_id string, rank int, content string, source_id string,"
    " source_type string, score double, metadata string"
)
PAGES = (
    "page_id string, kb_id string, title string, content string, page_type string,"
    " tags array<string>"
)


def skewed_vectors(spark, n=400, dim=8, seed=3):
    """One kb holds most vectors, half of them copies of one another."""
    rng = np.random.default_rng(seed)
    rows = []
    same = rng.normal(size=dim)
    for i in range(n):
        kb = "big" if i % 10 else f"kb{i % 3}"
        v = same if i % 2 else rng.normal(size=dim)
        rows.append((f"v{i:04d}", kb, [float(x) for x in v], f"d{i}", {"shelf": str(i % 3)}))
    rows.append(("zero", "big", [0.0] * dim, "zero", {}))
    return spark.createDataFrame(rows, VECTORS).repartition(6)


def brute(vectors, queries, k, scoped=True):
    out = {}
    for q in queries:
        scored = []
        for v in vectors:
            if scoped and v.kb_id != q.kb_id:
                continue
            a, b = np.array(q.embedding, float), np.array(v.embedding, float)
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            scored.append((round(1 - a @ b / norm, 9) + 0.0 if norm else 2.0, v.vec_id))
        out[q.query_id] = [i for _, i in sorted(scored)[:k]]
    return out


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.mark.parametrize("scoped", [True, False])
@pytest.mark.parametrize("resident", [4096, 0])
def test_topk_equals_brute_force_on_a_skewed_kb(spark, scoped, resident):
    vectors = skewed_vectors(spark)
    queries = vectors.filter("vec_id like '%7'").select(
        F.col("vec_id").alias("query_id"), "kb_id", "embedding"
    )
    found = vector_topk(vectors, queries, 5, scoped=scoped, resident_queries=resident, tile=32)
    want = brute(vectors.collect(), queries.collect(), 5, scoped)
    assert ranked(found) == want


def test_topk_order_count_and_filter(spark):
    vectors = spark.createDataFrame(
        [
            ("a", "kb", [1.0, 0.0], "a", {"s": "1"}),
            ("b", "kb", [1.0, 1.0], "b", {"s": "2"}),
            ("c", "kb", [0.0, 1.0], "c", {"s": "1"}),
            ("d", "other", [1.0, 0.0], "d", {"s": "1"}),
        ],
        VECTORS,
    )
    query = spark.createDataFrame([("q", "kb", [1.0, 0.0])], "query_id string, kb_id string, embedding array<float>")
    assert ranked(vector_topk(vectors, query, 10)) == {"q": ["a", "b", "c"]}
    assert ranked(vector_topk(vectors, query, 1)) == {"q": ["a"]}
    assert ranked(vector_topk(vectors, query, 10, where={"s": "1"})) == {"q": ["a", "c"]}
    distances = [r.distance for r in vector_topk(vectors, query, 3).orderBy("rank").collect()]
    assert distances == sorted(distances) and distances[0] == 0.0


def test_differing_widths_are_an_error(spark):
    vectors = spark.createDataFrame(
        [("a", "kb", [1.0], "", {}), ("b", "kb", [1.0, 2.0], "", {})], VECTORS
    ).coalesce(1)
    query = spark.createDataFrame([("q", "kb", [1.0])], "query_id string, kb_id string, embedding array<float>")
    with pytest.raises(Exception, match="different widths"):
        vector_topk(vectors, query, 1).collect()


def test_cosine_distance_column_agrees(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r.d for r in df.select(cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [0.2, 2.0]


def test_upsert_is_idempotent_and_newest_version_wins(spark):
    base = spark.createDataFrame([("a", "kb", [1.0], "old", {}), ("b", "kb", [2.0], "b", {})], VECTORS)
    new = spark.createDataFrame(
        [("a", "kb", [3.0], "v1", {}, 1), ("a", "kb", [4.0], "v2", {}, 2), ("c", "kb", [5.0], "c", {}, 1)],
        VECTORS + ", version int",
    )
    once = upsert_vectors(base, new, "version")
    got = {r.vec_id: r.document for r in once.collect()}
    assert got == {"a": "v2", "b": "b", "c": "c"}
    again = upsert_vectors(once, new, "version")
    assert {r.vec_id: r.document for r in again.collect()} == got
    assert upsert_vectors(base, new.limit(0), "version").count() == 2


def test_lookup_count_and_where(spark):
    v = skewed_vectors(spark, 30)
    ids = spark.createDataFrame([("v0001",), ("nope",)], "vec_id string")
    assert [r.vec_id for r in get_by_ids(v, ids).collect()] == ["v0001"]
    kbs = spark.createDataFrame([("big",), ("empty",)], "kb_id string")
    assert {r.kb_id: r.vectors for r in count_vectors(v, kbs).collect()} == {"big": 28, "empty": 0}
    assert where_equals(v, {"shelf": "1", "kb_id": "big"}).count() == 9
    assert where_equals(v, None).count() == 31


@pytest.mark.parametrize("resident", [4096, 0])
def test_approximate_neighbours_recall(spark, resident):
    vectors = skewed_vectors(spark, 200)
    queries = vectors.filter("vec_id like '%3'").select(F.col("vec_id").alias("query_id"), "kb_id", "embedding")
    exact = vector_topk(vectors, queries, 3)
    options = {"resident_queries": resident, "tile": 16}
    some = vector_topk_ann(vectors, queries, 3, **options)
    assert ann_recall(exact, some).agg(F.avg("recall")).first()[0] >= 0.9
    cells = train_cells(vectors, 3)
    laid = assign_cells(vectors, cells)
    assert 1 < len(cells.lift) <= 15 and laid.select("cell").distinct().count() > 1
    every = vector_topk_ann(laid, queries, 3, cells, probes=len(cells.lift), **options)
    assert ranked(every) == ranked(exact)
    # with a filter, in all kbs
    where = {"shelf": "1"}
    wide = vector_topk_ann(laid, queries, 3, cells, len(cells.lift), where, scoped=False, **options)
    assert ranked(wide) == ranked(vector_topk(vectors, queries, 3, where, scoped=False))


def test_approximate_neighbours_of_nothing(spark):
    none = skewed_vectors(spark, 3).limit(0)
    some = skewed_vectors(spark, 3).select(F.col("vec_id").alias("query_id"), "kb_id", "embedding")
    assert vector_topk_ann(none, some, 3).count() == 0
    assert vector_topk_ann(skewed_vectors(spark, 3), some.limit(0), 3).count() == 0


@pytest.mark.parametrize("size", ["0.001", "0.01"])
@pytest.mark.parametrize("scoped", [True, False])
def test_recall_of_trained_cells_on_the_table(spark, size, scoped):
    m = Model(spark, f"/root/testdata/sf{size}")
    exact = vector_topk(m.vectors(), m.vector_queries(), 5, scoped=scoped)
    cells = train_cells(m.vectors(), 5, scoped=scoped)
    some = vector_topk_ann(m.vectors(), m.vector_queries(), 5, cells, scoped=scoped)
    recall = ann_recall(exact, some).agg(F.avg("recall")).first()[0]
    print(size, scoped, "recall", recall, "probes", cells.probes, "of", len(cells.lift))
    assert recall >= 0.9


def test_cells_of_crowded_vectors_are_balanced(spark):
    random = np.random.default_rng(1)
    spread = random.normal(size=(300, 8))
    crowd = np.array([4.0] + [0.0] * 7) + 0.3 * random.normal(size=(700, 8))
    rows = [(f"v{i}", "kb", [float(x) for x in v], "", {}) for i, v in enumerate(np.concatenate([spread, crowd]))]
    vectors = spark.createDataFrame(rows, VECTORS)
    cells = train_cells(vectors, 3)
    sizes = [r["count"] for r in assign_cells(vectors, cells).groupBy("cell").count().collect()]
    assert len(cells.lift) == 31 and max(sizes) <= 2.5 * 1000 / 31


def pages(spark):
    return spark.createDataFrame(
        [
            ("p1", "kb", "Python Guide", "Learn python and python tools", "concept", ["python", "guide"]),
            ("p2", "kb", "Snakes", "A python is a snake", "entity", []),
            ("p3", "kb", "Rust", "Systems language guide", "entity", ["rust"]),
            ("p4", "other", "Python Other", "python elsewhere", "entity", []),
        ],
        PAGES,
    )


def asked(spark, *texts):
    return spark.createDataFrame([(f"q{i}", "kb", t) for i, t in enumerate(texts)], QUERIES)


def test_keyword_membership_scores_and_scope(spark):
    found = keyword_search(pages(spark), asked(spark, "python", "Python guide", "nothing"), 10)
    rows = {}
    for r in found.orderBy("query_id", "rank").collect():
        rows.setdefault(r.query_id, []).append((r.source_id, r.score))
    assert [i for i, _ in rows["q0"]] == ["p1", "p2"]
    assert [s for _, s in rows["q0"]] == [1.0, 0.5]
    assert [i for i, _ in rows["q1"]] == ["p1"]
    assert "q2" not in rows
    meta = json.loads(found.filter("source_id = 'p1'").first().metadata)
    assert meta == {"title": "Python Guide", "page_type": "concept", "tags": ["python", "guide"]}


def test_score_counts_all_matches_before_the_cut(spark):
    many = spark.createDataFrame(
        [(f"p{i}", "kb", f"T{i}", "word", "entity", []) for i in range(8)], PAGES
    )
    rows = keyword_search(many, asked(spark, "word"), 2).orderBy("rank").collect()
    assert [r.score for r in rows] == [1.0, 1 - 1 / 8]


def test_given_index_and_fresh_index_agree(spark):
    p, q = pages(spark), asked(spark, "python", "guide")
    given_index = keyword_search(p, q, 5, build_postings(p), doc_stats(p))
    assert sorted(given_index.collect()) == sorted(keyword_search(p, q, 5).collect())


def test_terms_met_by_a_join_or_inside_the_row_agree(spark):
    p, q = pages(spark), asked(spark, "python", "rust guide")
    few, many = search_index(p, q), search_index(p, q, resident_terms=1)
    for a, b in zip(few, many):
        assert sorted(a.collect()) == sorted(b.select(a.columns).collect())
    assert few[1].count() == 4 and few[0].filter("term = 'python'").count() == 3


def test_refresh_follows_updates_and_deletes(spark):
    p = pages(spark)
    changed = p.filter("page_id = 'p2'").withColumn("content", F.lit("now about java"))
    index = refresh_postings(build_postings(p), changed, p.filter("page_id = 'p1'"))
    assert match_pages(index, asked(spark, "python")).count() == 0
    assert [r.page_id for r in match_pages(index, asked(spark, "java")).collect()] == ["p2"]


def test_boolean_matching(spark):
    p = pages(spark)
    schema = (
        "query_id string, kb_id string, any array<string>, none array<string>,"
        " prefix string, phrase string"
    )
    queries = spark.createDataFrame(
        [
            ("any", "kb", ["snake", "rust"], [], None, None),
            ("none", "kb", ["python"], ["snake"], None, None),
            ("prefix", "kb", None, None, "pyth", None),
            ("phrase", "kb", None, None, None, "python tools"),
            ("scattered", "kb", None, None, None, "tools python"),
            ("everywhere", None, ["elsewhere"], None, None, None),
        ],
        schema,
    )
    got = {}
    for r in match_boolean(build_postings(p), p, queries).collect():
        got.setdefault(r.query_id, set()).add(r.page_id)
    assert got == {
        "any": {"p2", "p3"},
        "none": {"p1"},
        "prefix": {"p1", "p2"},
        "phrase": {"p1"},
        "everywhere": {"p4"},
    }


def asked_phrases(spark, *phrases):
    schema = (
        "query_id string, kb_id string, any array<string>, none array<string>,"
        " prefix string, phrase string"
    )
    return spark.createDataFrame([(p, "kb", None, None, None, p) for p in phrases], schema)


def test_positions_count_through_the_fields_of_a_page(spark):
    p = spark.createDataFrame(
        [
            ("p1", "kb", "Red fish", "blue fish, RED fish", "topic", ["red"]),
            ("p2", "kb", "!", None, "topic", []),
            ("p3", "kb", None, "a a a", "topic", None),
        ],
        PAGES,
    )
    got = {(r.page_id, r.term): (r.tf, r.doc_len, r.positions) for r in build_positions(p).collect()}
    assert got == {
        ("p1", "red"): (3, 7, [0, 5, 8]),
        ("p1", "fish"): (3, 7, [1, 4, 6]),
        ("p1", "blue"): (1, 7, [3]),
        ("p3", "a"): (3, 3, [1, 2, 3]),
    }
    assert build_positions(p.limit(0)).count() == 0
    plain = build_postings(p)
    assert sorted(build_positions(p).select(plain.columns).collect()) == sorted(plain.collect())


def test_phrases_by_positions(spark):
    p = spark.createDataFrame(
        [
            ("p1", "kb", "one", "to be or not to be that is", "topic", []),
            ("p2", "kb", "one two", "three be to be", "topic", []),
            ("p3", "kb", "be", "to", "topic", ["be"]),
            ("p4", "far", "to be", "to be or not to be", "topic", []),
        ],
        PAGES,
    )
    queries = asked_phrases(spark, "To be, or", "to be", "to be or not to be", "two three", "be be", "not here", "be")
    expected = {
        "To be, or": {"p1"}, "to be": {"p1", "p2"}, "to be or not to be": {"p1"}, "be": {"p1", "p2", "p3"},
    }

    def found(postings, pages):
        got = {}
        for r in match_boolean(postings, pages, queries).collect():
            got.setdefault(r.query_id, set()).add(r.page_id)
        return got

    stored = durable(build_positions(p), POSITION_FORMAT)
    assert found(stored, None) == expected == found(build_postings(p), p)
    changed = p.filter("page_id = 'p1'").withColumn("content", F.lit("be to be"))
    fresh = refresh_postings(stored, changed, p.filter("page_id = 'p3'"))
    assert found(fresh, None) == {"to be": {"p1", "p2"}, "be": {"p1", "p2"}}


def test_stored_positions_are_gaps(spark, tmp_path):
    words = " ".join(f"w{i % 50}" for i in range(20_000))
    p = spark.createDataFrame([("p1", "kb", "t", words, "topic", [])], PAGES)
    build_positions(p).coalesce(1).write.options(**POSITION_FORMAT).parquet(str(tmp_path / "x"))
    file = next((tmp_path / "x").glob("*.parquet"))
    group = pq.ParquetFile(file).metadata.row_group(0)
    columns = [group.column(i) for i in range(group.num_columns)]
    kept = next(c for c in columns if c.path_in_schema.startswith("positions"))
    assert "DELTA_BINARY_PACKED" in kept.encodings
    assert kept.total_uncompressed_size < 20_000 * 2  # four bytes each without


def test_statistics_follow_changes(spark):
    p = pages(spark)
    deleted = p.filter("page_id = 'p1'")
    old = p.filter("page_id = 'p2'")
    new = old.withColumn("content", F.lit("java python java"))
    added = spark.createDataFrame([("p9", "new kb", "fresh", "java", "topic", [])], PAGES)
    whole = p.filter("page_id not in ('p1', 'p2')").unionByName(new).unionByName(added)
    counted = term_frequencies(build_postings(p)), kb_sizes(doc_stats(p))
    frequencies, sizes = refresh_statistics(*counted, old.unionByName(deleted), new.unionByName(added))
    want = term_frequencies(build_postings(whole)), kb_sizes(doc_stats(whole))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(frequencies) == rows(want[0]) and rows(sizes) == rows(want[1])
    index = refresh_postings(build_postings(p), new.unionByName(added), deleted)
    q = asked(spark, "java", "python", "rust")
    for scope in ("global", "kb"):
        fresh = bm25(index, None, q, scope, frequencies, sizes)
        assert rows(fresh) == rows(bm25(build_postings(whole), doc_stats(whole), q, scope)) != []
    # a kb that loses its last page loses its rows
    none, empty = refresh_statistics(*counted, p, p.limit(0))
    assert rows(none) == rows(empty) == []


def results(spark, kind, *rows):
    return spark.createDataFrame(
        [("q", "kb", i + 1, c, s, kind, float(x), "{}") for i, (c, s, x) in enumerate(rows)], RESULTS
    )


def test_normalize_scores(spark):
    df = results(spark, "chunk", ("a", "a", 0.2), ("b", "b", 0.6), ("c", "c", 1.0))
    got = {r.source_id: round(r.score, 9) for r in normalize_scores(df).collect()}
    assert got == {"a": 0.0, "b": 0.5, "c": 1.0}
    same = results(spark, "chunk", ("a", "a", 0.4), ("b", "b", 0.4))
    assert {r.score for r in normalize_scores(same).collect()} == {1.0}
    assert normalize_scores(df.limit(0)).count() == 0


def test_merge_weights_and_shared_content(spark):
    semantic = results(spark, "chunk", ("shared", "c1", 1.0), ("only chunk", "c2", 0.0))
    keyword = results(spark, "wiki_page", ("only page", "p2", 1.0), ("shared", "p1", 0.5))
    rows = merge_results(semantic, keyword, 10).orderBy("rank").collect()
    assert [(r.source_id, r.score) for r in rows] == [("c1", 0.85), ("p2", 0.3), ("c2", 0.0)]


def test_merge_last_keyword_row_of_a_content_decides(spark):
    semantic = results(spark, "chunk", ("same", "c1", 1.0), ("same", "c2", 0.5))
    keyword = results(spark, "wiki_page", ("same", "p1", 1.0), ("same", "p2", 0.0), ("x", "p3", 1.0), ("x", "p4", 0.5))
    rows = merge_results(semantic, keyword, 10).orderBy("rank").collect()
    assert [(r.source_id, r.score) for r in rows] == [
        ("c1", 0.7), ("c2", 0.35), ("p3", 0.3), ("p4", 0.15),
    ]


def test_merge_equal_scores_keep_chunks_first(spark):
    semantic = results(spark, "chunk", ("a", "c1", 0.3), ("b", "c2", 0.3))
    keyword = results(spark, "wiki_page", ("c", "p1", 0.7))
    rows = merge_results(semantic, keyword, 2).orderBy("rank").collect()
    assert [r.source_id for r in rows] == ["c1", "c2"]


def test_semantic_and_hybrid_end_to_end(spark):
    chunks = spark.createDataFrame(
        [("c1", "kb", "python snake", {"a": "1"}), ("c2", "kb", "rust crab", {}), ("c3", "other", "python snake", {})],
        "chunk_id string, kb_id string, content string, metadata map<string,string>",
    )
    q = asked(spark, "python snake")
    rows = semantic_search(chunks, q, 2).orderBy("rank").collect()
    assert [r.source_id for r in rows] == ["c1", "c2"]
    assert rows[0].score == 1.0 and 0 <= rows[1].score < 1
    mixed = hybrid_search(chunks, pages(spark), q, 3).orderBy("rank").collect()
    assert mixed[0].source_id == "c1" and {"p2"} <= {r.source_id for r in mixed}
    shown = json.loads(results_json(hybrid_search(chunks, pages(spark), q, 1)).first().json)
    assert shown["source_id"] == "c1" and shown["source_type"] == "chunk"


def numbers_of(frame, name):
    """How many tiles and copies the laid out rows of a tiled search make."""
    return {r[0]: r[1] for r in frame.groupBy(name).count().collect()}


@pytest.mark.parametrize("all_cells", [True, False])
def test_a_query_goes_to_a_tile_once_however_many_cells_it_probes(spark, monkeypatch, all_cells):
    """Copies of queries are bounded by the blocks of a kb, neither by cells nor by 1 / ``tile``."""
    from lorespark.operators import vectors as operator

    vectors = skewed_vectors(spark, 600).filter("vec_id <> 'zero'")
    queries = vectors.select(F.concat(F.lit("q"), "vec_id").alias("query_id"), "kb_id", "embedding")
    laid = []
    cogroup = type(vectors).groupBy

    def watched(frame, *columns):
        if isinstance(columns[-1], str) and columns[-1] == "q_block":
            laid.append(frame)
        return cogroup(frame, *columns)

    cells = train_cells(vectors, 3, scoped=False)
    probes = len(cells.lift) if all_cells else 2
    monkeypatch.setattr(type(vectors), "groupBy", watched)
    found = vector_topk_ann(vectors, queries, 3, cells, probes, scoped=False, resident_queries=0, tile=2)
    monkeypatch.undo()
    copies = numbers_of(laid[1], "query_id")
    assert len(cells.lift) > operator.MOST_BLOCKS and max(copies.values()) <= operator.MOST_BLOCKS
    if all_cells:
        assert ranked(found) == ranked(vector_topk(vectors, queries, 3, scoped=False))
    else:
        whole = vector_topk_ann(vectors, queries, 3, cells, probes, scoped=False, resident_queries=10_000)
        assert ranked(found) == ranked(whole)
    laid.clear()
    monkeypatch.setattr(type(vectors), "groupBy", watched)
    exact = vector_topk(vectors, queries, 3, scoped=False, resident_queries=0, tile=2)
    monkeypatch.undo()
    assert max(numbers_of(laid[1], "query_id").values()) <= operator.MOST_BLOCKS
    assert exact.count() == 3 * 600


def test_nearest_of_odd_vectors():
    from lorespark.operators.vectors import Nearest

    rng = np.random.default_rng(4)
    odd = np.array([[np.inf, 0, 1], [np.nan, 0, 1], [0, 0, 0], [1e-200, 0, 0], [-1, 0, 0]], float)
    matrix = np.concatenate([odd, rng.normal(size=(60, 3)), odd])
    ids = np.array([f"v{i:02d}" for i in range(len(matrix))], object)
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    sound = norms > 0
    with np.errstate(invalid="ignore"):
        units = matrix / np.where(sound, norms, 1)[:, None]
        want = np.round(1 - units @ units.T, 10) + 0.0
    want[~sound], want[:, ~sound] = 2.0, 2.0
    for k in (1, 4, 80):
        nearest = Nearest(ids, matrix, k)
        for rows in (slice(0, 40), slice(40, 70)):
            nearest.add(pa.array(ids[rows], pa.string()), matrix[rows])
        got = {}
        for r in nearest.result().to_pylist():
            got.setdefault(r["query_id"], []).append((r["distance"], r["vec_id"]))
        for i, name in enumerate(ids):
            best = sorted((d, v) for d, v in zip(want[i], ids) if not np.isnan(d))[:k]
            assert [v for _, v in got.get(name, [])] == [v for _, v in best], (k, name)


@pytest.mark.parametrize("resident", [4096, 0])
def test_boolean_matching_without_an_index(spark, resident):
    """Words that nobody asks for are not indexed, and no page is met that lacks a phrase's whole run."""
    pages = [
        ("p1", "of the", "The cat of The house", ["x y"]), ("p2", "", "of cat the house", ["the"]),
        ("p3", "un", "under les", []), ("p4", "of", "the end of", ["the"]), ("p5", "", "", []),
    ]
    pages = spark.createDataFrame(pages, "page_id string, title string, content string, tags array<string>")
    pages = pages.withColumn("kb_id", F.lit("kb"))
    queries = spark.createDataFrame(
        [
            ("phrase", "kb", None, None, None, "of the"), ("else", "no", None, None, None, "of the"),
            ("long", None, None, ["zu"], None, "the cat of the house"), ("one", "kb", None, None, None, "house"),
            ("prefix", "kb", ["les", "cat"], [], "Un", None), ("none", "kb", ["the"], ["end"], None, None),
        ],
        "query_id string, kb_id string, any array<string>, none array<string>, prefix string, phrase string",
    )
    want = sorted(map(tuple, match_boolean(build_positions(pages), None, queries).collect()))
    got = sorted(map(tuple, match_boolean(None, pages, queries, resident).collect()))
    assert got == want and ("phrase", "kb", "p1") in got and len(got) == 7
    kept = build_positions(pages, lambda term: term == "house")
    full = build_positions(pages).filter("term = 'house'")
    assert sorted(map(str, kept.collect())) == sorted(map(str, full.collect())) and kept.count() == 2


def test_phrases_of_frequent_words_make_no_row_a_word(spark):
    """Phrases whose words stand in every page, but in another order, meet no page."""
    from lorespark.operators.keyword import phrases_in_text

    rows = [(str(i), "kb", "the of " * 5 + f"w{i}") for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id string, kb_id string, content string")
    phrases = spark.createDataFrame([(f"q{i}", "kb", ["of", "the", f"v{i}"]) for i in range(50)], "query_id string, in_kb string, phrase array<string>")
    found = phrases_in_text(pages, phrases.union(spark.createDataFrame([("hit", "kb", ["of", "w7"])], phrases.schema)))
    assert [tuple(r) for r in found.collect()] == [("hit", "kb", "7")]
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_statistics_of_pages_in_one_pass(spark):
    from lorespark.operators.keyword import page_statistics

    rows = [("p1", "kb", "a b a"), ("p2", "kb", "b"), ("p3", "kb", " "), ("p4", "else", None), ("p5", "third", "B c")]
    p = spark.createDataFrame(rows, "page_id string, kb_id string, content string")
    frequencies, sizes = page_statistics(p)
    assert sorted(map(tuple, frequencies.collect())) == sorted(map(tuple, term_frequencies(build_postings(p)).collect()))
    assert sorted(map(tuple, sizes.collect())) == sorted(map(tuple, kb_sizes(doc_stats(p)).collect()))
    assert all(f.columns == g.columns for f, g in ((frequencies, term_frequencies(build_postings(p))), (sizes, kb_sizes(doc_stats(p)))))
