"""Readers: files, trees, JSON, HTML, tables, commits, responses, dispatch."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from lorespark.schemas import SOURCES
from lorespark.session import durable
from lorespark.sources.commits import commit_documents
from lorespark.sources.dispatch import (
    api_reader,
    commit_reader,
    contents_and_errors,
    read_or_fail,
    read_sources,
    table_reader,
    website_reader,
)
from lorespark.sources.files import filter_paths, ignore_patterns, list_tree, read_corpus
from lorespark.sources.html import extract_pages
from lorespark.sources.jsontext import normalize_json
from lorespark.sources.metadata import merge_metadata
from lorespark.sources.responses import response_documents
from lorespark.sources.tables import CONSTRAINTS, table_cards


def source(sid, kind, uri, meta=None):
    return (sid, "kb", kind, str(uri), meta or {}, None, 0, "pending")


def sources(spark, *rows):
    return spark.createDataFrame(list(rows), SOURCES)


@pytest.fixture
def tree(tmp_path):
    files = {
        "a.txt": "alpha",
        "sub/b.txt": "beta\r\nline\rend",
        "sub/c.py": "def f():\n    pass\n",
        "sub/__init__.py": "x = 1",
        "sub/deep/d.json": '{"b": 1, "a": [1, 2]}',
        ".hidden": "no",
        ".git/config": "no",
        "__pycache__/x.pyc": "no",
        "node_modules/m.js": "no",
        "logs/run.log": "no",
        "out/x.txt": "no",
        "empty.txt": "",
        ".gitignore": "# comment\n*.log\nout/\n\n",
    }
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (tmp_path / "bad.txt").write_bytes(b"ok \xff end")
    return tmp_path


def test_tree_walk_prunes_and_numbers_in_path_order(spark, tree):
    roots = spark.createDataFrame([("s", str(tree)), ("gone", str(tree / "nowhere"))], "source_id string, root string")
    rows = list_tree(roots).orderBy("part").collect()
    assert [r.rel_path for r in rows] == [
        "a.txt", "bad.txt", "empty.txt", "sub/__init__.py", "sub/b.txt", "sub/c.py", "sub/deep/d.json",
    ]
    assert [r.part for r in rows] == list(range(7))
    assert {r.source_id for r in rows} == {"s"}


def test_directory_and_codebase_contents(spark, tree):
    df = read_sources(sources(
        spark,
        source("d", "directory", tree, {"team": "x", "file_type": "mine"}),
        source("c", "codebase", tree),
        source("f", "file", tree / "sub" / "__init__.py"),
    ))
    rows = {(r.source_id, r.metadata["file_path"].replace(str(tree) + "/", "")): r for r in df.collect()}
    assert rows["d", "sub/b.txt"].text == "beta\nline\nend"
    assert rows["d", "bad.txt"].text == "ok � end"
    assert rows["d", "sub/deep/d.json"].text == json.dumps({"b": 1, "a": [1, 2]}, indent=2)
    assert ("d", "empty.txt") not in rows
    assert rows["d", "a.txt"].metadata["team"] == "x" and rows["d", "a.txt"].metadata["file_type"] == "mine"
    assert rows["c", "sub/c.py"].metadata["language"] == "python"
    assert rows["c", "a.txt"].metadata["language"] == "unknown"
    assert rows["f", "sub/__init__.py"].text == "x = 1"


def test_missing_file_gives_nothing(spark, tree):
    listing = spark.createDataFrame([("s", str(tree / "nope.txt"), 0)], "source_id string, path string, part int")
    assert read_corpus(listing).count() == 0


def test_what_cannot_be_read_is_told_beside_what_can(spark, tree):
    (tree / "sub" / "paper.pdf").write_bytes(b"%PDF")
    (tree / "x.gz").write_bytes(b"plain all the same")
    responses = spark.createDataFrame(
        [("ok", 200, "text/plain", "fine"), ("gone", 404, "text/plain", "no"), ("blank", 200, "text/plain", ""), ("odd", None, "text/plain", "x")],
        "url string, status_code int, content_type string, body string",
    )
    pages = spark.createDataFrame([("w", HTML), ("w0", "<nav>only</nav>")], "url string, html string")
    commits = spark.createDataFrame(
        [("r", f"c{i}", "Ann", "a@x", datetime.datetime(2024, 1, i + 1), "m") for i in range(3)],
        "repo string, sha string, author string, email string, date timestamp, message string",
    )
    changes = spark.createDataFrame([], "repo string, sha string, ord int, change_type string, a_path string, b_path string")
    rows = sources(
        spark,
        source("ok", "file", tree / "a.txt"), source("gone", "file", tree / "no.txt"), source("dir", "file", tree / "sub"),
        source("pdf", "file", tree / "sub" / "paper.pdf"), source("bad", "file", "nowhere://x/y"), source("gz", "file", tree / "x.gz"),
        source("empty", "file", tree / "empty.txt"),
        source("tree", "directory", tree / "sub"), source("clean", "directory", tree / "sub" / "deep"),
        source("none", "directory", tree / "nothing"), source("flat", "directory", tree / "a.txt"), source("badtree", "codebase", "nowhere://x"),
        source("a1", "api_endpoint", "ok"), source("a2", "api_endpoint", "gone"), source("a3", "api_endpoint", "blank"),
        source("a4", "api_endpoint", "never"), source("a5", "api_endpoint", "odd"),
        source("w1", "website", "w"), source("w2", "website", "w0"), source("w3", "website", "w?"),
        source("g1", "git_history", "r", {"max_commits": "1"}), source("g2", "git_history", "r"), source("g3", "git_history", "q"),
        source("d1", "sql_database", "db://x"), source("d2", "sql_database", "db://y"), source("d3", "sql_database", "db://empty"),
        ("null", "kb", "file", None, {}, None, 0, "pending"),
    )
    readers = {
        "api_endpoint": api_reader(responses), "website": website_reader(pages), "git_history": commit_reader(commits, changes),
        "sql_database": table_reader({"db://x": {"t": spark.range(1)}, "db://empty": {}}),
    }
    got = durable(read_or_fail(rows, readers))
    contents, errors = contents_and_errors(got)
    assert {r.source_id: r.error for r in errors.collect()} == {
        "gone": f"no such file: {tree}/no.txt", "dir": f"cannot read: {tree}/sub",
        "pdf": f"unsupported file type: {tree}/sub/paper.pdf", "bad": "not a location: nowhere://x/y",
        "tree": f"unsupported file type: {tree}/sub/paper.pdf", "badtree": "not a location: nowhere://x",
        "a2": "status 404: gone", "a4": "not fetched: never", "a5": "status missing: odd", "w3": "not fetched: w?",
        "g3": "no such repository: q", "d2": "no such database: db://y", "null": "not a location: None",
    }
    assert got.filter("(error is null) = (text is null)").count() == 0
    parts = {r.source_id: r.n for r in contents.groupBy("source_id").agg(F.count("*").alias("n")).collect()}
    assert parts == {"ok": 1, "gz": 1, "tree": 4, "clean": 1, "a1": 1, "w1": 1, "g1": 1, "g2": 3, "d1": 1}
    assert contents.filter("source_id = 'gz'").first().text == "plain all the same"


def test_filter_paths_rules(spark):
    paths = ["a.py", "x/.h/b", ".env", "build/a", "x/build/a", "build", "x/a.log", "tmp/k/a.txt", "a/tmp/z"]
    df = spark.createDataFrame([(p,) for p in paths], "rel_path string")
    kept = sorted(r.rel_path for r in filter_paths(df, ["*.log", "tmp/"]).collect())
    assert kept == ["a.py", "build"]
    assert filter_paths(df).count() == 5


def test_ignore_lines():
    assert ignore_patterns(" *.log \n\n# x\nbuild/\n") == ["*.log", "build/"]


def test_unknown_source_type_is_an_error(spark):
    with pytest.raises(ValueError, match="no reader.*carrier_pigeon"):
        read_sources(sources(spark, source("x", "carrier_pigeon", "u")))


def test_json_text(spark):
    df = spark.createDataFrame([('{"k": "é", "a": {}}',), ("not json",), (None,), ("[1, 2]",)], "text string")
    got = [r.text for r in normalize_json(df).collect()]
    assert got == ['{\n  "k": "é",\n  "a": {}\n}', "not json", None, "[\n  1,\n  2\n]"]


HTML = """<html><head><title>T &amp; U</title><style>p{}</style></head><body><nav>menu</nav>
<!-- gone --><p>One&nbsp;two<br>three</p><script>var x = "<p>";</script><div>A &lt;b&gt;</div>
<footer>foot</footer></body></html>"""


def test_html_rules(spark):
    df = spark.createDataFrame([("u1", HTML), ("u2", "<nav>only</nav>")], "url string, html string")
    rows = extract_pages(df).collect()
    assert [(r.url, r.title, r.text) for r in rows] == [("u1", "T & U", "One two\nthree\nA <b>")]


def test_commit_documents(spark):
    day = datetime.datetime(2024, 1, 1)
    commits = spark.createDataFrame(
        [
            ("r", "c1", "Ann", "ann@x", day, "first\n"),
            ("r", "c2", "Bob", "bob@x", day + datetime.timedelta(days=1), " second "),
        ],
        "repo string, sha string, author string, email string, date timestamp, message string",
    )
    changes = spark.createDataFrame(
        [
            ("r", "c2", 0, "A", "", "new.txt"),
            ("r", "c2", 1, "D", "old.txt", ""),
            ("r", "c2", 2, "M", "m.txt", "m.txt"),
            ("r", "c2", 3, "R", "a.txt", "b.txt"),
            ("r", "c2", 4, "T", "t.txt", "t.txt"),
        ],
        "repo string, sha string, ord int, change_type string, a_path string, b_path string",
    )
    rows = {r.sha: r.text for r in commit_documents(commits, changes).collect()}
    assert rows["c1"] == "Commit: c1\nAuthor: Ann <ann@x>\nDate: 2024-01-01T00:00:00+00:00\nMessage: first"
    assert rows["c2"].endswith(
        "Message: second\n\nChanged files:\n  + new.txt\n  - old.txt\n  M m.txt\n  R a.txt -> b.txt\n  T t.txt"
    )
    assert [r.sha for r in commit_documents(commits, changes, 1).collect()] == ["c2"]
    read = read_sources(
        sources(spark, source("g", "git_history", "r", {"author": "user"})),
        {"git_history": commit_reader(commits, changes)},
    ).orderBy("part").collect()
    assert [r.metadata["commit_sha"] for r in read] == ["c2", "c1"]
    assert {r.metadata["author"] for r in read} == {"user"}


def test_responses(spark):
    df = spark.createDataFrame(
        [
            ("j", 200, "application/json; charset=utf-8", '{"a":1}'),
            ("b", 200, "application/json", "broken"),
            ("t", 200, "text/plain", '{"a":1}'),
            ("e", 200, "text/plain", ""),
            ("x", 500, "text/plain", "error"),
        ],
        "url string, status_code int, content_type string, body string",
    )
    good, rejects = response_documents(df)
    assert {r.url: r.text for r in good.collect()} == {"j": '{\n  "a": 1\n}', "b": "broken", "t": '{"a":1}'}
    assert [r.url for r in rejects.collect()] == ["x"]
    pages = spark.createDataFrame([("w", HTML)], "url string, html string")
    read = read_sources(
        sources(spark, source("1", "api_endpoint", "j"), source("2", "website", "w")),
        {"api_endpoint": api_reader(df), "website": website_reader(pages)},
    )
    meta = {r.source_id: r.metadata for r in read.collect()}
    assert meta["1"]["status_code"] == "200" and meta["2"]["title"] == "T & U"


def test_table_cards(spark):
    users = spark.createDataFrame([(1, "Ann")], "id int, name string")
    keys = spark.createDataFrame(
        [
            ("users", "primary", ["id"], None, None),
            ("users", "foreign", ["name"], "people", ["name"]),
        ],
        CONSTRAINTS,
    )
    card = table_cards(spark, {"users": users}, keys, {("users", "name"): "'x'"}, 2).first()
    assert card.text == (
        "Table: users\n\nColumns:\n  - id: int NULL\n  - name: string NULL DEFAULT 'x'\n"
        "\nPrimary Key: id\n\nForeign Keys:\n  - (name) -> people(name)\n"
        '\nSample rows (1):\n  {"id":1,"name":"Ann"}'
    )
    plain = table_cards(spark, {"users": users, "more": users}).orderBy("table").collect()
    assert plain[0].text == "Table: more\n\nColumns:\n  - id: int NULL\n  - name: string NULL"
    read = read_sources(
        sources(spark, source("s", "sql_database", "db://x")),
        {"sql_database": table_reader({"db://x": {"users": users}})},
    ).first()
    assert read.metadata == {"connection_string": "db://x", "table_name": "users"}


def test_user_metadata_wins(spark):
    row = spark.range(1).select(
        merge_metadata(
            F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")),
            F.create_map(F.lit("b"), F.lit("user")),
        ).alias("m")
    ).first()
    assert row.m == {"a": "1", "b": "user"}


def test_json_that_cannot_be_indented_stays(spark):
    texts = ['{"a":"\\ud800"}', "[" * 100_000, '{"a":1}']
    df = normalize_json(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert [r.text for r in df.collect()] == [*texts[:2], '{\n  "a": 1\n}']


def test_response_without_status_is_rejected(spark):
    rows = spark.createDataFrame([("u", None, "text/plain", "b")], "url string, status_code int, content_type string, body string")
    documents, rejects = response_documents(rows)
    assert documents.count() == 0 and rejects.count() == 1


def test_files_are_opened_once(spark, tmp_path):
    from lorespark.sources import files

    (tmp_path / "a.json").write_text('{"a":[1]}')
    (tmp_path / "b").write_text('{"a":[1]}')
    listing = spark.createDataFrame([(n, str(tmp_path / n), 0) for n in ("a.json", "b")], "source_id string, path string, part int")
    rows = files.read_or_fail(listing)
    assert {r.source_id: r.text for r in rows.collect()} == {"a.json": '{\n  "a": [\n    1\n  ]\n}', "b": '{"a":[1]}'}
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_small_directories_share_a_batch(tmp_path):
    import pandas as pd

    from lorespark.sources.files import _children

    for i in range(30):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / "x").write_text("x")
    roots = pd.DataFrame([(str(i), str(tmp_path / str(i)), "", None) for i in range(30)], columns=["source_id", "root", "rel_path", "ignore"])
    (found,) = _children([roots])
    assert found["rel_path"].tolist() == ["x"] * 30
