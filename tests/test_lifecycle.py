"""Knowledge bases, ingest, run log, export and the two streams."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lorespark.operators import export, ingest, lifecycle, runs, wiki
from lorespark.schemas import CONTENTS, KBS, LINKS, PAGE_SOURCES, PAGES, PHASES, RUN_EVENTS, SOURCES
from lorespark.session import durable
from lorespark.functions.frames import bounded_parts, numbered
from lorespark.streaming.ingest import ingest_stream, latest_chunks, latest_vectors, stream_contents
from lorespark.streaming.runs import ROCKSDB, allowed, store_run_states, stream_run_events

T0 = datetime.datetime(2024, 1, 1)


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def kbs(spark, *names):
    return spark.createDataFrame([(n, f"name {n}", "", {}, T0, T0) for n in names], KBS)


def sources(spark, *rows):
    return spark.createDataFrame(
        [(s, kb, "file", f"/{s}.txt", {}, None, 0, "ingesting") for s, kb in rows], SOURCES
    )


def contents(spark, *rows):
    return spark.createDataFrame([(s, kb, 0, t, {}) for s, kb, t in rows], CONTENTS)


def test_duplicate_kb_name_is_an_error(spark):
    base = kbs(spark, "a")
    assert lifecycle.create_kbs(base, kbs(spark, "b")).count() == 2
    for new in (kbs(spark, "a"), kbs(spark, "c").union(kbs(spark, "c"))):
        with pytest.raises(ValueError, match="already used"):
            lifecycle.create_kbs(base, new)


def ingested(spark, **options):
    return ingest.ingest(
        kbs(spark, "kb"),
        sources(spark, ("s1", "kb"), ("s2", "kb"), ("s3", "kb")),
        contents(spark, ("s1", "kb", "chunk one content"), ("s3", "kb", "never stored")),
        now(),
        spark.createDataFrame([("s3", "boom")], "source_id string, error string"),
        **options,
    )


def test_ingest_marks_logs_and_summarizes(spark):
    out = ingested(spark)
    marked = {r.source_id: (r.status, r.chunk_count) for r in out.sources.collect()}
    assert marked == {"s1": ("ingested", 1), "s2": ("ingested", 0), "s3": ("failed", 0)}
    pages = {r.title: r.content for r in out.pages.collect()}
    assert pages == {
        "Source: /s1.txt": "# /s1.txt\n\nSource type: file\n\nChunks ingested: 1\n"
        "\n## Content Preview\n\nchunk one content...",
        "Source: /s2.txt": "# /s2.txt\n\nSource type: file\n\nChunks ingested: 0\n",
    }
    assert out.page_sources.count() == 2
    assert [r.document for r in out.vectors.collect()] == ["chunk one content"]
    status = {r.status: r.error for r in runs.run_status(out.run_events).collect()}
    assert status == {"completed": None, "failed": "boom"}
    assert runs.invalid_transitions(out.run_events).count() == 0


def test_ingest_checks(spark):
    with pytest.raises(ValueError, match="unknown knowledge base: nope"):
        ingest.ingest(kbs(spark, "kb"), sources(spark, ("s", "nope")), contents(spark), now())
    odd = sources(spark, ("s", "kb")).withColumn("source_type", F.lit("smell"))
    with pytest.raises(ValueError, match="unknown source type: smell"):
        ingest.ingest(kbs(spark, "kb"), odd, contents(spark), now())


def test_ingest_sources_reads_and_chunks(spark, tmp_path):
    (tmp_path / "m.py").write_text("import os\n\ndef f():\n    pass\n")
    (tmp_path / "a.md").write_text("hello")
    tree = sources(spark, ("t", "kb")).withColumn("uri", F.lit(str(tmp_path)))
    out = ingest.ingest_sources(kbs(spark, "kb"), tree.withColumn("source_type", F.lit("codebase")), now())
    rows = out.chunks.orderBy("part", "chunk_index").collect()
    assert [r.metadata.get("symbol_type") for r in rows] == [None, "module", "function"]
    assert out.sources.first().chunk_count == 3
    assert "hello..." in out.pages.first().content


def test_refresh_keeps_the_source_and_replaces_its_chunks(spark):
    base = {"kbs": kbs(spark, "kb")}
    tables = ingest.append_ingested(base, ingested(spark, size=1, overlap=0))
    ids = tables["sources"].filter("source_id = 's1'").select("source_id")
    fresh = contents(spark, ("s1", "kb", "new"), ("s2", "kb", "ignored"))
    after = ingest.refresh_sources(tables, ids, fresh, now())
    assert [r.content for r in after["chunks"].collect()] == ["new"]
    assert after["vectors"].count() == 1 and after["sources"].count() == 3
    assert after["pages"].count() == 2
    again = ingest.append_ingested(tables, ingested(spark, size=1, overlap=0))
    assert again["chunks"].count() == tables["chunks"].count()


def test_remove_sources_keeps_pages(spark):
    tables = ingest.append_ingested({"kbs": kbs(spark, "kb")}, ingested(spark))
    ids = tables["sources"].filter("source_id = 's1'").select("source_id")
    out = lifecycle.remove_sources(tables, ids)
    assert {n: out[n].count() for n in ("sources", "chunks", "vectors", "pages", "page_sources")} == {
        "sources": 2, "chunks": 0, "vectors": 0, "pages": 2, "page_sources": 1,
    }
    with pytest.raises(ValueError, match="source not found: zz"):
        lifecycle.remove_sources(tables, ids.withColumn("source_id", F.lit("zz")))


def test_delete_kb_reaches_every_table(spark):
    tables = ingest.append_ingested({"kbs": kbs(spark, "kb", "other")}, ingested(spark))
    out = lifecycle.delete_kb(tables, kbs(spark, "kb"))
    assert {n: df.count() for n, df in out.items()} == {
        "kbs": 1, "sources": 0, "chunks": 0, "vectors": 0, "pages": 0, "page_sources": 0, "run_events": 0,
    }


def events(spark, *rows):
    return spark.createDataFrame(
        [
            (run, "kb", None, i, phase, status, T0 + datetime.timedelta(minutes=40 * i), f"e{i}")
            for i, (run, phase, status) in enumerate(rows)
        ],
        RUN_EVENTS,
    )


LOG = [
    ("a", "initialize", "running"),
    ("b", "chunk", "running"),  # bad start
    ("a", "initialize", "completed"),
    ("a", "read_source", "running"),
    ("a", "read_source", "failed"),
    ("a", "chunk", "running"),  # a failed phase is only retried
    ("a", "read_source", "running"),
    ("a", "chunk", "completed"),  # another phase cannot complete
]


@pytest.mark.parametrize("stretch", [2, 3, 256])
def test_violations_do_not_depend_on_the_stretch(spark, stretch):
    found = runs.invalid_transitions(events(spark, *LOG), stretch).orderBy("seq").collect()
    # a refused event leaves the run where it was, so the retry after it is in order
    assert [(r.run_id, r.seq, r.prev_phase, r.prev_status) for r in found] == [
        ("b", 1, None, None), ("a", 5, "read_source", "failed"), ("a", 7, "read_source", "running"),
    ]


def test_a_long_run_is_judged_as_one_by_one(spark):
    rng = random.Random(6)
    states = [(p, s) for p in PHASES for s in ("pending", "running", "completed", "failed")]
    log, old = [], None
    for i in range(1500):
        moves = [s for s in states if allowed(old, s)]
        new = rng.choice(moves if moves and rng.random() < 0.7 else states)
        old = new if allowed(old, new) else old
        log.append(("r" if i % 5 else "q", *new))
    want, now_in = [], {}
    for i, (run, *new) in enumerate(log):
        old, new = now_in.get(run), tuple(new)
        if allowed(old, new):
            now_in[run] = new
        else:
            want.append((i, *(old or (None, None))))
    df = events(spark, *log)
    for stretch in (7, 100):
        found = runs.invalid_transitions(df, stretch).orderBy("seq").collect()
        assert [(r.seq, r.prev_phase, r.prev_status) for r in found] == want
    judged = runs.judged_events(df, 64)
    assert judged.count() == len(log) and judged.columns == [*df.columns, "accepted", "prev_phase", "prev_status"]
    assert runs.invalid_transitions(df.limit(0)).count() == 0


def test_status_of_runs(spark):
    rows = {r.run_id: r for r in runs.run_status(events(spark, *LOG[:5])).collect()}
    assert (rows["a"].phase, rows["a"].status, rows["a"].error) == ("read_source", "failed", "e4")
    assert rows["a"].completed_at is None and rows["a"].started_at == T0
    done = runs.run_status(events(spark, *LOG[:3])).filter("run_id = 'a'").first()
    assert done.completed_at is not None and done.error is None


def test_allowed_moves():
    assert allowed(None, ("initialize", "running"))
    assert not allowed(None, ("embed", "running"))
    assert allowed(("embed", "completed"), ("integrate_wiki", "running"))
    assert not allowed(("finalize", "completed"), ("initialize", "running"))
    assert not allowed(("embed", "pending"), ("embed", "running"))


def test_run_stream_refuses_and_resumes(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    arrive = tmp_path / "in"
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    for part in (LOG[:5], LOG[5:]):
        offset = 0 if part is not LOG[5:] and part[0] == LOG[0] else 5
        batch = events(spark, *part).withColumn("seq", F.col("seq") + offset)
        batch = batch.withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(offset)))
        batch.write.mode("append").parquet(str(arrive))
        store_run_states(stream_run_events(spark, str(arrive)), out, log).awaitTermination()
    rows = {r.seq: r for r in spark.read.parquet(out).collect()}
    assert [rows[i].accepted for i in range(8)] == [True, False, True, True, True, False, True, False]
    assert (rows[7].state_phase, rows[7].state_status) == ("read_source", "running")


def test_a_run_is_judged_over_several_frames():
    import pandas as pd

    from lorespark.streaming.runs import judge

    class State:
        exists, get = True, ("initialize", "running")

        def update(self, value):
            self.new = value

    rows = [(3, "read_source", "running", 30), (1, "initialize", "completed", 10), (2, "chunk", "running", 10), (4, "x", None, 40)]
    frames = [pd.DataFrame(part, columns=["seq", "phase", "status", "_at"]) for part in (rows[:2], rows[2:])]
    state = State()
    (out,) = judge(("r",), iter(frames), state)
    assert out["seq"].tolist() == [1, 2, 3, 4] and out["accepted"].tolist() == [True, False, True, False]
    assert state.new == ("read_source", "running") and out["state_phase"].tolist()[1] == "initialize"


def test_ingest_stream_equals_batch_and_replaces(spark, tmp_path):
    arrive, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    first = contents(spark, ("s1", "kb", "a b c d e"), ("s2", "kb", "x y"))
    second = contents(spark, ("s1", "kb", "only this"))
    for batch in (first, second):
        batch.write.mode("append").parquet(arrive)
        ingest_stream(stream_contents(spark, arrive), out, log, size=2, overlap=0).awaitTermination()
    want = ingest.chunk_contents(first.filter("source_id = 's2'").union(second), 2, 0)
    got = latest_chunks(spark, out).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def views(spark, *titles):
    rows = [
        (f"p{i}", "kb", t, f"body {i}", "entity", ["x"] if i == 0 else [], T0 + datetime.timedelta(minutes=i), T0 + datetime.timedelta(days=i))
        for i, t in enumerate(titles)
    ]
    pages = spark.createDataFrame(rows, PAGES)
    return wiki.page_view(pages, spark.createDataFrame([], LINKS), spark.createDataFrame([("p0", "s1")], PAGE_SOURCES))


def test_export_writes_files_and_keeps_colliding_titles_apart(spark, tmp_path):
    plan = export.export_plan(views(spark, "My Page", "my_page!", "Other"))
    for _ in range(2):
        export.write_markdown(plan, str(tmp_path))
    files = {p.name: p.read_text(encoding="utf-8") for p in (tmp_path / "kb").iterdir()}
    assert sorted(files) == ["my-page--p1.md", "my-page.md", "other.md"]
    assert files["my-page.md"] == (
        "---\nid: p0\ntitle: My Page\npage_type: entity\ntags:\n  - x\n"
        "created_at: 2024-01-01T00:00:00+00:00\nupdated_at: 2024-01-01T00:00:00+00:00\n"
        "sources:\n  - s1\n---\nbody 0\n"
    )
    assert "tags:\n  []\n" in files["other.md"] and "sources:\n  []\n" in files["other.md"]


def test_parts_of_a_large_view_get_files_of_their_own(spark):
    pages = views(spark, "Hub", "Small").drop("part", "source_ids", "inbound", "outbound")
    refs = spark.range(300).select(F.lit("p0").alias("page_id"), F.col("id").cast("string").alias("source_id"))
    view = wiki.page_view(pages, spark.createDataFrame([], LINKS), refs, part_rows=100)
    rows = {r.path: r.text for r in export.export_plan(view).collect()}
    assert sorted(rows) == ["kb/hub--part-2.md", "kb/hub--part-3.md", "kb/hub.md", "kb/small.md"]
    listed = [x for t in rows.values() for x in t.split("sources:\n")[1].split("---")[0].split("\n") if x.startswith("  - ")]
    assert sorted(listed) == sorted(f"  - {i}" for i in range(300))


def test_incremental_export(spark):
    v = views(spark, "A", "B", "C")
    since = F.lit("2024-01-02 00:00:00").cast("timestamp")
    assert sorted(r.title for r in export.export_since(v, since).collect()) == ["B", "C"]
    assert export.export_since(v).count() == 3


def test_numbering_equals_row_number_on_one_hot_group(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 50 == 0, F.concat(F.lit("g"), F.col("id") % 7)).otherwise(F.lit("hot")).alias("g"),
        F.lit("same").alias("title"),
        F.col("id").alias("id"),
    )
    got = {(r.g, r.id): r.n for r in numbered(df, ["g"], ["title", "id"], "n").collect()}
    want, seen = {}, {}
    for g, i in sorted(got):
        seen[g] = seen.get(g, 0) + 1
        want[g, i] = seen[g]
    assert got == want


def test_bounded_parts_split_only_hot_groups(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 990, "hot").otherwise("cold").alias("g"), "id")
    sizes = {(r.g, r.part): r["count"] for r in bounded_parts(df, ["g"], "id", 100).groupBy("g", "part").count().collect()}
    assert sizes["cold", 0] == 10 and len(sizes) == 11 and max(sizes.values()) < 200


def test_durable_keeps_schema_and_rows(spark):
    df = ingested(spark).chunks
    stored = durable(df)
    assert stored.schema.simpleString() == df.schema.simpleString() and stored.count() == 1


def test_stream_keeps_parts_of_several_batches(spark, tmp_path):
    arrive, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    rows = [("s1", 0, "a b", {}), ("s1", 1, "c d", {}), ("s1", 1, "e f", {}), ("s2", 0, "x", {}), ("s2", 1, "y", {})]
    rows.append(("s2", 0, "z", {"ingest_version": "2"}))
    for source, part, text, metadata in rows:
        batch = spark.createDataFrame([(source, "kb", part, text, metadata)], CONTENTS)
        batch.write.mode("append").parquet(arrive)
        ingest_stream(stream_contents(spark, arrive), out, log, size=5, overlap=0).awaitTermination()
    got = latest_chunks(spark, out).select("source_id", "part", "content").collect()
    assert {(r.source_id, r.part, r.content) for r in got} == {("s1", 0, "a b"), ("s1", 1, "e f"), ("s2", 0, "z")}


def test_stream_of_emptied_sources_new_checkpoints_and_halves(spark, tmp_path):
    arrive, out, vec = (str(tmp_path / n) for n in ("in", "out", "vec"))

    def deliver(log, *rows):
        spark.createDataFrame([(s, "kb", 0, t, m) for s, t, m in rows], CONTENTS).write.mode("append").parquet(arrive)
        ingest_stream(stream_contents(spark, arrive), out, str(tmp_path / log), vec, size=5, overlap=0).awaitTermination()
        shown = {(r.source_id, r.content) for r in latest_chunks(spark, out).collect()}
        assert sorted(r.document for r in latest_vectors(spark, out, vec).collect()) == sorted(c for _, c in shown)
        return shown

    assert deliver("log", ("s1", "a b", {}), ("s2", "x", {})) == {("s1", "a b"), ("s2", "x")}
    assert deliver("log", ("s1", "", {"ingest_version": "3"})) == {("s2", "x")}
    # A new checkpoint reads all files again and stores them behind the others.
    assert deliver("log2", ("s3", "new", {})) == {("s2", "x"), ("s3", "new")}
    # Chunks of a batch that was not finished stay unseen and are overwritten by the next.
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir() if "=" in p.name)
    half = spark.read.parquet(f"{out}/batch={last}").withColumn("content", F.lit("half"))
    half.write.parquet(f"{out}/batch={last + 1}")
    assert {(r.source_id, r.content) for r in latest_chunks(spark, out).collect()} == {("s2", "x"), ("s3", "new")}
    assert deliver("log2", ("s3", "newer", {})) == {("s2", "x"), ("s3", "newer")}


def test_path_part_stays_in_its_folder(spark):
    names = spark.createDataFrame([("kb_1",), ("../x",), ("..-x",)], "name string")
    got = [r[0] for r in names.select(export.path_part(F.col("name"))).collect()]
    assert got[0] == "kb_1" and len(set(got)) == 3 and not any("/" in g or "." in g for g in got)
