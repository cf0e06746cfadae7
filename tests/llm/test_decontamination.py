import random

from brute import spark_rows

from lorespark.llm import decontamination as d


def brute(text, items, window):
    words = d.words_of(text)
    hit, names = set(), set()
    for name, item in items:
        w = d.words_of(item)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[j : j + n]:
                    hit |= set(range(i, i + n))
                    names.add(name)
    return len(words), len(hit), sorted(names)


def test_automaton_agrees_with_brute_force():
    rng = random.Random(5)
    for trial in range(150):
        letters = "ab" if trial % 2 else "abcdef"
        make = lambda n: " ".join(rng.choice(letters) for _ in range(n))
        items = [(str(k), make(rng.randrange(0, 12))) for k in range(rng.randrange(1, 6))]
        automaton = d.Automaton([(k, d.words_of(t)) for k, t in items], 4)
        text = make(rng.randrange(0, 60)) + " zz " + make(20)
        spans, names = automaton.match(d.word_ids(text, automaton.ids))
        assert all(a < b for a, b in zip(spans, spans[1:]))
        covered = sum(spans[1::2]) - sum(spans[::2])
        assert brute(text, items, 4) == (len(d.words_of(text)), covered, sorted(names))


def test_parts_pieces_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(d, "PART_WORDS", 30)
    monkeypatch.setattr(d, "PIECE_WORDS", 7)
    rng = random.Random(7)
    word = lambda: rng.choice("the of and to in on it by at as".split())
    items = [(k, " ".join(word() for _ in range(rng.randrange(0, 40)))) for k in range(12)] + [(50, None), (3, "x y")]
    texts = [" ".join(word() for _ in range(200)) for _ in range(6)]
    texts += [items[4][1], "a " + items[5][1].upper() + "! X, y", None, "", "漢字 é"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in d.contamination(docs, bench, 5).collect()}
    want = {i: brute(t, [(str(k), x) for k, x in items], 5) for i, t in enumerate(texts)}
    assert got == {i: (n, h, len(names)) for i, (n, h, names) in want.items()}
    assert d.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert d.contamination(docs.limit(0), bench).count() == 0
    assert sorted(r.doc_id for r in d.decontaminate(docs, bench, 5).collect()) == [i for i, w in want.items() if not w[1]]


def test_spans_are_cut(spark):
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "Keep this. One, two three FOUR five! And this, too; it is long enough to stay here."), (2, "one two three four five"), (3, "clean")],
        "doc_id long, text string",
    )
    got = spark_rows(d.decontaminate(docs, bench, 5, 5, 0.5))
    assert got == [(1, "Keep this. ! And this, too; it is long enough to stay here."), (3, "clean")]


def test_texts_do_not_come_back_from_python(spark, monkeypatch):
    monkeypatch.setattr(d, "BATCH", 2)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d", None, "", "x a b c", "b c"])], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    found = d.find_items(docs, bench, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and plan.count("ArrowEvalPython") == 1
    assert spark_rows(found.select("doc_id", "_n_words", "_spans", "_items")) == [
        (0, 4, [0, 3], ["1"]), (1, 0, [], []), (2, 0, [], []), (3, 4, [1, 4], ["1"]), (4, 2, [], [])
    ]
