"""Gradients against finite differences, held-out results, and odd rows."""

import numpy as np
import pytest

from lorespark.llm import gru, labelled, language, quality, toxicity

FOLDER = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "1 2 3!"), (5, "the and of " * 60_000), (6, "x" * 300_000), (7, "same"), (7, "same"), (None, "été")]
SCHEMA = "doc_id long, text string, score string, lang_pred int, held_out int"


def odd_rows(spark):
    return spark.createDataFrame([(*r, "s", 1, 2) for r in ODD], SCHEMA)


def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def agree(loss, pairs, rng, step=1e-2):
    """Gradients against central differences at a dozen places of each array."""
    for array, grad in pairs:
        for at in [tuple(rng.integers(0, s) for s in array.shape) for _ in range(12)]:
            old = array[at]
            array[at] = old + step
            up = loss()
            array[at] = old - step
            down = loss()
            array[at] = old
            assert grad[at] == pytest.approx((up - down) / (2 * step), abs=3e-2, rel=3e-2)


def test_way_back_agrees_with_differences():
    rng = np.random.default_rng(1)
    p = {"ahead": gru.small(rng, 9, 3), "behind": gru.small(rng, 9, 3)}
    inputs = [rng.standard_normal((5, 9, 4)).astype(np.float32) for _ in range(2)]
    mask = np.ones((5, 4), np.float32)
    mask[3:, 1] = 0
    pull = rng.standard_normal((5, 6, 4)).astype(np.float32)
    loss = lambda: float((gru.both(inputs[0], inputs[1], p, mask).astype(np.float64) * pull).sum())
    tape = {}
    gru.both(inputs[0], inputs[1], p, mask, tape)
    d_ahead, d_behind, grads = gru.both_back(pull, p, tape)
    agree(loss, ((inputs[0], d_ahead), (inputs[1], d_behind), (p["ahead"], grads["ahead"]), (p["behind"], grads["behind"])), rng)


def test_language_of_held_out_rows(spark):
    docs, _ = tables(spark)
    rows = language.language_query(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and 100 < len(held) < 400
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    odd = {(r.doc_id, r.lang_pred, 0 <= r.score <= 1) for r in language.identify(odd_rows(spark), docs).collect()}
    assert {(i, "und", True) for i in (1, 2, 3, 4)} <= odd and all(ok for *_, ok in odd)
    none = language.identify(docs.select("doc_id", "text").limit(3), docs.limit(0)).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert language.identify(docs.limit(0), docs).count() == 0


@pytest.mark.parametrize("query, label, least", [(toxicity.toxicity_query, "toxic", 0.93), (quality.quality_query, "quality", 0.95)])
def test_held_out_labels(spark, query, label, least):
    docs, labels = tables(spark)
    rows = {r.doc_id: r for r in query(docs, labels).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows.values())
    held = [(rows[r.doc_id], r[label]) for r in labels.collect() if rows[r.doc_id].held_out]
    assert len(held) > 40 and np.mean([r.predicted == y for r, y in held]) > least


@pytest.mark.parametrize("score, label", [(toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")])
def test_odd_rows_and_labels(spark, score, label):
    docs, labels = tables(spark)
    known = labels.select("doc_id", labels[label].alias("label"))
    got = score(odd_rows(spark), docs, known)
    assert [c for c in got.columns if c != "score"] == ["doc_id", "text", "lang_pred", "held_out"]
    rows = got.collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert score(docs.limit(0), docs, known).count() == 0
    assert {round(r.score, 6) for r in score(docs.limit(3), docs, known.limit(0)).collect()} == {0.0}
    one_class = score(docs.limit(3), docs, known.filter("label = 1")).collect()
    assert all(r.score > 0.99 for r in one_class)


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_labels_other_than_zero_and_one_are_unknown(spark, score):
    docs = tables(spark)[0].limit(40)
    rows = docs.select("doc_id").collect()
    known = spark.createDataFrame([(r.doc_id, i % 2) for i, r in enumerate(rows[:20])], "doc_id long, label int")
    odd = spark.createDataFrame([(r.doc_id, (-1, 2, 7, None)[i % 4]) for i, r in enumerate(rows[20:])], known.schema)
    shown = lambda labels: sorted((r.doc_id, r.score) for r in score(docs, docs, labels).collect())
    assert shown(known.unionByName(odd)) == shown(known)
    assert max(x for _, x in shown(odd)) < 1e-6


def test_toxic_rows_go(spark):
    docs, labels = tables(spark)
    left = toxicity.drop_toxic(docs, docs, labels)
    assert left.columns == docs.columns and 0.7 * docs.count() < left.count() < docs.count()


def test_long_texts_score_like_short_blocks(monkeypatch):
    samples = [("good fine text here " * 20, 0), ("bad awful words here " * 20, 1)] * 4
    vocabulary, p = toxicity.train(samples, steps=20)
    text = " ".join(["good", "fine", "bad", "text"][i * i % 4] for i in range(5000))
    whole = toxicity.document_scores(vocabulary, p, [text])
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 400)
    assert toxicity.document_scores(vocabulary, p, [text])[0] == pytest.approx(whole[0], abs=1e-5)
    weights = quality.train(samples, steps=20)
    whole = quality.document_scores(weights, [text])
    monkeypatch.setattr(quality, "BLOCK_PASSAGES", 4)
    assert quality.document_scores(weights, [text])[0] == pytest.approx(whole[0], abs=1e-6)


def test_blocks_do_not_show_in_passages(monkeypatch):
    rng = np.random.default_rng(3)
    words = [b"one", b"two", b"three", b"x" * 700, b"", "\u00e9t\u00e9".encode()]
    texts = [np.frombuffer(b" ".join(words[i] for i in rng.integers(0, 6, n)), np.uint8) for n in (0, 1, 40, 3000)]
    texts.append(np.frombuffer(b"a " * 1024, np.uint8))
    whole = np.vstack(list(quality.feature_blocks(texts)))
    monkeypatch.setattr(quality, "BLOCK_PASSAGES", 1)
    assert np.array_equal(np.vstack(list(quality.feature_blocks(texts))), whole)
    at = 0
    for data in texts:
        text = bytes(data)
        for a in range(0, max(1, len(text)), 512):
            pairs = [(text[i - 1], text[i]) for i in range(max(1, a), min(len(text), a + 512))]
            assert np.expm1(whole[at, :-2]).sum() == pytest.approx(len(pairs), abs=1e-2)
            if pairs:
                kinds = [quality.KINDS[x] * quality.CLASSES + quality.KINDS[y] for x, y in pairs]
                assert np.expm1(whole[at, kinds[0]]) == pytest.approx(kinds.count(kinds[0]), abs=1e-3)
            assert np.expm1(whole[at, -1]) == pytest.approx(len(text[a : a + 512]), abs=1e-2)
            at += 1
    assert at == len(whole)


def squash(x):
    return 1 / (1 + np.exp(-x))


def layer(inputs, weights):
    """One direction of the recurrent layer, step by step in double precision."""
    size, state, out = weights.shape[1], np.zeros(weights.shape[1]), []
    for x in inputs:
        turned = weights.astype(float) @ state
        reset, update = (np.clip((x[i * size : (i + 1) * size] + turned[i * size : (i + 1) * size]) / 4 + 0.5, 0, 1) for i in (0, 1))
        new = np.tanh(turned[2 * size :] * reset + x[2 * size :])
        state = state + update * (new - state)
        out.append(state)
    return np.array(out)


def test_toxicity_agrees_with_single_windows():
    samples = [("good fine text here and more " * 30, 0), ("bad awful words here and more " * 9, 1)] * 5
    vocabulary, p = toxicity.train(samples, steps=15)
    rng = np.random.default_rng(5)
    words = ["good", "fine", "bad", "text", "unseen", "awful", "\u00e9t\u00e9"]
    for n in (1, 5, 48, 49, 200):
        line = [words[i] for i in rng.integers(0, len(words), n)]
        found = []
        for start in range(0, max(1, n - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
            rows = []
            for w in line[start : start + toxicity.WINDOW]:
                data = b"\x02" + w.encode() + b"\x03"
                codes = []
                for size in toxicity.GRAMS:
                    for k in range(len(data) - size + 1):
                        code = np.int64(0)
                        for byte in data[k : k + size]:
                            with np.errstate(over="ignore"):
                                code = code * np.int64(0x100000001B3) + np.int64(byte)
                        with np.errstate(over="ignore"):
                            codes.append(int((code ^ code >> np.int64(29)) * np.int64(0x9E3779B97F4A7C1) >> np.int64(40) & np.int64(toxicity.CHAR_ROWS - 1)))
                rows.append(np.r_[p["words"][vocabulary.get(w, 0)], p["chars"][codes].astype(float).mean(0)])
            ahead = layer(np.array(rows) @ p["in_ahead"] + p["bias_ahead"], p["ahead"])
            behind = layer(np.array(rows[::-1]) @ p["in_behind"] + p["bias_behind"], p["behind"])[::-1]
            states = np.hstack((ahead, behind))
            weight = np.exp(np.tanh(states @ p["attend"].T) @ p["focus"])
            found.append(p["out"] @ (weight / weight.sum() @ states) + p["bias"][0])
        assert toxicity.document_scores(vocabulary, p, [" ".join(line)])[0] == pytest.approx(squash(max(found)), abs=1e-4)


def test_worst_window_is_the_highest(monkeypatch):
    monkeypatch.setattr(toxicity, "ROWS", 3)
    vocabulary, p = toxicity.train([("good fine text " * 30, 0), ("bad awful words " * 30, 1)] * 4, steps=10)
    inputs = np.vstack((toxicity.word_inputs(p, np.arange(6) % (len(vocabulary) + 1), list("abcdef")), np.zeros((1, 16), np.float32)))
    lines = [np.random.default_rng(n).integers(0, 6, n) for n in (3, 500, 48, 60, 300)]
    top = toxicity.worst_windows(p, inputs, lines)
    for line, column in zip(lines, top.T):
        each = [line[s : s + toxicity.WINDOW] for s in toxicity.windows(len(line))]
        scores = [toxicity.score_windows(p, inputs, w[:, None])[0] for w in each]
        assert list(column[column < 6]) == list(each[int(np.argmax(scores))])


def test_toxicity_gradients():
    rng = np.random.default_rng(7)
    p = toxicity.train([("good fine text here " * 9, 0), ("bad awful words here " * 9, 1)] * 4, steps=3)[1]
    inputs = np.vstack((rng.standard_normal((9, 16)), np.zeros((1, 16)))).astype(np.float32)
    index = rng.integers(0, 9, (6, 4))
    index[4:, 1] = 9
    pull = rng.standard_normal(4).astype(np.float32)
    tape = {}
    toxicity.score_windows(p, inputs, index, tape)
    grads, d_inputs = toxicity.gradients(p, tape, pull)
    loss = lambda: float(toxicity.score_windows(p, inputs, index).astype(np.float64) @ pull)
    agree(loss, [(p[k], grads[k]) for k in ("attend", "focus", "out", "in_ahead", "in_behind", "bias_ahead")] + [(inputs[:-1], d_inputs)], rng)


def test_quality_gradients_and_single_texts(monkeypatch):
    rng = np.random.default_rng(9)
    samples = [("good fine text here. " * 90, 0), ("BAD words!! here " * 90, 1), ("", 0), ("x", 1)]
    p = quality.train(samples, steps=10)
    texts, label = [quality.as_bytes(t) for t, _ in samples], np.array([y for _, y in samples])
    monkeypatch.setattr(quality, "BLOCK_PASSAGES", 3)
    _, grads = quality.gradients(p, texts, label)
    agree(lambda: quality.gradients(p, texts, label)[0], [(p[k], grads[k]) for k in ("see", "let", "focus", "out", "bias", "encode_bias")], rng)
    for text, _ in samples:
        features = np.vstack(list(quality.feature_blocks([quality.as_bytes(text)]))).astype(float)
        codes = np.tanh(features @ p["encode"] + p["encode_bias"])
        weight = np.exp(np.tanh(codes @ p["see"]) * squash(codes @ p["let"]) @ p["focus"])
        said = (weight / weight.sum()) @ codes @ p["out"] + p["bias"][0]
        assert quality.document_scores(p, [text, None])[0] == pytest.approx(squash(said), abs=1e-5)


def test_language_agrees_with_single_windows():
    names, p = language.train([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("", "en")] * 3, steps=15)
    text = "the Hund " * 40
    data = text.encode()
    found = []
    for start in range(0, len(data), language.WINDOW):
        part = list(data[start : start + language.WINDOW])
        ahead = layer(p["in_ahead"][part], p["ahead"])
        behind = layer(p["in_behind"][part[::-1]], p["behind"])[::-1]
        scores = np.hstack((ahead, behind)) @ p["out"].T + p["bias"]
        weight = np.exp(scores - scores.max(1, keepdims=True))
        found.append(weight / weight.sum(1, keepdims=True))
    assert names == ["de", "en"]
    assert language.document_probabilities(p, [text])[0] == pytest.approx(np.vstack(found).mean(0), abs=1e-4)


def test_sample_is_whole_texts_bounded_in_rows_and_bytes(spark):
    rows = [(i, f"text {i} " * (1 + i % 7)) for i in range(60)] + [(5, f"another {i}") for i in range(500)] + [(5, "text 5 " * 6)] * 200
    docs = spark.createDataFrame([*rows, (7, None), (8, "long " * 9000)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 3 + [(61, 1), (None, 0), (9, None)], "doc_id long, label int")
    whole = {(t, i % 2) for i, t in [*rows, (8, "long " * 9000)]}
    every = labelled.sample_texts(docs, labels, 1000)
    assert set(every) == whole and len(every) == len(whole)
    few = labelled.sample_texts(docs, labels, 20, 400)
    assert set(few) <= whole and few == labelled.sample_texts(docs.repartition(2), labels, 20, 400)
    for label in (0, 1):
        mine = [t for t, y in few if y == label]
        assert 1 <= len(mine) <= 20 and sum(len(t) for t in mine) <= 400
    assert labelled.sample_texts(docs.limit(0), labels, 20) == []
