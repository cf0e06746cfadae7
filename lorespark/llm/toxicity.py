"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters by an embedding of its own, if training met it often enough, and by the mean of the
embeddings of its runs of 3 and 5 bytes. Overlapping windows of words are scored one by one; a
document is as toxic as its worst window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lorespark.llm.gru import Adam, Params, both, both_back, sigmoid, small
from lorespark.llm.labelled import label_odds, remainder, sample_texts, zero_or_one

WORDS = re.compile(r"\w+")
WORD_DIMS = CHAR_DIMS = 8
CHAR_ROWS = 1 << 14
GRAMS = (3, 5)
LEAST_MET = 3
FORGET = 0.3
DECAY = 1e-4
UNITS = 8
ATTENTION = 8
WINDOW, STRIDE = 48, 32
ROWS = 2048
BLOCK_WORDS = 1 << 15
GRAM_WORDS = 1 << 12
TEXTS = 512
STEPS = 160
PICKED = 20
PER_CLASS = 1000


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word number and table row of each run of 3 and of 5 bytes of each word, marked at both ends."""
    data = ("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-8", "replace")
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    word = np.cumsum(b == 2) - 1
    owners, rows = [], []
    for n in GRAMS:
        size = max(0, len(b) - n + 1)
        code = np.zeros(size, np.int64)
        for k in range(n):
            code = code * 0x100000001B3 + b[k : k + size]
        inside = word[:size] == word[n - 1 :][:size]
        owners.append(word[:size][inside])
        rows.append((code[inside] ^ code[inside] >> 29) * 0x9E3779B97F4A7C1 >> 40 & CHAR_ROWS - 1)
    return np.concatenate(owners), np.concatenate(rows)


def gram_means(words: list[str], table: np.ndarray) -> np.ndarray:
    """The mean row of ``table`` over the grams of each word, a bounded number of words at a time."""
    means = np.empty((len(words), table.shape[1]))
    for start in range(0, len(words), GRAM_WORDS):
        some = words[start : start + GRAM_WORDS]
        owner, row = grams(some)
        order = np.argsort(owner, kind="stable")
        count = np.bincount(owner, minlength=len(some))
        # Marked at both ends, each word has a gram at least.
        sums = np.add.reduceat(table[row[order]], np.cumsum(count) - count, axis=0, dtype=np.float64)
        means[start : start + len(some)] = sums / count[:, None]
    return means


def word_inputs(p: Params, own: np.ndarray, words: list[str]) -> np.ndarray:
    return np.hstack((p["words"][own], gram_means(words, p["chars"]))).astype(np.float32)


def evidence(met: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How surely a feature met in ``met (n, 2)`` documents of the labels speaks for label 1.

    The log odds ratio moved towards 0 by its standard error, halved.
    """
    ratio = np.log((met[:, 1] + 0.5) / (sizes[1] + 1)) - np.log((met[:, 0] + 0.5) / (sizes[0] + 1))
    error = np.sqrt((1 / (met + 0.5)).sum(1))
    return 0.5 * np.sign(ratio) * np.maximum(0, np.abs(ratio) - error)


def windows(n: int) -> np.ndarray:
    """Starts of the windows over ``n`` words; the last one reaches the end."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def window_blocks(lines: list[np.ndarray], blank: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All windows of all ``lines`` of word numbers, ``ROWS`` at a time: the line of each, and its
    words ``(T, B)``, filled up with ``blank``."""
    lengths = np.array([len(line) for line in lines])
    flat = np.concatenate([*lines, np.full(WINDOW, blank)])
    offsets = np.cumsum(lengths) - lengths
    starts = [windows(n) for n in lengths]
    counts = [len(s) for s in starts]
    owner = np.repeat(np.arange(len(lines)), counts)
    begin = np.concatenate(starts) + np.repeat(offsets, counts)
    end = np.repeat(offsets + lengths, counts)
    # Windows alike in length run together, so that no step is spent on padding.
    order = np.argsort(np.minimum(end - begin, WINDOW), kind="stable")
    for at in range(0, len(order), ROWS):
        some = order[at : at + ROWS]
        steps = int(min(WINDOW, (end[some] - begin[some]).max()))
        place = begin[some] + np.arange(steps)[:, None]
        yield owner[some], np.where(place < end[some], flat[np.minimum(place, len(flat) - 1)], blank)


def worst_windows(p: Params, inputs: np.ndarray, lines: list[np.ndarray]) -> np.ndarray:
    """The words ``(WINDOW, lines)`` of the window of each line that scores highest."""
    blank = len(inputs) - 1
    best, top = np.full(len(lines), -np.inf), np.full((WINDOW, len(lines)), blank)
    for owner, index in window_blocks(lines, blank):
        scores = score_windows(p, inputs, index)
        order = np.lexsort((-scores, owner))
        first = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
        first = first[scores[first] > best[owner[first]]]
        best[owner[first]] = scores[first]
        top[:, owner[first]] = blank
        top[: len(index), owner[first]] = index[:, first]
    return top


def score_windows(p: Params, inputs: np.ndarray, index: np.ndarray, tape: dict | None = None) -> np.ndarray:
    """A score per window; ``index (T, B)`` points into ``inputs``, whose last row is no word."""
    mask = (index < len(inputs) - 1).astype(np.float32)
    ahead = inputs @ p["in_ahead"] + p["bias_ahead"]
    behind = inputs @ p["in_behind"] + p["bias_behind"]
    states = both(np.take(ahead, index, axis=0).transpose(0, 2, 1), np.take(behind, index, axis=0).transpose(0, 2, 1), p, mask, tape)
    inner = np.tanh(np.matmul(p["attend"], states))
    weight = np.einsum("a,tab->tb", p["focus"], inner) + (mask - 1) * np.float32(1e4)
    weight -= weight.max(0)
    np.exp(weight, out=weight)
    weight *= mask
    weight /= weight.sum(0) + np.float32(1e-9)
    pooled = np.einsum("tb,thb->hb", weight, states)
    if tape is not None:
        tape.update(states=states, inner=inner, weight=weight, pooled=pooled, index=index, inputs=inputs)
    return p["out"] @ pooled + p["bias"][0]


def gradients(p: Params, tape: dict, d_score: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradients of all weights but the embeddings, and of the inputs."""
    states, inner, weight = tape["states"], tape["inner"], tape["weight"]
    grads: Params = {"out": tape["pooled"] @ d_score, "bias": d_score.sum(keepdims=True)}
    d_pooled = np.outer(p["out"], d_score).astype(np.float32)
    d_states = weight[:, None] * d_pooled
    d_weight = np.einsum("hb,thb->tb", d_pooled, states)
    d_weight = weight * (d_weight - (weight * d_weight).sum(0))
    grads["focus"] = np.einsum("tb,tab->a", d_weight, inner)
    d_inner = p["focus"][:, None] * d_weight[:, None] * (1 - inner * inner)
    grads["attend"] = np.einsum("tab,thb->ah", d_inner, states)
    d_states += np.matmul(p["attend"].T, d_inner)
    d_ahead, d_behind, more = both_back(d_states.astype(np.float32), p, tape)
    grads |= more
    d_inputs = np.zeros_like(tape["inputs"])
    used = tape["index"].ravel()
    for name, d in (("ahead", d_ahead), ("behind", d_behind)):
        flat = d.transpose(0, 2, 1).reshape(-1, d.shape[1])
        grads[f"bias_{name}"] = flat.sum(0)
        grads[f"in_{name}"] = tape["inputs"][used].T @ flat
        np.add.at(d_inputs, used, flat @ p[f"in_{name}"].T)
    return grads, d_inputs


def train(
    samples: list[tuple[str, int]], odds: float = 1.0, steps: int = STEPS, seed: int = 11
) -> tuple[dict[str, int], Params]:
    """Vocabulary and weights from ``(text, label)``; labels are of documents, windows have none.

    In each step the worst of all windows of each document stands for it. The first entry of a word's
    embedding starts from how much oftener it is met in documents of label 1, smoothed. Steps see
    as many documents of either label; afterwards the bias moves by the log of the true ``odds``.
    """
    rng = np.random.default_rng(seed)
    numbers: dict[str, int] = {}
    bags: list[tuple[np.ndarray, int]] = []
    for text, label in samples:
        found = (numbers.setdefault(m.group(), len(numbers)) for m in WORDS.finditer(text.lower()))
        line = np.fromiter(found, np.int32)
        if len(line):
            bags.append((line, int(label)))
    names = list(numbers)
    met, met_grams = np.zeros((len(names), 2)), np.zeros((CHAR_ROWS, 2))
    for line, label in bags:
        own_words = np.unique(line)
        met[own_words, label] += 1
        met_grams[np.unique(grams([names[i] for i in own_words])[1]), label] += 1
    sizes = np.bincount([label for _, label in bags], minlength=2)
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(names[i] for i in np.flatnonzero(met.sum(1) >= LEAST_MET)))}
    dims = WORD_DIMS + CHAR_DIMS
    p: Params = {
        "words": 0.1 * small(rng, len(vocabulary) + 1, WORD_DIMS), "chars": 0.1 * small(rng, CHAR_ROWS, CHAR_DIMS),
        "in_ahead": small(rng, dims, 3 * UNITS), "in_behind": small(rng, dims, 3 * UNITS),
        "bias_ahead": np.zeros(3 * UNITS, np.float32), "bias_behind": np.zeros(3 * UNITS, np.float32),
        "ahead": small(rng, 3 * UNITS, UNITS), "behind": small(rng, 3 * UNITS, UNITS),
        "attend": small(rng, ATTENTION, 2 * UNITS), "focus": small(rng, ATTENTION),
        "out": small(rng, 2 * UNITS), "bias": np.zeros(1, np.float32),
    }
    p["words"][0] = 0
    if vocabulary:
        p["words"][1:, 0] = evidence(met[[numbers[w] for w in vocabulary]], sizes)
    p["chars"][:, 0] = evidence(met_grams, sizes)
    by_label = [[line for line, y in bags if y == label] for label in (0, 1)]
    if not all(by_label):
        p["bias"][0] = 30.0 if by_label[1] else -30.0
        p["out"][:] = 0
        return vocabulary, p
    adam = Adam(p)
    for step in range(steps):
        picked = [(by_label[y][i], y) for y in (0, 1) for i in rng.integers(0, len(by_label[y]), PICKED)]
        here, local = np.unique(np.concatenate([line for line, _ in picked]), return_inverse=True)
        words = [names[i] for i in here]
        lines = np.split(local, np.cumsum([len(line) for line, _ in picked])[:-1])
        # Words are forgotten at random, so that their characters are learned from as well.
        own = np.array([vocabulary.get(w, 0) for w in words]) * (rng.random(len(words)) > FORGET)
        inputs = np.vstack((word_inputs(p, own, words), np.zeros((1, dims), np.float32)))
        tape: dict = {}
        top = score_windows(p, inputs, worst_windows(p, inputs, lines), tape)
        label = np.array([y for _, y in picked])
        grads, d_inputs = gradients(p, tape, ((sigmoid(top) - label) / len(label)).astype(np.float32))
        grads["words"] = DECAY * p["words"]
        np.add.at(grads["words"], own, d_inputs[:-1, :WORD_DIMS])
        grads["words"][0] = 0
        grads["chars"] = DECAY * p["chars"]
        owner, row = grams(words)
        np.add.at(grads["chars"], row, (d_inputs[:-1, WORD_DIMS:] / np.bincount(owner)[:, None])[owner])
        adam.step({k: g.astype(np.float32) for k, g in grads.items()}, 0.01 * (1 - 0.9 * step / steps))
    p["bias"] += np.float32(np.log(odds))
    return vocabulary, p


def document_scores(vocabulary: dict[str, int], p: Params, texts: list[str | None]) -> np.ndarray:
    """The sigmoid of each text's highest window score; 0 for texts without words.

    Words are numbered in blocks, so a text of any length is read in bounded memory; the words
    under the overlap are carried from block to block.
    """
    best = np.full(len(texts), -np.inf)
    numbers: dict[str, int] = {}
    stretches: list[tuple[int, np.ndarray]] = []
    waiting = 0

    def flush() -> None:
        nonlocal waiting
        if not stretches:
            return
        inputs = np.vstack((word_inputs(p, np.array([vocabulary.get(w, 0) for w in numbers]), list(numbers)), np.zeros((1, p["in_ahead"].shape[0]), np.float32)))
        of = np.array([i for i, _ in stretches])
        for owner, index in window_blocks([line for _, line in stretches], len(numbers)):
            np.maximum.at(best, of[owner], score_windows(p, inputs, index))
        numbers.clear(), stretches.clear()
        waiting = 0

    def read(owner: int, words: list[str]) -> None:
        nonlocal waiting
        stretches.append((owner, np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))))
        waiting += len(words)
        if waiting >= BLOCK_WORDS:
            flush()

    for i, text in enumerate(texts):
        if not isinstance(text, str):
            continue
        carried: list[str] = []
        found = (m.group() for m in WORDS.finditer(text.lower())) if len(text) > BLOCK_WORDS else iter(WORDS.findall(text.lower()))
        while block := list(islice(found, BLOCK_WORDS)):
            carried += block
            if len(block) == BLOCK_WORDS:
                # The next block goes on with the last window, which this one may have cut short.
                last = int(windows(len(carried))[-1])
                read(i, carried[: last + WINDOW - STRIDE])
                carried = carried[last:]
        if carried:
            read(i, carried)
    flush()
    return sigmoid(best) * (best > -np.inf)


def score_toxicity(docs: DataFrame, training: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), learned from ``training(doc_id, text)`` and ``labels(doc_id, label)``.

    Up to ``per_class`` texts of each label are learned from, every window of them (``sample_texts``
    bounds their bytes). Null texts and texts without words
    score 0, and so does every text if no label is known. A label other than 0 and 1 counts as
    unknown. A column ``score`` is replaced.
    """
    labels = zero_or_one(labels)
    vocabulary, p = train(sample_texts(training, labels, per_class), label_odds(labels))

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            # A few texts at a time become Python strings.
            found = [
                document_scores(vocabulary, p, texts.slice(at, TEXTS).to_pylist())
                for at in range(0, len(texts), TEXTS)
            ]
            yield pa.array(np.concatenate([np.zeros(0), *found]), pa.float64())

    plain = docs.drop("score")
    return plain.withColumn("score", F.arrow_udf(score, DoubleType())("text"))


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``; every fifth fold of the ids is held out."""
    fold = remainder(F.col("doc_id"), 5) == 0
    known = labels.select("doc_id", F.col("toxic").alias("label")).filter(~fold)
    found = score_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "text").filter(~fold), known)
    return found.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, training: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with their columns; repeated rows each."""
    known = labels.select("doc_id", F.col("toxic").alias("label")).filter(remainder(F.col("doc_id"), 5) != 0)
    names = [f"_toxicity_{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    scored = score_toxicity(held, training.select("doc_id", "text"), known).filter(F.col("score") < limit)
    return scored.select(*names).toDF(*docs.columns)
