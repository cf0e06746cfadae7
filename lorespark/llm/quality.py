"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of bytes. Every passage is encoded from how often each pair of
neighbouring byte classes occurs in it; gated attention weights the codes, and the weighted code
is scored. All weights are learned together, from labels of whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lorespark.llm.gru import Adam, Params, sigmoid, small
from lorespark.llm.labelled import label_odds, remainder, sample_texts, zero_or_one

PASSAGE = 512
CLASSES = 40
FEATURES = CLASSES * CLASSES + 2
UNITS = 24
GATES = 12
BLOCK_PASSAGES = 2048
TEXTS = 512
STEPS = 300
PICKED = 32
PER_CLASS = 1000
DECAY = 1e-3


def byte_classes() -> np.ndarray:
    """Letters by case and vowel, digits, blanks, line ends, bytes beyond ASCII; signs each their own."""
    classes = np.zeros(256, np.int64)
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    for c in range(256):
        letter = chr(c).lower() if c < 128 else ""
        if c >= 128:
            classes[c] = 1 if c < 192 else 2
        elif letter.isalpha():
            classes[c] = (3 if letter in "aeiou" else 4) + 2 * chr(c).isupper()
        elif letter.isdigit():
            classes[c] = 7
        elif c == 32:
            classes[c] = 8
        elif c in (10, 13):
            classes[c] = 9
        elif c in signs:
            classes[c] = 10 + signs.index(c) * 30 // len(signs)
    return classes


KINDS = byte_classes()


def repeated_words(data: np.ndarray) -> np.ndarray:
    """Where the words start that repeat the word before, by length and by the sum of their bytes."""
    if not len(data):
        return np.zeros(0, np.int64)
    edges = np.flatnonzero(np.r_[True, data == 32, True])
    sizes, totals = np.diff(edges), np.add.reduceat(np.append(data, np.uint8(0)), edges[:-1], dtype=np.int64)
    again = np.r_[False, (sizes[1:] == sizes[:-1]) & (totals[1:] == totals[:-1])]
    return edges[:-1][again]


def feature_blocks(texts: list[np.ndarray]) -> Iterator[np.ndarray]:
    """One row per passage of ``PASSAGE`` bytes, of one text after the other, a bounded number of
    rows at a time: logarithms of the counts of pairs of classes, how many of its words repeat the
    word before, and its length. Blocks do not show in the rows: pairs and words across their
    borders count like all others."""
    held: list[np.ndarray] = []
    waiting = 0
    for data in texts:
        again = repeated_words(data) // PASSAGE
        passages = max(1, -(-len(data) // PASSAGE))
        for a in range(0, passages, BLOCK_PASSAGES):
            n = min(BLOCK_PASSAGES, passages - a)
            begin, end = a * PASSAGE, min(len(data), (a + n) * PASSAGE)
            # A pair belongs to its second byte, so the byte before the block is read as well.
            first = max(1, begin)
            kinds = KINDS[data[first - 1 : end]]
            owner = np.arange(first, max(first, end)) // PASSAGE - a
            pairs = owner * (CLASSES * CLASSES) + kinds[:-1] * CLASSES + kinds[1:]
            counts = np.bincount(pairs, minlength=n * CLASSES * CLASSES).reshape(n, -1)
            low, high = np.searchsorted(again, (a, a + n))
            features = np.empty((n, FEATURES), np.float32)
            np.log1p(counts, out=features[:, :-2])
            features[:, -2] = np.log1p(np.bincount(again[low:high] - a, minlength=n))
            features[:, -1] = np.log1p(np.clip(len(data) - np.arange(a, a + n) * PASSAGE, 0, PASSAGE))
            held.append(features)
            waiting += n
            if waiting >= BLOCK_PASSAGES:
                yield np.vstack(held)
                held, waiting = [], 0
    if held:
        yield np.vstack(held)


def encode(p: Params, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, the two halves of the gate, and attention scores of passages."""
    codes = np.tanh(features @ p["encode"] + p["encode_bias"])
    seen, let = np.tanh(codes @ p["see"]), sigmoid(codes @ p["let"]).astype(np.float32)
    return codes, seen, let, (seen * let) @ p["focus"]


def attention(scores: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Softmax within the stretches that begin at ``starts``."""
    sizes = np.diff(np.append(starts, len(scores)))
    weight = np.exp(scores - np.repeat(np.maximum.reduceat(scores, starts), sizes))
    return weight / np.repeat(np.add.reduceat(weight, starts), sizes)


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text if isinstance(text, str) else "").encode("utf-8", "replace"), np.uint8)


def first_passages(texts: list[np.ndarray]) -> np.ndarray:
    """The row at which the passages of each text start."""
    sizes = np.array([max(1, -(-len(data) // PASSAGE)) for data in texts])
    return np.cumsum(sizes) - sizes


def pooled_codes(p: Params, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The weighted code of each text, and codes and weights of all passages."""
    starts, parts = first_passages(texts), [encode(p, features) for features in feature_blocks(texts)]
    codes, scores = np.vstack([c for c, *_ in parts]), np.concatenate([s for *_, s in parts])
    weight = attention(scores, starts)
    return np.add.reduceat(codes * weight[:, None], starts), codes, weight


def gradients(p: Params, texts: list[np.ndarray], label: np.ndarray) -> tuple[float, Params]:
    """Mean cross entropy of whole texts, and the gradients of all weights. Passages are encoded
    twice, block by block: once for the weights among all passages of a text, once for the way back."""
    pooled, all_codes, all_weight = pooled_codes(p, texts)
    starts = first_passages(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(all_codes))))
    said = pooled @ p["out"] + p["bias"][0]
    loss = float(np.mean(np.logaddexp(0, said) - label * said))
    d_said = ((sigmoid(said) - label) / len(label)).astype(np.float32)
    grads: Params = {k: np.zeros_like(v) for k, v in p.items()}
    grads["out"], grads["bias"] = pooled.T @ d_said, d_said.sum(keepdims=True)
    d_pooled = np.outer(d_said, p["out"])
    all_d_weight = (d_pooled[owner] * all_codes).sum(1)
    all_d_scores = all_weight * (all_d_weight - np.add.reduceat(all_weight * all_d_weight, starts)[owner])
    at = 0
    for features in feature_blocks(texts):
        part = slice(at, at + len(features))
        at += len(features)
        codes, seen, let, _ = encode(p, features)
        weight, d_scores = all_weight[part], all_d_scores[part]
        grads["focus"] += (seen * let).T @ d_scores
        d_gate = np.outer(d_scores, p["focus"])
        d_seen, d_let = d_gate * let * (1 - seen * seen), d_gate * seen * let * (1 - let)
        grads["see"] += codes.T @ d_seen
        grads["let"] += codes.T @ d_let
        d_codes = d_pooled[owner[part]] * weight[:, None] + d_seen @ p["see"].T + d_let @ p["let"].T
        d_codes *= 1 - codes * codes
        grads["encode"] += features.T @ d_codes
        grads["encode_bias"] += d_codes.sum(0)
    return loss, grads


def train(samples: list[tuple[str, int]], odds: float = 1.0, steps: int = STEPS, seed: int = 13) -> Params:
    """Weights from every passage of ``(text, label)``; steps see as many documents of either label,
    and afterwards the bias moves by the log of the true ``odds``."""
    rng = np.random.default_rng(seed)
    bags: list[list[np.ndarray]] = [[], []]
    for text, label in samples:
        bags[int(label)].append(as_bytes(text))
    p: Params = {
        "encode": (0.02 * rng.standard_normal((FEATURES, UNITS))).astype(np.float32), "encode_bias": np.zeros(UNITS, np.float32),
        "see": small(rng, UNITS, GATES), "let": small(rng, UNITS, GATES), "focus": small(rng, GATES),
        "out": small(rng, UNITS), "bias": np.zeros(1, np.float32),
    }
    if not all(bags):
        p["out"][:] = 0
        p["bias"][0] = 30.0 if bags[1] else -30.0
        return p
    adam = Adam(p, 0.005)
    label = np.repeat((0, 1), PICKED)
    for step in range(steps):
        picked = [bags[y][i] for y in (0, 1) for i in rng.integers(0, len(bags[y]), PICKED)]
        _, grads = gradients(p, picked, label)
        grads["encode"] += DECAY * p["encode"]
        adam.step({k: g.astype(np.float32) for k, g in grads.items()}, 0.005 * (1 - 0.9 * step / steps))
    p["bias"] += np.float32(np.log(odds))
    return p


def document_scores(p: Params, texts: list[str | None]) -> np.ndarray:
    """A score of 0 to 1 per text. Every passage is encoded, in blocks, of which only the codes are held."""
    out = np.empty(len(texts))
    for at in range(0, len(texts), TEXTS):
        some = [as_bytes(text) for text in texts[at : at + TEXTS]]
        pooled = pooled_codes(p, some)[0]
        out[at : at + len(some)] = sigmoid((pooled @ p["out"] + p["bias"][0]).astype(np.float64))
    return out


def score_quality(docs: DataFrame, training: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), learned from ``training(doc_id, text)`` and ``labels(doc_id, label)``.

    Up to ``per_class`` texts of each label are learned from, every passage of them (``sample_texts``
    bounds their bytes). A null text scores like an empty
    one, as a single empty passage; if no label is known, every text scores 0. A label
    other than 0 and 1 counts as unknown. A column ``score`` is replaced.
    """
    labels = zero_or_one(labels)
    p = train(sample_texts(training, labels, per_class), label_odds(labels))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(document_scores(p, list(texts)), dtype="float64")

    plain = docs.drop("score")
    return plain.withColumn("score", F.pandas_udf(score, DoubleType())("text"))


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``; every fifth fold of the ids is held out."""
    fold = remainder(F.col("doc_id"), 5) == 0
    known = labels.select("doc_id", F.col("quality").alias("label")).filter(~fold)
    found = score_quality(docs.select("doc_id", "text"), docs.select("doc_id", "text").filter(~fold), known)
    return found.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
