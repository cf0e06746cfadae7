"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of bytes and labels every position; a document's probabilities are the
mean of those of its positions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lorespark.llm.gru import Adam, Params, both, both_back, small
from lorespark.llm.labelled import remainder, sample_texts

UNKNOWN = "und"
UNITS = 8
WINDOW = 128
ROWS = 2048
STEPS = 160
TRAIN_WINDOW = 64
PER_LANGUAGE = 300
LETTER = re.compile(r"[^\W\d_]")


def cut(data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in consecutive windows, one per column, and where there are bytes."""
    n = max(1, -(-len(data) // window))
    padded = np.zeros(n * window, np.uint8)
    padded[: len(data)] = data
    return padded.reshape(n, window).T, (np.arange(n * window) < len(data)).reshape(n, window).T


def position_probabilities(p: Params, symbols: np.ndarray, mask: np.ndarray, tape: dict | None = None) -> np.ndarray:
    """``(T, languages, B)`` for bytes ``(T, B)``."""
    states = both(
        np.take(p["in_ahead"], symbols, axis=0).transpose(0, 2, 1),
        np.take(p["in_behind"], symbols, axis=0).transpose(0, 2, 1),
        p, mask.astype(np.float32), tape,
    )
    scores = np.matmul(p["out"], states)
    scores += p["bias"][:, None]
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    if tape is not None:
        tape["states"] = states
    return scores


def train(samples: list[tuple[str, str]], steps: int = STEPS, seed: int = 7) -> tuple[list[str], Params]:
    """Languages and weights, learned from ``(text, language)`` by cross entropy at every position."""
    names = sorted({language for _, language in samples})
    rng = np.random.default_rng(seed)
    p: Params = {
        "in_ahead": small(rng, 256, 3 * UNITS), "in_behind": small(rng, 256, 3 * UNITS),
        "ahead": small(rng, 3 * UNITS, UNITS), "behind": small(rng, 3 * UNITS, UNITS),
        "out": small(rng, max(1, len(names)), 2 * UNITS), "bias": np.zeros(max(1, len(names)), np.float32),
    }
    if len(names) < 2:
        return names, p
    texts = [(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), names.index(language)) for text, language in samples]
    flat, owner = np.concatenate([*(data for data, _ in texts), np.zeros(1, np.uint8)]), np.array([c for _, c in texts])
    ends = np.cumsum([len(data) for data, _ in texts])
    begins = ends - [len(data) for data, _ in texts]
    counts = np.maximum(1, -(-(ends - begins) // TRAIN_WINDOW))
    by_class = [np.flatnonzero(owner == c) for c in range(len(names))]
    adam, rows = Adam(p, 0.02), 192
    for step in range(steps):
        # Texts alike, of each any of its windows alike.
        pick = np.concatenate([rng.choice(c, -(-rows // len(names))) for c in by_class])
        place = begins[pick] + TRAIN_WINDOW * rng.integers(0, counts[pick]) + np.arange(TRAIN_WINDOW)[:, None]
        there = place < ends[pick]
        here = np.where(there, flat[np.minimum(place, len(flat) - 1)], 0)
        tape: dict = {}
        grad = position_probabilities(p, here, there, tape)
        grad[:, owner[pick], np.arange(len(pick))] -= 1
        grad *= (there / np.float32(max(1, there.sum())))[:, None]
        d_states = np.matmul(p["out"].T, grad).astype(np.float32)
        d_ahead, d_behind, grads = both_back(d_states, p, tape)
        grads["out"] = np.einsum("tcb,thb->ch", grad, tape["states"]).astype(np.float32)
        grads["bias"] = grad.sum((0, 2)).astype(np.float32)
        for name, d in (("in_ahead", d_ahead), ("in_behind", d_behind)):
            grads[name] = np.zeros_like(p[name])
            np.add.at(grads[name], here.ravel(), d.transpose(0, 2, 1).reshape(-1, 3 * UNITS))
        adam.step(grads, 0.02 * (1 - 0.9 * step / steps))
    return names, p


def document_probabilities(p: Params, texts: list[str]) -> np.ndarray:
    """Mean over all positions of each text, ``(documents, languages)``; windows run in batches."""
    total = np.zeros((len(texts), len(p["bias"])))
    sizes = np.ones(len(texts))
    held: list[np.ndarray] = []
    seen: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    waiting = 0

    def flush() -> None:
        nonlocal waiting
        symbols, mask, owner = np.hstack(held), np.hstack(seen), np.concatenate(owners)
        for start in range(0, symbols.shape[1], ROWS):
            part = slice(start, start + ROWS)
            here = mask[:, part]
            scores = position_probabilities(p, np.ascontiguousarray(symbols[:, part]), here)
            scores *= here[:, None]
            np.add.at(total, owner[part], scores.sum(0).T)
        held.clear(), seen.clear(), owners.clear()
        waiting = 0

    for i, text in enumerate(texts):
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        sizes[i] = max(1, len(data))
        symbols, mask = cut(data, WINDOW)
        held.append(symbols), seen.append(mask), owners.append(np.full(symbols.shape[1], i))
        waiting += symbols.shape[1]
        if waiting >= 4 * ROWS:
            flush()
    if held:
        flush()
    return total / sizes[:, None]


def identify(docs: DataFrame, training: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``docs`` with ``lang_pred, score``, learned from ``training(doc_id, text, lang)``.

    Up to ``per_language`` texts of each language are learned from, any window of them
    (``sample_texts`` bounds their bytes); every byte of every text is
    scored. A text that is null or has no letter is ``und`` with score 0, and so is every text if
    no row of ``training`` has a language. Columns of these two names are replaced.
    """
    labels = training.select("doc_id", F.col("lang").alias("label"))
    names, p = train(sample_texts(training, labels, per_language))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            known = [i for i, t in enumerate(texts) if names and isinstance(t, str) and LETTER.search(t)]
            found = document_probabilities(p, [texts.iloc[i] for i in known]) if known else np.zeros((0, 1))
            language = np.full(len(texts), UNKNOWN, object)
            best = np.zeros(len(texts))
            if known:
                language[known] = np.array(names, object)[found.argmax(1)]
                best[known] = np.clip(found.max(1), 0, 1)
            yield pd.DataFrame({"lang_pred": language, "score": best})

    kind = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    plain = docs.drop("lang_pred", "score")
    scored = plain.withColumn("_language", F.pandas_udf(score, kind)("text"))
    return scored.select(*plain.columns, "_language.*")


def language_query(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; every fourth fold of the ids is held out."""
    fold = remainder(F.col("doc_id"), 4) == 2
    rows = docs.select("doc_id", "text")
    found = identify(rows, docs.select("doc_id", "text", "lang").filter(~fold))
    return found.select("doc_id", fold.alias("held_out"), "lang_pred", "score")
