"""Periodic runs of words, found on a grammar of the texts.

A block of documents becomes one row of word numbers, which Re-Pair compresses: of all pairs of
neighbours that occur more than once the most frequent is replaced by a new symbol, and in the
same round every other frequent pair wherever no more frequent one overlaps it. What is left of a
document becomes the leaves of a balanced tree. A run lies across the middle of the lowest symbol
or tree node that holds all of it, so the runs across each symbol's middle are computed once, at
one of its places, and copied to all its places; of copies that were cut off at the symbol's edge
the maximal run remains.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.arrays import bind

WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
LEAST_WORDS, LEAST_PERIODS = 6, 4
BLOCK_WORDS = 1 << 17
CANDIDATES = 1 << 20
FOUND = (
    "doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, kept string"
)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...``: ``sizes[i]`` numbers from each start."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def known_rows(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each of ``wanted`` stands in the sorted array ``known``."""
    at = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
    return known[at] == wanted if len(known) else np.zeros(len(wanted), bool)


def repair(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """``rule, start, middle, stop`` of every replaced pair, and ``start, stop`` of what is left.

    ``offsets`` are the borders of the documents in ``words``; no pair crosses one. A pair keeps
    its symbol over all rounds. It ends when no pair occurs twice.
    """
    n = len(words)
    # By the place a symbol starts at; that of the symbol before the first one is -1, the last entry.
    symbol, alive = words.astype(np.int64), np.ones(n, bool)
    stop, before = np.arange(1, n + 1), np.arange(-1, n)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    priority = np.zeros(n + 1, np.int64)
    names = int(words.max(initial=-1)) + 1
    codes, numbers = np.zeros(0, np.int64), np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, ...]] = []
    live, whole = np.flatnonzero(~border[stop]), True
    while True:
        pair = symbol[live] << 32 | symbol[stop[live]] if len(live) else live
        distinct, which, times = np.unique(pair, return_inverse=True, return_counts=True)
        often = times[which] > 1
        live, which = live[often], which[often]
        if not len(live):
            # Pairs that stood once are counted again at the end: a symbol that is made again in a
            # later round may bring them a second place.
            if whole:
                break
            live, whole = np.flatnonzero(alive & ~border[stop]), True
            continue
        whole = False
        rank = np.empty(len(distinct), np.int64)
        rank[np.argsort(times, kind="stable")] = np.arange(1, len(distinct) + 1)
        own = rank[which]
        priority[live] = own
        best = np.flatnonzero((own >= priority[stop[live]]) & (own >= priority[before[live]]))
        priority[live] = 0
        # Neighbours that are both best are one pair of equal symbols: every other one is taken.
        place = np.arange(len(best))
        head = np.append(True, live[best[1:]] != stop[live[best[:-1]]])
        best = best[(place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0]
        taken, chosen = live[best], which[best]
        used = np.zeros(len(distinct), bool)
        used[chosen] = True
        new = distinct[used][~known_rows(codes, distinct[used])]
        codes = np.concatenate([codes, new])
        numbers = np.concatenate([numbers, np.arange(names, names + len(new))])
        order = np.argsort(codes, kind="stable")
        codes, numbers, names = codes[order], numbers[order], names + len(new)
        rule = numbers[np.searchsorted(codes, distinct[chosen])]
        middle = stop[taken]
        after = stop[middle]
        found.append((rule, taken, middle, after))
        alive[middle] = False
        symbol[taken], stop[taken], before[after] = rule, after, taken
        live = np.unique(np.concatenate([live, taken, before[taken]]))
        live = live[live >= 0]
        live = live[alive[live] & ~border[stop[live]]]
    none = [np.zeros(0, np.int64)] * 4
    rules = [np.concatenate(x) for x in zip(*found)] if found else none
    leaf = np.flatnonzero(alive)
    return *rules, leaf, stop[leaf]


def tree_nodes(start: np.ndarray, stop: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """``low, middle, high`` of the inner nodes of a balanced tree over the symbols of each document."""
    doc = np.searchsorted(offsets, start, "right") - 1
    head = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
    firsts = np.flatnonzero(head)
    sizes = np.diff(np.append(firsts, len(doc)))
    first, last = np.repeat(firsts, sizes), np.repeat(firsts + sizes, sizes)
    place = np.arange(len(doc))
    inner = np.flatnonzero(place > first)
    half = (place - first)[inner]
    half &= -half
    high = np.minimum(inner + half, last[inner]) - 1
    return start[inner - half], start[inner], stop[high]


class Text:
    """The words of a block with what compares stretches of them."""

    def __init__(self, words: np.ndarray):
        self.words = words
        n = len(words)
        with np.errstate(over="ignore"):
            value = self._mixed(words.astype(np.uint64) + np.uint64(1))
            factor = np.full(n + 1, 0x9E3779B97F4A7C15, np.uint64)
            factor[0] = 1
            self.powers = np.cumprod(factor)
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(value * self.powers[:n], out=self.sums[1:])
            m = max(n - 2, 0)
            three = self._mixed(value[:m] + np.uint64(3) * self._mixed(value[1 : m + 1] + np.uint64(5) * value[2 : m + 2]))
        # Places of equal triples of words stand together, in rising order.
        self.order = np.argsort(three, kind="stable")
        ordered = three[self.order]
        group = np.cumsum(np.append(True, ordered[1:] != ordered[:-1])[:m]) - 1
        self.keys = group * (n + 1) + self.order
        self.group = np.empty(m, np.int64)
        self.group[self.order] = group

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def square(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Whether, by hash, ``period`` words from ``at`` stand there twice in a row."""
        a, b, c = self.sums[at], self.sums[at + period], self.sums[at + 2 * period]
        with np.errstate(over="ignore"):
            return (b - a) * self.powers[period] == c - b

    def ahead(self, i: int, j: int, limit: int) -> int:
        """How many words from ``i`` equal those from ``j > i``, which end before ``limit``."""
        words, n, step = self.words, 0, 16
        while j + n < limit:
            m = min(step, limit - j - n)
            differs = words[i + n : i + n + m] != words[j + n : j + n + m]
            if differs.any():
                return n + int(differs.argmax())
            n, step = n + m, step * 2
        return n

    def behind(self, i: int, j: int, limit: int) -> int:
        """How many words before ``i`` equal those before ``j > i``, down to ``limit``."""
        words, n, step = self.words, 0, 16
        while i - n > limit:
            m = min(step, i - n - limit)
            differs = (words[i - n - m : i - n] != words[j - n - m : j - n])[::-1]
            if differs.any():
                return n + int(differs.argmax())
            n, step = n + m, step * 2
        return n


def candidates(text: Text, low: np.ndarray, middle: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``node, period, at``: squares of ``period`` words from ``at`` that end or start in a middle.

    A run of four or more periods across the middle has two periods of words on one side of it.
    """
    node = np.flatnonzero(high - low >= LEAST_WORDS)
    low, middle, high = low[node], middle[node], high[node]
    most = (high - low) // LEAST_PERIODS
    words = text.words
    for right in (True, False):
        room = np.minimum(most, ((high - middle) if right else (middle - low)) // 2)
        for period in (1, 2):
            some = np.flatnonzero(room >= period)
            at = middle[some] if right else middle[some] - 2 * period
            same = words[at] == words[at + period]
            if period == 2:
                same &= words[at + 1] == words[at + 3]
            yield node[some[same]], np.full(int(same.sum()), period), at[same]
        some = np.flatnonzero(room >= 3)
        # Three words at the middle, and the same three at most ``room`` words away on that side.
        near = middle[some] if right else middle[some] - 3
        reach, key = room[some], text.group[near] * (len(words) + 1)
        if right:
            first, last = np.searchsorted(text.keys, key + near + 3), np.searchsorted(text.keys, key + near + reach, "right")
        else:
            first, last = np.searchsorted(text.keys, key + near - reach), np.searchsorted(text.keys, key + near - 2)
        sizes = np.maximum(last - first, 0)
        some, near, first, sizes = (x[sizes > 0] for x in (some, near, first, sizes))
        part = np.cumsum(sizes) // CANDIDATES
        for k in np.unique(part):
            now = part == k
            there = text.order[ragged(first[now], sizes[now])]
            own = np.repeat(near[now], sizes[now])
            period = np.abs(there - own)
            at = own if right else own + 3 - 2 * period
            good = text.square(at, period)
            yield np.repeat(node[some[now]], sizes[now])[good], period[good], at[good]


def middle_runs(text: Text, low: np.ndarray, middle: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows ``node, start, stop, period``: the runs inside each node that lie across its middle."""
    parts = list(candidates(text, low, middle, high))
    node, period, at = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((period, node))
    found: list[tuple[int, int, int, int]] = []
    current, known = -1, []
    for k, q, a in zip(node[order].tolist(), period[order].tolist(), at[order].tolist()):
        if k != current:
            current, known = k, []
            floor, ceiling = int(low[k]), int(high[k])
        # A multiple of the period of a run that was found, inside that run, is no period of its own.
        if any(q % p == 0 and s <= a and a + 2 * q <= e for p, s, e in known):
            continue
        e = a + q + text.ahead(a, a + q, ceiling)
        s = a - text.behind(a, a + q, floor)
        known.append((q, s, e))
        if e - s >= max(LEAST_WORDS, LEAST_PERIODS * q):
            found.append((k, s, e, q))
    return np.array(found, np.int64).reshape(-1, 4)


def maximal(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The numbers of the runs that no other run of their document and period holds."""
    order = np.lexsort((-stop, start, period, doc))
    group = np.cumsum(np.append(True, (np.diff(doc[order]) != 0) | (np.diff(period[order]) != 0))[: len(order)])
    # Stops rise within a group wherever a run is not held, so a running maximum over all will do.
    reach = np.maximum.accumulate(stop[order] + group * (int(stop.max(initial=0)) + 1)) if len(order) else order
    return order[np.append(True, reach[1:] > reach[:-1])[: len(order)]]


def find_runs(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows ``document, start, length, period``, sorted, of all maximal runs in each document.

    A run is a longest stretch whose smallest period is ``period``, of at least six words and four
    periods. ``words`` holds the numbers of all words, ``offsets`` the borders of the documents.
    """
    none = np.zeros((0, 4), np.int64)
    if not len(words):
        return none
    filled = np.unique(offsets)
    rule, start, middle, stop, leaf, leaf_stop = repair(words, filled)
    rules, once = np.unique(rule, return_index=True)
    top = tree_nodes(leaf, leaf_stop, filled)
    text = Text(words)
    low, mid, high = (np.concatenate(x) for x in zip((start[once], middle[once], stop[once]), top))
    runs = middle_runs(text, low, mid, high)
    if not len(runs):
        return none
    # From the one place of each symbol to all its places; a tree node has no other place.
    shared = runs[runs[:, 0] < len(rules)]
    placed = [runs[runs[:, 0] >= len(rules), 1:]]
    if len(shared):
        kept = np.flatnonzero(known_rows(np.unique(rules[shared[:, 0]]), rule))
        kept = kept[np.argsort(rule[kept], kind="stable")]
        first = np.searchsorted(rule[kept], rules[shared[:, 0]])
        sizes = np.searchsorted(rule[kept], rules[shared[:, 0]], "right") - first
        where = start[kept[ragged(first, sizes)]]
        moved = np.repeat(shared[:, 1:], sizes, axis=0)
        moved[:, :2] += (where - np.repeat(low[shared[:, 0]], sizes))[:, None]
        placed.append(moved)
    start, stop, period = np.concatenate(placed).T
    doc = np.searchsorted(offsets, start, "right") - 1
    stays = maximal(doc, start, stop, period)
    doc, start, stop, period = doc[stays], start[stays], stop[stays], period[stays]
    rows = np.column_stack((doc, start - offsets[doc], stop - start, period))
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def without_repeats(words: list[str], runs: np.ndarray) -> list[str]:
    """The words but for those that any of the runs ``start, length, period`` repeats."""
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(edges[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def periodic_runs(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, n_words, runs, kept`` for every row of ``docs(doc_id, text)``.

    Words are whatever blanks separate, numbered from 0. ``runs`` holds ``start, length, period``
    of each maximal run of four or more periods and six or more words, by start and then period;
    ``kept`` is the text without the words that a run repeats, joined by one space. Null, empty
    and blank texts have no words, no runs and an empty ``kept``. Documents are independent of
    each other, so repeated rows and null ids give their row each; other columns are ignored.

    A task holds a block of ``block_words`` words, or one longer document, at a time.
    """

    def block(rows: list[tuple[object, list[str]]]) -> pd.DataFrame:
        offsets = np.cumsum([0, *(len(w) for _, w in rows)])
        number: dict[str, int] = defaultdict(count().__next__)
        ids = np.fromiter(map(number.__getitem__, chain.from_iterable(w for _, w in rows)), np.int64, offsets[-1])
        runs = find_runs(ids, offsets)
        border = np.searchsorted(runs[:, 0], np.arange(len(rows) + 1))
        out = []
        for k, (doc, words) in enumerate(rows):
            own = runs[border[k] : border[k + 1], 1:]
            kept = without_repeats(words, own) if len(own) else words
            named = [{"start": s, "length": n, "period": p} for s, n, p in own.tolist()]
            out.append((doc, len(words), named, " ".join(kept)))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "runs", "kept"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[object, list[str]]] = []
        size = 0
        for batch in batches:
            doc_ids = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None)
            for doc, text in zip(doc_ids, batch["text"]):
                words = WORDS.findall(text) if isinstance(text, str) else []
                if held and size + len(words) > block_words:
                    yield block(held)
                    held, size = [], 0
                held.append((doc, words))
                size += len(words)
        if held:
            yield block(held)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, FOUND.format(kind=kind))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where the end of every tenth text repeats a stretch of its words.

    With ``h`` the crc32 of the id and ``g`` a tenth of it, texts with ``h % 10 = 0`` go on from
    word ``a = g % n`` with the ``1 + (n - a) / (3 + g % 8)`` words from there, over and over.
    Texts without words and of null ids stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        places = bind(
            F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")),
            lambda x: F.transform(
                words, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(words, x["a"] + (i - x["a"]) % x["p"]))
            ),
        )
        return F.when(n > 0, F.array_join(places, " "))

    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    text = F.when(h % 10 == 0, F.coalesce(bind(words, planted), F.col("text"))).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def runs_query(docs: DataFrame) -> DataFrame:
    """One row per document: the number of runs, the run of the greatest exponent, two digests."""

    def better(best: Column, run: Column) -> Column:
        # The runs come by start and period, so of equal exponents the first stays.
        return F.when(
            best["period"].isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run
        ).otherwise(best)

    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    found = periodic_runs(with_planted_runs(docs)).withColumn("best", F.reduce("runs", none, better))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"),
    )
