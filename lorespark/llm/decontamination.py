"""Benchmark decontamination by a generalised suffix automaton of the normalised items.

The automaton is built over words. Reading a document moves through it and tracks the length of
the longest match that ends at each word; wherever that reaches a window, the window's words are
hit and the state names the items that hold it.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WINDOW = 10
PIECE_WORDS = 20_000
PART_WORDS = 100_000
BLOCK = 1 << 16
BATCH = 256

MATCH = [
    StructField("_n_words", LongType()),
    StructField("_spans", ArrayType(IntegerType())),
    StructField("_items", ArrayType(StringType())),
]
HELD = "_decontamination_match"
MATCH_TYPE = pa.struct([("_n_words", pa.int64()), ("_spans", pa.list_(pa.int32())), ("_items", pa.list_(pa.string()))])


class Automaton:
    """Every run of words of every item, with the items of each run of ``window`` words.

    An item of fewer words is found as a whole.
    """

    def __init__(self, items: Iterable[tuple[str, list[str]]], window: int):
        items = [(name, words) for name, words in items if words]
        self.window = window
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        lines = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items]
        self.least = min((min(window, len(line)) for _, line in lines), default=window)
        for _, line in lines:
            last = 0
            for word in line:
                last = self._extend(last, word)
        self.holders: list[set[str]] = [set() for _ in self.link]
        self.whole: list[dict[int, set[str]]] = [{} for _ in self.link]
        for name, line in lines:
            state = 0
            for word in line:
                state = self.next[state][word]
                up = state
                while up > 0 and self.length[up] >= window and name not in self.holders[up]:
                    self.holders[up].add(name)
                    up = self.link[up]
            if len(line) < window:
                self.whole[state].setdefault(len(line), set()).add(name)
        # Where the run of exactly ``window`` words lies, and the nearest state that ends an item.
        size = range(len(self.link))
        by_length = sorted(size, key=self.length.__getitem__)
        self.at_window, self.at_whole = [0] * len(self.link), [0] * len(self.link)
        for s in by_length[1:]:
            up = self.link[s]
            self.at_window[s] = s if self.length[up] < window else self.at_window[up]
            self.at_whole[s] = s if self.whole[s] else self.at_whole[up]

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(word)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, word, known)
        state = len(link)
        nxt.append({}), link.append(0), length.append(length[last] + 1)
        while last >= 0 and word not in nxt[last]:
            nxt[last][word] = state
            last = link[last]
        if last >= 0:
            known = nxt[last][word]
            link[state] = known if length[known] == length[last] + 1 else self._split(last, word, known)
        return state

    def _split(self, last: int, word: int, known: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(link)
        nxt.append(dict(nxt[known])), link.append(link[known]), length.append(length[last] + 1)
        link[known] = copy
        while last >= 0 and nxt[last].get(word) == known:
            nxt[last][word] = copy
            last = link[last]
        return copy

    def match(self, ids: np.ndarray) -> tuple[list[int], set[str]]:
        """Hit stretches ``[from, to, from, to, ...]`` and items.

        A word that no item holds leads back to the start, so only runs of known words that can
        hold a whole window are read.
        """
        known = np.concatenate(([False], ids >= 0, [False]))
        starts, ends = np.flatnonzero(known[1:] > known[:-1]), np.flatnonzero(known[1:] < known[:-1])
        spans, items = [], set()
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for start, end in zip(starts, ends):
            if end - start < self.least:
                continue
            state = matched = 0
            for at, word in enumerate(ids[start:end].tolist(), int(start) + 1):
                while state and word not in nxt[state]:
                    state = link[state]
                    matched = length[state]
                if word in nxt[state]:
                    state, matched = nxt[state][word], matched + 1
                hit = 0
                if matched >= window:
                    hit = window
                    items |= self.holders[self.at_window[state]]
                ending = self.at_whole[state]
                while ending:
                    for n, names in self.whole[ending].items():
                        if n <= matched:
                            hit = max(hit, n)
                            items |= names
                    ending = self.at_whole[link[ending]]
                if hit:
                    if spans and at - hit <= spans[-1]:
                        spans[-2:] = [min(spans[-2], at - hit), at]
                        while len(spans) > 2 and spans[-2] <= spans[-3]:
                            spans[-4:] = [min(spans[-4], spans[-2]), spans[-1]]
                    else:
                        spans += [at - hit, at]
        return spans, items


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").translate(LOWER))


def word_ids(text: str, ids: dict[str, int]) -> np.ndarray:
    """The numbers of a text's words, -1 for words without one; strings are held block by block."""
    found = (m.group() for m in WORDS.finditer(text.translate(LOWER)))
    parts = [np.zeros(0, np.int32)]
    while block := list(islice(found, BLOCK)):
        parts.append(np.fromiter(map(ids.get, block, repeat(-1)), np.int32, len(block)))
    return np.concatenate(parts)


def merge(one: list[int], two: list[int]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(zip([*one[::2], *two[::2]], [*one[1::2], *two[1::2]])):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """Items cut into overlapping pieces, so that no piece is long and no window is lost."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for item, text in zip(frame["item"], frame["text"]):
                words = words_of(text)
                for start in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    piece = words[start : start + PIECE_WORDS + window - 1]
                    rows.append((item, start // PIECE_WORDS, len(piece), " ".join(piece)))
            yield pd.DataFrame(rows, columns=["item", "piece", "n", "line"])

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return named.mapInPandas(cut, "item string, piece int, n long, line string").filter("n > 0")


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs(text, ...)`` with ``_n_words``, ``_spans`` (hit word stretches) and ``_items``.

    Items are read in parts of bounded size, one automaton and one narrow pass over the documents
    for each; documents are never shuffled. Null texts have no words, items without words are no
    items, and a null ``item_id`` is named by the empty string. Columns of these three names are
    replaced.
    """
    pieces = _pieces(benchmark, window)
    words = pieces.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-words // PART_WORDS))
    part = F.pmod(F.xxhash64("item", "piece"), F.lit(parts))
    plain = docs.drop(HELD, *(f.name for f in MATCH))
    found = plain.withColumn(HELD, F.lit(None).cast(StructType(MATCH)))
    for p in range(parts):
        lines = [(r.item, r.line) for r in pieces.filter(part == p).select("item", "line").collect()]
        scan = F.arrow_udf(_scan(sorted(lines), window), StructType(MATCH))
        found = found.withColumn(HELD, scan("text", HELD))
    return found.select(*plain.columns, f"{HELD}.*")


def _scan(lines: list[tuple[str, str]], window: int):
    """Texts and what was matched before -> ``MATCH``; the texts themselves stay where they are."""

    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        automaton = Automaton([(item, line.split(" ")) for item, line in lines], window)
        for texts, old in batches:
            done = []
            # Of a batch the matches are held, and a few texts at a time.
            for start in range(0, len(texts), BATCH):
                few = zip(texts.slice(start, BATCH).to_pylist(), old.slice(start, BATCH).to_pylist())
                done.append(pa.array([match_text(automaton, *one) for one in few], MATCH_TYPE))
            yield pa.concat_arrays(done or [pa.array([], MATCH_TYPE)])

    return scan


def match_text(automaton: Automaton, text: str | None, before: dict | None) -> dict:
    """The ``MATCH`` of a text, with what other parts of the items have matched ``before``."""
    ids = word_ids(text, automaton.ids) if text is not None else np.zeros(0, np.int32)
    spans, items = automaton.match(ids)
    if before is not None:
        spans, items = merge(before["_spans"], spans), items | set(before["_items"])
    return {"_n_words": len(ids), "_spans": spans, "_items": sorted(items)}


def n_hit() -> Column:
    """Hit words: what the stretches in ``_spans`` cover."""
    sign = F.transform("_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("long"))
    return F.aggregate(sign, F.lit(0).cast("long"), lambda total, x: total + x)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs``."""
    found = find_items(docs.select("doc_id", "text"), benchmark, window)
    names = F.array_join(F.array_sort("_items"), ",")
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (n_hit() > 0).alias("contaminated"),
    )


def cut_spans(text: str, spans: list[int], least: int) -> str:
    """The text without the hit stretches of at least ``least`` words."""
    edges = {}
    for start, end in zip(spans[::2], spans[1::2]):
        if end - start >= least:
            edges[start], edges[end - 1] = "from", edges.get(end - 1, "to")
            if start == end - 1:
                edges[start] = "both"
    out, at, begin = [], 0, 0
    for number, word in enumerate(WORDS.finditer(text.translate(LOWER))):
        edge = edges.get(number)
        if edge in ("from", "both"):
            begin = word.start()
        if edge in ("to", "both"):
            out.append(text[at:begin])
            at = word.end()
    return "".join([*out, text[at:]])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = WINDOW, coverage: float = 0.0
) -> DataFrame:
    """The documents without benchmark text, with the columns of ``docs``.

    A document of whose words more than the share ``coverage`` are hit goes whole; from the
    others, hit stretches of ``least`` or more words are removed. By default no share is
    tolerated. Documents without hits are returned as they are, repeated rows each.
    """

    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_spans(t, list(s), least) for t, s in zip(texts, spans)], dtype=object)

    found = find_items(docs, benchmark, window).filter(n_hit() <= F.col("_n_words") * coverage)
    if coverage > 0:
        cleaned = F.pandas_udf(cut, StringType())("text", "_spans")
        found = found.withColumn("text", F.when(F.size("_spans") > 0, cleaned).otherwise(F.col("text")))
    return found.select(*docs.columns)


SQL = r"""
with low as (
  select doc_id, row_number() over () as row_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
items as (
  select coalesce(item_id::varchar, '') as item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
sized as (select item, w, least(10, len(w)) as n from items where len(w) > 0),
wins as (
  select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as win
  from (select item, w, n, unnest(range(1, len(w) - n + 2)) as i from sized)),
runs as (
  select row_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win
  from (select row_id, w, n, unnest(range(1, len(w) - n + 2)) as i
        from low cross join (select distinct n from sized) lens where len(w) >= n)),
hits as (select r.row_id, r.n, r.i, x.item from runs r join wins x on r.n = x.n and r.win = x.win),
named as (
  select row_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as names
  from hits group by row_id),
marked as (
  select row_id, count(distinct pos) as n_hit
  from (select row_id, unnest(range(i, i + n)) as pos from hits) group by row_id)
select l.doc_id, len(l.w)::bigint as n_words, coalesce(m.n_hit, 0)::bigint as n_hit,
  coalesce(d.n_items, 0)::bigint as n_items, sha256(coalesce(d.names, '')) as items_sha256,
  coalesce(m.n_hit, 0) > 0 as contaminated
from low l left join named d using (row_id) left join marked m using (row_id)
"""
