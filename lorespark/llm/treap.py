"""Ranked lexical search on K2-treaps over the grid of terms and documents.

Blocks of documents become grids, with a row per term and a column per document; an entry is the
impact of the term in the document. A grid is cut into quarters down to single entries. Of each
cell that is not empty the largest impact is kept, as what it falls short of its parent's, and four
bits that say which of its quarters are not empty. A query goes down the paths of all its rows at
once: it holds ranges of documents with a cell per term, bounded by the cells' maxima, and opens
the ranges of the largest bounds first until none can reach the documents found.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lorespark.functions.frames import top_k
from lorespark.session import durable

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERMS = re.compile(TERM)
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
SMALL = str.maketrans(UPPER, LOWER)
TOP = 50
BLOCK_DOCS = 4096
BLOCK_TERMS = 1 << 19
#: Terms of items that one job searches for, that one pass over a grid goes down with, and entries
#: that one step opens.
JOB_TERMS = 1 << 18
PASS_TERMS = 1 << 13
STEP_ENTRIES = 1 << 19
BIT_COUNT = np.array([bin(i).count("1") for i in range(16)], np.int64)
GRID = (
    "docs array<{kind}>, terms array<string>, counts array<int>, levels int, cells array<int>, quarters binary,"
    " falls binary, largest int"
)


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term of ``tf`` occurrences in a document of ``n`` terms is worth, before its weight."""
    m = 100 - 50 + (50 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def spread_bits(x: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2^31 with a zero between any two."""
    x = x.astype(np.int64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << shift) & mask
    return x


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def build(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> tuple[int, list[int], bytes, bytes, int]:
    """``levels, cells, quarters, falls, largest`` of the grid of some entries.

    ``cells`` counts the cells of each level from the whole grid down, ``quarters`` has four bits
    for each cell but the entries, and ``falls`` the difference to the parent's maximum for each
    cell but the first; both run from the whole grid down and along the Z-order in each level.
    """
    levels = max(1, int(max(rows.max(), columns.max())).bit_length())
    code = spread_bits(rows) << 1 | spread_bits(columns)
    order = np.argsort(code, kind="stable")
    code, top = code[order], values[order]
    cells, masks, falls = [len(code)], [], []
    for _ in range(levels):
        parent = code >> 2
        head = np.append(True, parent[1:] != parent[:-1])
        first = np.flatnonzero(head)
        masks.append(np.bitwise_or.reduceat(1 << (code & 3), first).astype(np.uint8))
        best = np.maximum.reduceat(top, first)
        falls.append((best[np.cumsum(head) - 1] - top).astype("<i4"))
        code, top = parent[first], best
        cells.append(len(code))
    packed = [zlib.compress(np.concatenate(x[::-1]).tobytes(), 1) for x in (masks, falls)]
    return levels, cells[::-1], *packed, int(top[0])


class Grid(NamedTuple):
    """A grid laid open: per cell its quarters, the number of its first quarter, and its maximum."""

    levels: int
    quarters: np.ndarray
    first: np.ndarray
    largest: np.ndarray

    @staticmethod
    def of(levels: int, cells: list[int], quarters: bytes, falls: bytes, largest: int) -> Grid:
        masks = np.frombuffer(zlib.decompress(quarters), np.uint8)
        fall = np.frombuffer(zlib.decompress(falls), "<i4")
        sizes = BIT_COUNT[masks]
        top = np.empty(sum(cells), np.int64)
        top[0], begin = largest, 0
        for n, below in zip(cells, cells[1:]):
            end = begin + n
            top[end : end + below] = np.repeat(top[begin:end], sizes[begin:end]) - fall[end - 1 : end - 1 + below]
            begin = end
        return Grid(levels, masks, np.cumsum(sizes) - sizes + 1, top)


class Best:
    """The ``k`` best documents met so far for each item, and the score that others must reach."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.doc = np.zeros(0, np.int64)
        self.bar = np.ones(items, np.int64)  # a score above 0

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        """``doc`` are numbers that rise as the ids do, so that they decide ties."""
        item, score, doc = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        head = np.append(True, item[1:] != item[:-1])[: len(item)]
        place = np.arange(len(item))
        rank = place - np.maximum.accumulate(np.where(head, place, 0))
        few = rank < self.k
        self.item, self.score, self.doc = item[few], score[few], doc[few]
        full = rank == self.k - 1
        self.bar[item[full]] = np.maximum(score[full], 1)


def descend(grid: Grid, item: np.ndarray, row: np.ndarray, weight: np.ndarray, best: Best, doc_numbers: np.ndarray) -> None:
    """Add to ``best`` the documents of a grid for terms ``(item, row, weight)``, sorted by item.

    A state is an item and a range of documents; its entries are one cell per term whose row has
    an entry near that range. A step takes the states of the largest bounds and halves their
    ranges; whole levels of cells are read at once. States below their item's bar are let go.
    """
    head = np.append(True, item[1:] != item[:-1])
    begin = np.flatnonzero(head)
    # States: their item, level, range, bound, and the slice of their entries.
    s_item, s_level, s_range = item[begin], np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    s_size = np.diff(np.append(begin, len(item)))
    e_term, e_cell = np.arange(len(item)), np.zeros(len(item), np.int64)
    s_bound = np.add.reduceat(weight * grid.largest[0], begin)
    while len(s_item):
        s_first = np.cumsum(s_size) - s_size
        alive = np.flatnonzero(s_bound >= best.bar[s_item])
        # The best of each item first, then the second best of each, up to a number of entries.
        order = alive[np.lexsort((-s_bound[alive], s_item[alive]))]
        head = np.append(True, s_item[order][1:] != s_item[order][:-1])[: len(order)]
        place = np.arange(len(order))
        rank = place - np.maximum.accumulate(np.where(head, place, 0))
        order = order[np.argsort(rank, kind="stable")]
        open_ = max(1, int(np.searchsorted(np.cumsum(s_size[order]), STEP_ENTRIES, "right")))
        open_ = min(open_, max(int((rank < TOP).sum()), 1))
        now, later = np.sort(order[:open_]), np.sort(order[open_:])

        size = s_size[now]
        at = ragged(s_first[now], size)
        term, cell = e_term[at], e_cell[at]
        state = np.repeat(np.arange(len(now)), size)
        upper = (row[term] >> (grid.levels - 1 - s_level[now][state])) & 1
        mask = grid.quarters[cell].astype(np.int64)
        new_state, new_term, new_cell = [], [], []
        for half in (0, 1):
            bit = upper << 1 | half
            there = (mask >> bit & 1) == 1
            new_state.append(state[there] * 2 + half)
            new_term.append(term[there])
            new_cell.append((grid.first[cell] + BIT_COUNT[mask & ((1 << bit) - 1)])[there])
        new_state, new_term, new_cell = (np.concatenate(x) for x in (new_state, new_term, new_cell))
        order = np.argsort(new_state, kind="stable")
        new_state, new_term, new_cell = new_state[order], new_term[order], new_cell[order]
        head = np.append(True, new_state[1:] != new_state[:-1])[: len(new_state)]
        begin = np.flatnonzero(head)
        made = new_state[begin]
        n_item, n_level = s_item[now][made >> 1], s_level[now][made >> 1] + 1
        n_range = s_range[now][made >> 1] * 2 + (made & 1)
        n_size = np.diff(np.append(begin, len(new_state)))
        n_bound = np.add.reduceat(weight[new_term] * grid.largest[new_cell], begin) if len(begin) else begin
        done = n_level == grid.levels
        if done.any():
            good = done & (n_bound >= best.bar[n_item])
            best.add(n_item[good], n_bound[good], doc_numbers[n_range[good]])
        more = np.flatnonzero(~done & (n_bound >= best.bar[n_item]))

        old = ragged(s_first[later], s_size[later])
        new = ragged((np.cumsum(n_size) - n_size)[more], n_size[more])
        e_term, e_cell = np.concatenate((e_term[old], new_term[new])), np.concatenate((e_cell[old], new_cell[new]))
        s_item, s_level, s_range, s_bound, s_size = (
            np.concatenate((a[later], b[more]))
            for a, b in ((s_item, n_item), (s_level, n_level), (s_range, n_range), (s_bound, n_bound), (s_size, n_size))
        )


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms all have, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(TERMS.findall(t.as_py() or "")) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"docs": [sum(x > 0 for x in n)], "terms": [sum(n)]})

    found = docs.select("text").mapInArrow(run, "docs long, terms long")
    return tuple(int(x or 0) for x in found.agg(F.sum("docs"), F.sum("terms")).first())


def build_grids(docs: DataFrame, n_docs: int, n_terms: int, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """A grid per block of the rows of ``docs(doc_id, text)`` that have a term.

    Documents are not shuffled: a task makes blocks of up to ``block_docs`` documents from what it
    reads, of half a million terms or one longer document. Columns are sorted by id, rows by how
    many documents hold the term, most first, so that dense rows share cells. ``counts`` are those
    numbers; added up over all grids they are the document frequencies.
    """

    def grid(held: list[tuple[object, np.ndarray]], names: list[str]) -> pd.DataFrame:
        order = sorted(range(len(held)), key=lambda i: (held[i][0] is None, 0 if held[i][0] is None else held[i][0]))
        sizes = np.array([len(held[i][1]) for i in order], np.int64)
        term = np.concatenate([held[i][1] for i in order])
        code, tf = np.unique(term << 32 | np.repeat(np.arange(len(order)), sizes), return_counts=True)
        term, column = code >> 32, code & 0xFFFFFFFF
        counts = np.bincount(term, minlength=len(names))
        rank = np.lexsort((np.arange(len(names)), -counts))
        row = np.empty(len(names), np.int64)
        row[rank] = np.arange(len(names))
        built = build(row[term], column, impact(tf, sizes[column], n_docs, n_terms))
        return pd.DataFrame(
            [([held[i][0] for i in order], [names[i] for i in rank.tolist()], counts[rank].tolist(), *built)],
            columns=["docs", "terms", "counts", "levels", "cells", "quarters", "falls", "largest"],
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        spelled: dict[str, int] = {}

        class Numbers(dict):
            """The number of a word however it is written, by its spelling in small letters."""

            def __missing__(self, word: str) -> int:
                self[word] = spelled.setdefault(word.translate(SMALL), len(spelled))
                return self[word]

        numbers = Numbers()
        for batch in batches:
            doc_ids = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None)
            for doc, text in zip(doc_ids, batch["text"]):
                words = TERMS.findall(text) if isinstance(text, str) else []
                if not words:
                    continue
                if held and (len(held) == block_docs or size + len(words) > BLOCK_TERMS):
                    yield grid(held, list(spelled))
                    held, size = [], 0
                    spelled.clear(), numbers.clear()
                held.append((doc, np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))))
                size += len(words)
        if held:
            yield grid(held, list(spelled))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, GRID.format(kind=kind))


def terms_of(text: Column) -> Column:
    small = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_distinct(F.regexp_extract_all(small, F.lit(TERM), F.lit(0)))


def weighted_terms(items: DataFrame, grids: DataFrame, n_docs: int) -> DataFrame:
    """``item_id, mark, term, weight`` of ``items(item_id, text)`` for terms that a document holds."""
    own = items.select("item_id", F.xxhash64("text").alias("mark"), F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    met = grids.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("t.terms", "t.counts")
    met = met.groupBy(F.col("terms").alias("term")).agg(F.sum("counts").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    return met.join(own, "term").select("item_id", "mark", "term", weight.alias("weight")).filter("weight > 0")


def _search_block(grids: DataFrame, rows: list, k: int, kind: str) -> DataFrame:
    """The best documents of each task for some terms ``(item, term, weight)``, ``item`` a number."""
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(r[1] for r in rows))}
    item = np.array([r[0] for r in rows], np.int64)
    term = np.array([vocabulary[r[1]] for r in rows], np.int64)
    weight = np.array([r[2] for r in rows], np.int64)
    total = int(item.max()) + 1
    arrow_kind = to_arrow_type(grids.schema["docs"].dataType.elementType)

    # Passes end where an item ends.
    starts = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
    borders = [0]
    for start, stop in zip(starts, np.append(starts[1:], len(item))):
        if stop - borders[-1] > PASS_TERMS and start > borders[-1]:
            borders.append(int(start))
    borders.append(len(item))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[object] = []
        best = Best(total, k)
        for batch in batches:
            for r in range(len(batch)):
                cell = lambda c: batch.column(c)[r]  # noqa: B023, E731
                docs = cell("docs").as_py()
                row = np.full(len(vocabulary), -1, np.int64)
                for place, name in enumerate(cell("terms").values.to_pylist()):
                    if (number := vocabulary.get(name)) is not None:
                        row[number] = place
                met = row[term] >= 0
                if not met.any():
                    continue
                grid = Grid.of(*(cell(c).as_py() for c in ("levels", "cells", "quarters", "falls", "largest")))
                # Numbers that rise as the ids do, over the documents kept and those of this block.
                known = [*ids, *docs]
                merged = sorted((d is None, 0 if d is None else d, i) for i, d in enumerate(known))
                number = np.empty(len(merged), np.int64)
                number[[i for _, _, i in merged]] = np.arange(len(merged))
                best.doc = number[best.doc]
                for a, b in zip(borders, borders[1:]):
                    some = np.flatnonzero(met[a:b]) + a
                    if len(some):
                        descend(grid, item[some], row[term[some]], weight[some], best, number[len(ids) :])
                kept, best.doc = np.unique(best.doc, return_inverse=True)
                ids = [known[merged[i][2]] for i in kept.tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item), pa.array([ids[i] for i in best.doc.tolist()], arrow_kind), pa.array(best.score)],
            names=["item", "doc_id", "score"],
        )

    return grids.mapInArrow(run, f"item long, doc_id {kind}, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of ``docs(doc_id, text)`` per item.

    ``items(item_id, text)`` ask with their distinct terms. Scores are whole numbers above 0; equal
    ones rank by id, null ids last. Rows of equal item id and text are one item; different texts of
    one id are answered each. Every row of ``docs`` is a document, so repeated rows are ranked each.
    Null and empty texts have no terms and neither find nor are found; empty tables give no rows.
    Other columns are ignored.

    The grids are stored, and each task answers from its own with at most ``k`` documents an item.
    Items are searched in jobs of about ``JOB_TERMS`` terms, which is all that is sent to tasks.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {kind}, score long"
    n_docs, n_terms = corpus_size(docs)
    if not n_docs:
        return spark.createDataFrame([], schema)
    grids = durable(build_grids(docs, n_docs, n_terms))
    terms = durable(weighted_terms(items, grids, n_docs))
    jobs = -(-terms.count() // JOB_TERMS)
    answers = []
    for job in range(jobs):
        rows = terms.filter(F.pmod(F.xxhash64("item_id", "mark"), F.lit(jobs)) == job).collect()
        names = {key: i for i, key in enumerate(dict.fromkeys((r["item_id"], r["mark"]) for r in rows))}
        if not names:
            continue
        found = _search_block(grids, [(names[r["item_id"], r["mark"]], r["term"], r["weight"]) for r in rows], k, kind)
        named = spark.createDataFrame(
            [(i, *key) for key, i in names.items()],
            f"item long, item_id {items.schema['item_id'].dataType.simpleString()}, mark long",
        )
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        # First in shares of an item, so that no task ranks what all tasks found for it.
        shares = found.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(32)))
        few = top_k(shares, ["item", "share"], order, k, "place")
        best = top_k(few.select("item", "doc_id", "score"), ["item"], order, k, "rank")
        answers.append(best.join(named, "item").select("item_id", "rank", "doc_id", "score"))
    if not answers:
        return spark.createDataFrame([], schema)
    result = answers[0]
    for more in answers[1:]:
        result = result.unionByName(more)
    return result


SQL = r"""
with words as (
  select row_number() over () as row_id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
sized as (select row_id, doc_id, w, len(w)::bigint as n from words where len(w) > 0),
totals as (select count(*)::bigint as big_n, sum(n)::bigint as big_l from sized),
asked as (
  select distinct item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
met as (
  select row_id, doc_id, n, term, count(*)::bigint as tf
  from (select row_id, doc_id, n, unnest(w) as term from sized) group by all),
held as (select m.*, count(*) over (partition by term) as df from met m where term in (select term from asked)),
parts as (
  select a.item_id, h.row_id, h.doc_id,
    floor(1000 * ln((2 * big_n + 2)::double / (2 * df + 1)))::bigint
      * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * big_n) // big_l)))) as part
  from asked a join held h using (term) cross join totals),
scored as (select item_id, row_id, doc_id, sum(part)::bigint as score from parts group by all),
ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
  from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 50
"""
