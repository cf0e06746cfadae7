"""Removal of byte strings that stand earlier in the corpus, found through content-chosen anchors.

Every string of ``length`` bytes has an anchor: the least hash of the short grams it holds. Equal
strings have equal anchors, so only stretches whose anchor occurs more than once are looked at
further. Equal stretches are settled as wholes; of the stretches that differ, each string is
compared by a hash of 128 bits. All documents meet in one global exchange; nothing is sampled.
What is exchanged is kept small: stretches that are settled early travel as runs, the others as
a few numbers, and strings are only made where the bytes they come from have been dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.frames import FETCH_ROWS
from lorespark.session import durable

GRAM = 32
PART = 1 << 20
ROWS = 1 << 17
NO_ID = (1 << 63) - 1
#: Columns in the order in which they are exchanged: hashes first, then small numbers.
STRETCH = ["anchor", "content", "sides", "start", "counts", "doc", "mark", "repeated"]
EXCERPT = ["doc", "mark", "start", "strings", "core", "excerpt"]


#: What ``_powers`` has made in this process. A plain dictionary, so that functions that use it
#: still travel by value to executors that lack this package.
POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, and the powers of an odd multiplier and of its inverse."""
    if (which, size) in POWERS:
        return POWERS[which, size]
    random = np.random.default_rng(1000 + which)
    values = random.integers(0, 1 << 64, 256, np.uint64)
    factor = int(random.integers(0, 1 << 64, dtype=np.uint64)) // 8 * 8 + 5
    powers = [np.full(size, f % (1 << 64), np.uint64) for f in (factor, pow(factor, -1, 1 << 64))]
    for p in powers:
        p[0] = 1
        np.cumprod(p, out=p)
    POWERS[which, size] = (values, *powers)
    return POWERS[which, size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """64-bit hashes of any stretches of some bytes, from one prefix sum."""

    def __init__(self, data: np.ndarray, which: int):
        values, powers, self.back = _powers(which, PART + 4096)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def all(self, length: int) -> np.ndarray:
        """Of each string of ``length`` bytes."""
        n = len(self.sums) - length
        return _mixed((self.sums[length:] - self.sums[:n]) * self.back[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    low, have = x, 1
    while have * 2 <= width:
        low, have = np.minimum(low[:-have], low[have:]), have * 2
    rest = width - have
    return np.minimum(low[:-rest], low[rest:]) if rest else low


def parts(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Bounded parts of a text that overlap so that each string of ``length`` bytes lies in just one."""
    for start in range(0, max(len(data) - length + 1, 0), PART):
        yield start, data[start : start + PART + length - 1]


def stretches(data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``start, strings, lefts, anchor, content, sides``: runs of strings whose anchor is the same gram of the text.

    Of equal least hashes the first is the anchor, so a run ends where that gram is left behind.
    A string goes on for half its other bytes to the left or to the right of its anchor: to the left
    the first ``lefts`` strings, to the right all others. ``sides`` holds two short hashes of the anchor
    with so many bytes on either side.
    """
    gram = min(GRAM, length)
    width, half = length - gram + 1, (length - gram + 1) // 2
    for offset, part in parts(data, length):
        grams = Hashes(part, 0).all(gram)
        low = sliding_min(grams, width)
        ends = np.flatnonzero(np.append((low[1:] != low[:-1]) | (grams[: len(low) - 1] == low[:-1]), True)) + 1
        starts, until = np.concatenate([[0], ends[:-1]]), ends + length - 1
        at = starts + np.lib.stride_tricks.sliding_window_view(grams, width)[starts].argmin(1)
        hashes = Hashes(part, 1)
        left = hashes.of(np.maximum(at - half, starts), at + gram)
        right = hashes.of(at, np.minimum(at + gram + half, until))
        sides = (left >> np.uint64(32) << np.uint64(32)) | (right >> np.uint64(32))
        found = low[starts], hashes.of(starts, until), sides
        lefts = np.clip(at - half + 1 - starts, 0, ends - starts)
        yield starts + offset, ends - starts, lefts, *(x.view(np.int64) for x in found)


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _joined(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """Tuples ``doc, mark, array, ...`` as frames of a bounded number of rows, but for one tuple."""
    held, size = [], 0

    def frame() -> pd.DataFrame:
        sizes = [len(r[2]) for r in held]
        ends = [np.repeat(np.array([r[k] for r in held], np.int64), sizes) for k in (0, 1)]
        rest = [np.concatenate([r[k] for r in held]) for k in range(2, len(names))]
        return pd.DataFrame(dict(zip(names, [*ends, *rest])))

    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= ROWS:
            yield frame()
            held, size = [], 0
    if held:
        yield frame()


def _together(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Whether the strings of a row follow at once on those of the row before, in the same text."""
    same = (doc[1:] == doc[:-1]) & (mark[1:] == mark[:-1]) & (start[1:] == start[:-1] + strings[:-1])
    return np.append(False, same)[: len(doc)]


def _as_runs(frame: pd.DataFrame, joins: np.ndarray) -> pd.DataFrame:
    """One row, with all the strings, for a row and those behind it that it ``joins``."""
    first = np.flatnonzero(~joins)
    strings = np.add.reduceat(frame["strings"].to_numpy(), first)
    return frame.iloc[first].assign(strings=strings)


def _stretch_rows(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    rows = (
        (doc, mark, *found)
        for batch in batches
        for doc, mark, text in zip(batch["doc"], batch["mark"], batch["text"])
        for found in stretches(np.frombuffer(as_bytes(text), np.uint8), length)
    )
    for frame in _joined(rows, ["doc", "mark", "start", "strings", "lefts", "anchor", "content", "sides"]):
        # Of equal stretches met here all but the first surely go: they are dealt out anywhere.
        ordered = frame.sort_values(["anchor", "content", "doc", "mark", "start"])
        # Rows of equal id and text are one document: its stretches are met once, not again.
        place = ordered[["doc", "mark", "start"]].to_numpy()
        ordered = ordered[np.append(True, (place[1:] != place[:-1]).any(1))]
        repeated = ordered.duplicated(["anchor", "content", "strings"]).to_numpy()
        spread = ordered["content"].to_numpy() + 31 * ordered["doc"].to_numpy() + ordered["start"].to_numpy()
        ordered = ordered.assign(repeated=repeated, anchor=np.where(repeated, spread, ordered["anchor"].to_numpy()))
        # What is settled needs no hashes; in the order of the text, it goes as one row a run.
        ordered.loc[repeated, ["lefts", "content", "sides"]] = 0
        ordered = ordered.sort_index()
        settled = ordered["repeated"].to_numpy()
        joins = _together(*(ordered[k].to_numpy() for k in ("doc", "mark", "start", "strings")))
        runs = _as_runs(ordered, joins & settled & np.append(False, settled[:-1]))
        yield runs.assign(counts=runs["strings"] * (length + 1) + runs["lefts"])[STRETCH]


def _pieces(batch: pd.DataFrame) -> Iterator[tuple]:
    for row in batch.itertuples(index=False):
        at = np.array([(a["start"], a["strings"]) for a in row.places], np.int64).reshape(-1, 2)
        yield row, at[np.argsort(at[:, 0], kind="stable")]


def _string_rows(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """A row for each run of strings in ``places``, with the bytes that they cover."""
    for batch in batches:
        found, size = [], 0
        for row in batch.itertuples(index=False):
            data = as_bytes(row.text)
            for place in row.places:
                start, strings = place["start"], place["strings"]
                found.append((row.doc, row.mark, start, strings, place["core"], data[start : start + strings + length - 1]))
                size += 1
                if size >= ROWS:
                    yield pd.DataFrame(found, columns=EXCERPT)
                    found, size = [], 0
        if found:
            yield pd.DataFrame(found, columns=EXCERPT)


def _run_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Single strings ``doc, mark, start`` as runs of those that stand together in a batch."""
    for batch in batches:
        ordered = batch.drop_duplicates().sort_values(["doc", "mark", "start"]).assign(strings=1)
        if len(ordered):
            yield _as_runs(ordered, _together(*(ordered[k].to_numpy() for k in ("doc", "mark", "start", "strings"))))


def keep_rest(text: str | None, places: np.ndarray, length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left, and the spans that go; ``places`` are sorted runs of strings: start, number."""
    spans: list[list[int]] = []
    for start, strings in places.tolist():
        end = start + strings + length - 1
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    data, kept, at = as_bytes(text), [], 0
    for start, end in spans:
        kept.append(data[at:start])
        at = end
    return b"".join([*kept, data[at:]]), [(a, b) for a, b in spans]


def _results(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for row, places in _pieces(batch):
            kept, spans = keep_rest(row.text, places, length)
            removed = sum(b - a for a, b in spans)
            found.append((row.doc, len(kept) + removed, removed, [{"start": a, "end": b} for a, b in spans], kept))
        yield pd.DataFrame(found, columns=["doc", "n_bytes", "n_removed", "spans", "kept"])


def _marked(table: DataFrame) -> DataFrame:
    """``mark`` tells apart the texts of an id that stands more than once; for all others it is 0.

    A hash would not get smaller on its way through the exchanges. With too many such ids to be
    sent to all tasks every row keeps its hash.
    """
    shared = durable(table.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc", F.lit(True).alias("shared")))
    n = shared.count()
    if n > FETCH_ROWS:
        return table
    if n:
        table = table.join(F.broadcast(shared), "doc", "left")
        return table.withColumn("mark", F.when(F.col("shared"), F.col("mark")).otherwise(F.lit(0).cast("long"))).drop("shared")
    return table.withColumn("mark", F.lit(0).cast("long"))


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` for every row of ``docs(doc_id, text)``.

    ``spans`` are the removed runs of bytes, ``kept`` the bytes that stay. A byte goes if a string
    of ``length`` bytes over it also starts earlier: in a smaller ``doc_id`` (null ids come last),
    or in front of it in the same text. Rows of equal id and text are one document, and each gets
    its result; different texts of one id are ordered by a hash. Null, empty and short texts lose
    nothing. Other columns are ignored.

    Of an anchor that stands once, nothing is kept after the first exchange. Equal stretches after
    the first go as wholes, those within one batch before the exchange, so frequent passages and copies add no strings to the second exchange;
    only strings of first stretches that share their side of the anchor with another content are compared one by one.
    They are dealt out as excerpts of the text, by the anchor with that side, and cut where they arrive.
    """
    key = ["doc", "mark"]
    table = _marked(
        docs.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"),
            F.xxhash64("text").alias("mark"),
        )
    )
    place, rows = F.struct(*key, "start"), F.count(F.lit(1))
    content = Window.partitionBy("anchor", "content", "strings")

    def piece(start: Column, strings: Column, core: Column) -> Column:
        return F.struct(start.alias("start"), strings.alias("strings"), core.alias("core"))

    def side(which: str, start: Column, strings: Column) -> Column:
        shared = F.col(f"{which}_rows") > F.col("equal")
        return piece(start, F.when(shared, strings).otherwise(0), F.xxhash64(F.lit(which), "anchor", which))

    start, strings, lefts = F.col("start"), F.col("strings"), F.col("lefts")
    sides = F.array(side("left", start, lefts), side("right", start + lefts, strings - lefts))
    pieces = F.when(F.col("again"), F.array(piece(start, strings, F.lit(None).cast("long")))).otherwise(
        F.filter(sides, lambda x: x["strings"] > 0)
    )
    # Strings that go, in runs (``core`` is null), and runs of strings to be compared with those of the same core.
    met = durable(
        table.select(*key, "text").mapInPandas(
            lambda batches: _stretch_rows(batches, length), ", ".join(f"{k} long" for k in STRETCH[:-1]) + ", repeated boolean"
        )
        .repartition("anchor")
        .withColumn("alone", rows.over(Window.partitionBy("anchor")) == 1)
        .filter("repeated or not alone")
        .withColumn("strings", F.expr(f"counts div {length + 1}")).withColumn("lefts", F.col("counts") % (length + 1))
        .withColumn("first", F.min(place).over(content)).withColumn("equal", rows.over(content))
        .withColumn("left", F.shiftright("sides", 32)).withColumn("right", F.col("sides").bitwiseAND(F.lit(0xFFFFFFFF)))
        .withColumn("left_rows", rows.over(Window.partitionBy("anchor", "left")))
        .withColumn("right_rows", rows.over(Window.partitionBy("anchor", "right")))
        .withColumn("again", F.col("repeated") | (place != F.col("first")))
        .filter("again or left_rows > equal or right_rows > equal")
        .select(*key, F.inline(pieces))
    )
    unsettled = met.filter("core is not null").groupBy(*key).agg(F.collect_set(F.struct("start", "strings", "core")).alias("places"))
    string = F.substring("excerpt", F.col("nth") + 1, F.lit(length))
    later = (
        table.join(unsettled, key).select(*key, "text", "places").mapInPandas(
            lambda batches: _string_rows(batches, length), ", ".join(f"{k} long" for k in EXCERPT[:-1]) + ", excerpt binary"
        )
        .repartition("core")
        .select("*", F.explode(F.sequence(F.lit(0), F.col("strings").cast("int") - 1)).alias("nth"))
        .select(*key, (start + F.col("nth")).alias("start"), "core", F.xxhash64(string).alias("one"), F.xxhash64(F.lit(1), string).alias("two"))
        .withColumn("first", F.min(place).over(Window.partitionBy("core", "one", "two")))
        .filter(place != F.col("first"))
        .select(*key, "start")
        .mapInPandas(_run_rows, "doc long, mark long, start long, strings long")
    )
    gone = (
        met.filter("core is null").select(*key, "start", "strings")
        .unionByName(later)
        .repartition(*key)
        .groupBy(*key).agg(F.collect_list(F.struct("start", "strings")).alias("places"))
    )
    none = F.array().cast("array<struct<start:bigint,strings:bigint>>")
    results = table.join(gone, key, "left").select("doc", "text", F.coalesce("places", none).alias("places")).mapInPandas(
        lambda batches: _results(batches, length),
        "doc long, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary",
    )
    return results.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "spans", "kept")


def repeats_query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
