"""Vector tables: upsert, lookup, exact and approximate nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.functions.frames import latest, replace_rows, top_k
from lorespark.schemas import TOP_K

# Distances are rounded to this many places before ranking, so that equal vectors tie and the
# id decides, whatever block of the computation they fell into.
DISTANCE_PLACES = 10
# Distance of a vector without direction (all zeros): sorts last and scores 0.
NO_DIRECTION = 2.0

# Rounds of the training of cells.
CELL_ROUNDS = 40

# Tiles of a large knowledge base grow until it is cut into no more blocks of vectors than this, or
# until a block holds so many numbers.
MOST_BLOCKS = 16
BLOCK_NUMBERS = 1 << 20

MATCHES = "query_id string, vec_id string, distance double"


def upsert_vectors(base: DataFrame, updates: DataFrame, version: str | None = None) -> DataFrame:
    """Insert or overwrite by ``(kb_id, vec_id)``; among updates the highest version wins."""
    keys = ["kb_id", "vec_id"]
    if version is not None:
        updates = latest(updates, keys, [version])
    return replace_rows(base, updates, keys)


def where_equals(df: DataFrame, conditions: Mapping[str, object] | None) -> DataFrame:
    """Rows whose metadata keys, or same-named columns, equal the given values.

    A condition on a column reaches the parquet scan; one on the map cannot.
    """
    for key, value in (conditions or {}).items():
        if key in df.columns:
            df = df.filter(F.col(key) == F.lit(value))
        else:
            df = df.filter(F.col("metadata")[key] == F.lit(str(value)))
    return df


def get_by_ids(df: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    """Rows with the given ids; ids without a row are skipped."""
    return df.join(ids.select(key), key, "left_semi")


def delete_by_ids(df: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def count_vectors(vectors: DataFrame, kbs: DataFrame) -> DataFrame:
    """``(kb_id, vectors)`` for every knowledge base, 0 for an empty one."""
    counts = vectors.groupBy("kb_id").agg(F.count(F.lit(1)).alias("vectors"))
    return kbs.select("kb_id").join(counts, "kb_id", "left").na.fill(0, ["vectors"])


def unit_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and which of them had a direction at all."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    sound = norms > 0
    return matrix / np.where(sound, norms, 1.0)[:, None], sound


def _single(units: np.ndarray) -> np.ndarray:
    """Rows in single precision, zeros for those that hold no number."""
    return np.where(np.isfinite(units).all(1, keepdims=True), units, 0.0).astype(np.float32)


class Nearest:
    """The ``k`` nearest vectors per query over a stream of vector blocks.

    Holds at most ``k`` matches per query plus one block of candidates, so a task's memory
    depends on neither the number of vectors nor the size of a knowledge base.
    """

    cells = 2_000_000

    def __init__(self, query_ids: np.ndarray, matrix: np.ndarray, k: int) -> None:
        self.ids = query_ids
        self.units, self.sound = unit_rows(matrix)
        self.k = k
        self.worst = np.full(len(query_ids), np.inf)
        self.best = pa.table(
            {"q": pa.array([], pa.int64()), "d": pa.array([], pa.float64()), "v": pa.array([], pa.string())}
        )

    def add(self, vec_ids: pa.Array, matrix: np.ndarray, met: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """Take in a block. With ``met``, a table of queries by groups and the group of each vector,
        a query looks at the vectors of its groups only.

        Products in single precision, with room for their error, leave few pairs, and only for
        these is the distance computed, in double precision.
        """
        units, sound = unit_rows(matrix)
        plain, here = _single(units), np.isfinite(units).all(1)
        room = 4 * (matrix.shape[1] + 4) * 2.0**-24
        pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width = max(1, self.cells // max(1, len(vec_ids)))
        for start in range(0, len(self.ids), width):
            rows = slice(start, start + width)
            asked = self.units[rows]
            near = _single(asked) @ plain.T
            near[~np.isfinite(asked).all(1)] = -np.inf
            near[:, ~here] = -np.inf
            near[~self.sound[rows]] = -1.0
            near[:, ~sound] = -1.0
            if met is not None:
                near[~met[0][rows][:, met[1]]] = -np.inf
            bound = 1 - self.worst[rows]
            if near.shape[1] > self.k and not np.isfinite(bound).all():
                # The k-th of the greatest of some groups is no greater than the k-th of all.
                size = near.shape[1] // 8
                tops = near[:, : 8 * size].reshape(len(near), 8, size).max(1) if size >= self.k else near
                bound = np.maximum(bound, np.partition(tops, tops.shape[1] - self.k, axis=1)[:, -self.k])
            q, v = np.nonzero(near >= (np.maximum(bound, -3.0) - room)[:, None])
            q += start
            # adding zero turns a negative zero into a plain one
            distance = np.round(1.0 - np.einsum("ij,ij->i", self.units[q], units[v]), DISTANCE_PLACES) + 0.0
            distance[~(self.sound[q] & sound[v])] = NO_DIRECTION
            close = distance <= self.worst[q]
            pending.append((q[close], distance[close], v[close]))
            if sum(len(x[0]) for x in pending) >= self.cells:
                self._merge_all(pending, vec_ids)
                pending = []
        self._merge_all(pending, vec_ids)

    def _merge_all(self, pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]], vec_ids: pa.Array) -> None:
        if any(len(x[0]) for x in pending):
            q, d, v = (np.concatenate(x) for x in zip(*pending))
            self._merge(q, d, vec_ids.take(pa.array(v)))

    def _merge(self, q: np.ndarray, d: np.ndarray, v: pa.Array) -> None:
        fresh = pa.table({"q": pa.array(q, pa.int64()), "d": pa.array(d, pa.float64()), "v": v})
        merged = pa.concat_tables([self.best, fresh]).sort_by(
            [("q", "ascending"), ("d", "ascending"), ("v", "ascending")]
        )
        groups = merged["q"].to_numpy()
        place = np.arange(len(groups)) - np.searchsorted(groups, groups)
        self.best = merged.filter(pa.array(place < self.k)).combine_chunks()
        full = np.flatnonzero(place == self.k - 1)
        self.worst[groups[full]] = merged["d"].to_numpy()[full]

    def result(self) -> pa.Table:
        return pa.table(
            {
                "query_id": pa.array(self.ids[self.best["q"].to_numpy()], pa.string()),
                "vec_id": self.best["v"],
                "distance": self.best["d"],
            }
        )


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as a float64 matrix; rows of differing width are an error."""
    if column.null_count:
        raise ValueError("vector without a value")
    widths = np.unique(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    if len(widths) > 1:
        raise ValueError(f"vectors of different widths: {widths.tolist()}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _groups(column: pa.Array) -> Iterator[tuple[object, np.ndarray]]:
    """Distinct values of a column with their row numbers, found by one sort."""
    coded = column.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
    for code, value in enumerate(coded.dictionary.to_pylist()):
        yield value, order[ends[code] : ends[code + 1]]


def _nearest(queries: pa.Table, k: int) -> dict[object, Nearest]:
    """A ``Nearest`` per knowledge base that is asked about."""
    queries = queries.combine_chunks()
    if not queries.num_rows:
        return {}
    ids = np.array(queries["query_id"].to_pylist(), dtype=object)
    matrix = _matrix(queries["embedding"].combine_chunks())
    kbs = queries["kb_id"].combine_chunks()
    return {kb: Nearest(ids[rows], matrix[rows], k) for kb, rows in _groups(kbs)}


def _resident_matches(vectors: DataFrame, queries: pa.Table, k: int) -> DataFrame:
    """Few queries: every task holds them all and reads its own vectors, no shuffle."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _nearest(queries, k)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("vec_id").cast(pa.string())
            matrix = _matrix(batch.column("embedding"))
            for kb, rows in _groups(batch.column("kb_id")):
                if kb in asked:
                    asked[kb].add(ids.take(pa.array(rows)), matrix[rows])
        for nearest in asked.values():
            yield from nearest.result().to_batches()

    return vectors.mapInArrow(search, MATCHES)


def _tiled_matches(
    vectors: DataFrame, queries: DataFrame, k: int, tile: int, cells: Cells | None = None, probes: int = 0
) -> DataFrame:
    """Many queries: tiles of at least ``tile`` vectors by four times as many queries.

    A large knowledge base becomes many tiles, so no task holds all of it; each tile returns
    only its ``k`` best per query. Tiles are wider in queries, because each block of queries
    costs one more copy of the vectors in the shuffle. A knowledge base gets no more than
    ``MOST_BLOCKS`` blocks of vectors while a block holds up to ``BLOCK_NUMBERS`` numbers.

    With ``cells``, vectors carry their ``cell``; a block holds whole cells, or parts of a crowded
    one, and a query goes once to each block that holds one of the cells it looks into, with a bit
    for each of them, however many those are.
    """

    # fresh column identities, since queries are often picked from the vectors themselves
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])
    where = F.col("cell") if cells else F.lit(0)
    counts = vectors.groupBy("kb_id", where.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")
    )
    rows = F.greatest(
        F.lit(tile),
        F.least(F.ceil(F.col("n") / MOST_BLOCKS), F.floor(F.lit(BLOCK_NUMBERS) / F.greatest("width", F.lit(1)))),
    )
    crowded = F.filter("held", lambda c: c["n"] > F.col("rows"))
    parts = F.transform(crowded, lambda c: F.struct(c["cell"], F.ceil(c["n"] / F.col("rows")).cast("int").alias("parts")))
    held = F.collect_list(F.struct("cell", "n")) if cells else F.array().cast("array<struct<cell:int,n:long>>")
    asked = queries.groupBy("kb_id").agg(F.count(F.lit(1)).alias("asked"))
    grid = (
        counts.groupBy("kb_id").agg(F.sum("n").alias("n"), F.max("width").alias("width"), held.alias("held"))
        .join(asked, "kb_id")
        .withColumn("rows", rows)
        .select(
            "kb_id",
            F.ceil(F.col("n") / F.col("rows")).cast("int").alias("v_blocks"),
            F.ceil(F.col("asked") / (4 * F.col("rows"))).cast("int").alias("q_blocks"),
            F.map_from_entries(parts).alias("crowded"),
        )
    )

    def spread(key: str, over: Column) -> Column:
        return F.pmod(F.xxhash64(key), over).cast("int")

    def every(n: Column) -> Column:
        return F.sequence(F.lit(0), n - 1)

    def in_parts(cell: Column) -> Column:
        return F.coalesce(F.try_element_at("crowded", cell), F.lit(1))

    v_blocks = F.col("v_blocks")
    v = vectors.join(grid, "kb_id")
    q = queries.join(grid, "kb_id")
    if cells:
        own = F.pmod(F.col("cell") + spread("vec_id", in_parts(F.col("cell"))), v_blocks)
        q = q.withColumn("_probed", _probed(cells, probes)("embedding"))
        there = lambda c: F.transform(every(in_parts(c)), lambda j: F.pmod(c + j, v_blocks))
        blocks = F.array_distinct(F.flatten(F.transform("_probed.cells", there)))
        bits = F.col("_probed.bits").alias("bits")
    else:
        own, blocks, bits = spread("vec_id", v_blocks), every(v_blocks), F.lit(None).cast("binary").alias("bits")
    v = v.select(*vectors.columns, own.alias("v_block"), F.explode(every(F.col("q_blocks"))).alias("q_block"))
    q = q.select(*queries.columns, bits, spread("query_id", F.col("q_blocks")).alias("q_block"), F.explode(blocks).alias("v_block"))
    tiles = ["kb_id", "v_block", "q_block"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [Nearest(np.zeros(0, object), np.zeros((0, 1)), k)]
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            vec_ids = left["vec_id"].combine_chunks().cast(pa.string())
            matrix = _matrix(left["embedding"].combine_chunks())
            ids = np.array(right["query_id"].to_pylist(), dtype=object)
            sought = _matrix(right["embedding"].combine_chunks())
            whole = Nearest(ids, sought, k)
            if not cells:
                whole.add(vec_ids, matrix)
                found.append(whole)
            else:
                here, group = np.unique(left["cell"].to_numpy(), return_inverse=True)
                packed = np.frombuffer(b"".join(right["bits"].to_pylist()), np.uint8).reshape(len(ids), -1)
                met = (packed[:, here >> 3] >> (here & 7).astype(np.uint8) & 1).astype(bool)
                if 4 * (met.sum(0) * np.bincount(group)).sum() >= met.shape[0] * len(group):
                    whole.add(vec_ids, matrix, None if met.all() else (met, group))
                    found.append(whole)
                else:
                    for one in range(len(here)):
                        some, mine = np.flatnonzero(met[:, one]), np.flatnonzero(group == one)
                        part = Nearest(ids[some], sought[some], k)
                        part.add(vec_ids.take(pa.array(mine)), matrix[mine])
                        found.append(part)
        return pa.concat_tables([nearest.result() for nearest in found])

    return v.groupBy(*tiles).cogroup(q.groupBy(*tiles)).applyInArrow(search, MATCHES)


def _scope(scoped: bool) -> Column:
    """The kb of a row, or the same for all; no literal, so that a join by it keeps its key."""
    return (F.col("kb_id") if scoped else F.concat_ws("", F.left("kb_id", F.lit(0)))).alias("kb_id")


def vector_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    where: Mapping[str, object] | None = None,
    scoped: bool = True,
    resident_queries: int = 4096,
    tile: int = 8192,
) -> DataFrame:
    """Exact ``k`` nearest vectors by cosine distance for all queries at once.

    ``vectors(kb_id, vec_id, embedding)``, ``queries(query_id, kb_id, embedding)`` ->
    ``(query_id, vec_id, distance, rank)``, nearest first, ties by id. ``scoped`` keeps a
    query inside its knowledge base. Up to ``resident_queries`` queries travel with the tasks
    and vectors are not shuffled; more are laid out in tiles of at least ``tile`` vectors.
    """
    v = where_equals(vectors, where).select(_scope(scoped), "vec_id", "embedding")
    q = queries.select("query_id", _scope(scoped), "embedding")
    return _ranked(v, q, k, resident_queries, tile)


def _ranked(
    vectors: DataFrame, queries: DataFrame, k: int, resident_queries: int, tile: int
) -> DataFrame:
    held = queries.limit(resident_queries + 1).toArrow()
    if held.num_rows <= resident_queries:
        matches = _resident_matches(vectors, held, k)
    else:
        matches = _tiled_matches(vectors, queries, k, tile)
    order: list[Column] = [F.col("distance"), F.col("vec_id")]
    return top_k(matches, ["query_id"], order, k, "rank")


def cosine_distance(a: Column, b: Column) -> Column:
    """Cosine distance of two array columns, in double precision."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, F.round(1 - dot(a, b) / norms, DISTANCE_PLACES)).otherwise(
        F.lit(NO_DIRECTION)
    )


@dataclass(frozen=True)
class Cells:
    """Trained cells: a vector lies where the product of its direction and ``centres``, plus ``lift``, is largest."""

    centres: np.ndarray
    lift: np.ndarray
    probes: int

    def scores(self, matrix: np.ndarray) -> np.ndarray:
        if not self.centres.size:  # trained on nothing
            return np.zeros((len(matrix), len(self.lift)))
        return unit_rows(matrix)[0] @ self.centres.T + self.lift

    def nearest(self, vectors: pd.Series, n: int) -> np.ndarray:
        """The ``n`` best cells of each vector; a bounded block of scores at a time."""
        found = np.empty((len(vectors), n), np.int32)
        for start in range(0, len(vectors), 1024):
            part = vectors.iloc[start : start + 1024].to_numpy()
            scores = self.scores(np.stack(part).astype(np.float64))
            found[start : start + 1024] = np.argsort(-scores, axis=1, kind="stable")[:, :n]
        return found


def _balanced_centres(units: np.ndarray, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means whose crowded centres lose pull while empty ones move.

    The round with the least sum of squared sizes, which is what probing a cell costs, stands.
    """
    random = np.random.default_rng(seed)
    centres = units[random.choice(len(units), count, replace=False)]
    lift, best = np.zeros(count), (np.inf, centres, np.zeros(count))
    for turn in range(CELL_ROUNDS):
        scores = units @ centres.T + lift
        own = scores.argmax(1)
        sizes = np.bincount(own, minlength=count)
        cost = float((sizes.astype(np.float64) ** 2).sum())
        if turn and cost < best[0]:
            best = cost, centres, lift
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
        margin = np.diff(np.partition(scores, -2, axis=1)[:, -2:], axis=1).mean() if count > 1 else 0.0
        lift = lift - 0.05 * margin * np.log((sizes + 1) / (sizes.mean() + 1))
        empty = np.flatnonzero(sizes == 0)
        centres[empty] = units[random.choice(len(units), len(empty))]
        lift[empty] = lift.mean()
    return best[1], best[2]


def train_cells(
    vectors: DataFrame,
    k: int = TOP_K,
    recall: float = 0.95,
    scoped: bool = True,
    most_cells: int = 1024,
    sample: int = 16_384,
    seed: int = 7,
) -> Cells:
    """Cells for ``vector_topk_ann``, as many as the root of the number of vectors, at most ``most_cells``.

    Learned on some ``sample`` vectors (all, if there are fewer), picked by a hash of their id.
    Probes are as many as the sample's own neighbours (those of the same kb, if ``scoped``) need
    to be found with probability ``recall``; the sample is thinner than the table, so neighbours
    in the table lie closer. Train on the filtered vectors where a filter is rare.
    """
    total = vectors.count()
    share = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) < int(min(1.0, sample / max(total, 1)) * (1 << 30))
    held = (
        vectors.filter(share & F.col("embedding").isNotNull()).select("vec_id", "kb_id", "embedding")
        .limit(2 * sample).toArrow().combine_chunks().sort_by([("vec_id", "ascending")])
    )
    if not held.num_rows:
        return Cells(np.zeros((1, 0)), np.zeros(1), 1)
    units = unit_rows(_matrix(held["embedding"].combine_chunks()))[0]
    count = int(np.clip(np.sqrt(total), 1, min(most_cells, len(units))))
    centres, lift = _balanced_centres(units, count, seed)
    scores = units @ centres.T + lift
    own = scores.argmax(1)
    asked = np.random.default_rng(seed).permutation(len(units))[:256]
    likeness = units[asked] @ units.T
    likeness[np.arange(len(asked)), asked] = -np.inf
    if scoped:
        kbs = held["kb_id"].to_numpy(zero_copy_only=False)
        likeness[kbs[asked][:, None] != kbs[None, :]] = -np.inf
    near = np.argsort(-likeness, axis=1, kind="stable")[:, :k]
    there = np.isfinite(np.take_along_axis(likeness, near, 1))
    places = np.argsort(np.argsort(-scores[asked], axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(places, own[near], 1)[there]) + 1
    probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if len(needed) else count
    return Cells(centres, lift, probes)


def assign_cells(vectors: DataFrame, cells: Cells) -> DataFrame:
    """Vectors with their ``cell``; a table partitioned by it is read only where probed."""

    def cell(vectors: pd.Series) -> pd.Series:
        return pd.Series(cells.nearest(vectors, 1)[:, 0])

    return vectors.withColumn("cell", F.pandas_udf(cell, T.IntegerType())("embedding"))


def _probed(cells: Cells, probes: int):
    """The cells that a vector looks into: their numbers, and a bit for each cell there is."""

    def probed(vectors: pd.Series) -> pd.DataFrame:
        found = cells.nearest(vectors, probes)
        marks = np.zeros((len(found), len(cells.lift)), bool)
        np.put_along_axis(marks, found, True, axis=1)
        bits = np.packbits(marks, axis=1, bitorder="little")
        return pd.DataFrame({"cells": list(found), "bits": [row.tobytes() for row in bits]})

    return F.pandas_udf(probed, "cells array<int>, bits binary")


def probed_cells(queries: DataFrame, cells: Cells, probes: int) -> DataFrame:
    """A row for each ``cell`` that a query looks into."""

    def near(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(cells.nearest(vectors, probes)))

    found = F.pandas_udf(near, T.ArrayType(T.IntegerType()))("embedding")
    return queries.withColumn("cell", F.explode(found))


def vector_topk_ann(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    cells: Cells | None = None,
    probes: int | None = None,
    where: Mapping[str, object] | None = None,
    scoped: bool = True,
    resident_queries: int = 4096,
    tile: int = 8192,
) -> DataFrame:
    """Approximate neighbours: exact ranking, but only in the cells nearest to each query.

    ``vectors`` may carry ``cell`` from ``assign_cells`` with the same ``cells``; without cells
    they are trained on the vectors that satisfy ``where``. A vector lies in one cell, so no pair
    is met twice. Up to ``resident_queries`` pairs of a query and a cell travel with the tasks;
    with more, cells are gathered into tiles and crowded ones split. Recall against
    ``vector_topk`` is reported by ``ann_recall``; probing every cell gives its exact answer.
    """
    vectors = where_equals(vectors, where)
    if cells is None:
        cells, vectors = train_cells(vectors, k, scoped=scoped), vectors.drop("cell")
    if "cell" not in vectors.columns:
        vectors = assign_cells(vectors, cells)
    probes = min(probes or cells.probes, len(cells.lift))
    place = F.concat_ws("|", "kb_id", F.col("cell").cast("string")).alias("kb_id")
    v = vectors.select(_scope(scoped), "vec_id", "embedding", "cell")
    q = queries.select("query_id", _scope(scoped), "embedding")
    held = probed_cells(q, cells, probes).select("query_id", place, "embedding").limit(resident_queries + 1).toArrow()
    if held.num_rows <= resident_queries:
        matches = _resident_matches(v.select(place, "vec_id", "embedding"), held, k)
    else:
        matches = _tiled_matches(v, q, k, tile, cells, probes)
    return top_k(matches, ["query_id"], [F.col("distance"), F.col("vec_id")], k, "rank")


def ann_recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Per query, how many of the exact neighbours the approximate answer has."""
    keys = ["query_id", "vec_id"]
    found = approximate.select(*keys, F.lit(1).alias("found"))
    return (
        exact.join(found, keys, "left")
        .groupBy("query_id")
        .agg(F.count("found").alias("found"), F.count(F.lit(1)).alias("expected"))
        .withColumn("recall", F.col("found") / F.col("expected"))
    )
