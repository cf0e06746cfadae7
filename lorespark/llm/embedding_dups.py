"""Near-duplicate vectors: learnt balanced binary codes, multi-index Hamming tables, exact rerank.

An iterative-quantisation rotation is learnt on a bounded sample: the centred unit vectors are
turned to their principal axes, then rotated so that their signs lie as close to them as possible.
The bits of one or more such rotations are cut into substrings, one Hamming table each. Vectors
that meet in a table are compared by their cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.components import components
from lorespark.session import durable

SAMPLE = 4096
ROUNDS = 25
MOST_TABLES = 40
BLOCK = 1024


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one. Scaling by the largest entry first keeps squares from over- or underflowing."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def learn_rotation(sample: np.ndarray, seed: int) -> np.ndarray:
    """Directions whose signs are the bits: principal axes times the rotation that quantises best."""
    random = np.random.default_rng(seed)
    _, axes = np.linalg.eigh(sample.T @ sample)
    turned = sample @ axes
    rotation, _ = np.linalg.qr(random.standard_normal(axes.shape))
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(turned.T @ np.where(turned @ rotation >= 0, 1.0, -1.0))
        rotation = left @ right
    return axes @ rotation


def plain_tables(bits: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits a substring and tables of random planes in which pairs at ``threshold`` meet with ``recall``."""
    kept = 1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi
    while True:
        apart = 1 - kept**bits
        tables = int(np.ceil(np.log(1 - recall) / np.log(apart))) if 0 < apart < 1 else 1
        if tables <= MOST_TABLES or bits == 1:
            return bits, tables
        bits -= 1


class Codes:
    """Tables of ``bits``-bit substrings over learnt directions.

    Tables are added until sample vectors and copies turned to just ``threshold`` from them meet
    in one with probability ``recall``. Vectors of a width other than the sample's get planes of
    their own that nothing is learned for: whatever the vectors, such a plane parts a pair with the
    share its angle has in a half turn, and this says how many tables the same ``recall`` takes.
    """

    def __init__(self, sample: np.ndarray, bits: int, threshold: float, recall: float, seed: int = 7):
        self.bits, self.seed, self.width = bits, seed, sample.shape[1]
        self.plain_bits, self.plain_tables = plain_tables(bits, threshold, recall)
        unit = units(sample)
        aside = np.random.default_rng(seed).standard_normal(unit.shape)
        aside -= (aside * unit).sum(1, keepdims=True) * unit
        length = np.sqrt((aside * aside).sum(1, keepdims=True))
        aside /= np.where(length > 0, length, 1)
        near = threshold * unit + np.sqrt(max(0.0, 1 - threshold**2)) * aside
        # Vectors crowded closer than the threshold leave nothing to centre: planes through zero then.
        # Where the most tables are too few, shorter substrings meet more often.
        while not any(self._learn(unit, near, recall, mean) for mean in (unit.mean(0), np.zeros(self.width))):
            self.bits -= 1
            if not self.bits:
                raise ValueError(f"no tables meet pairs at {threshold} with probability {recall}")

    def _learn(self, unit: np.ndarray, near: np.ndarray, recall: float, mean: np.ndarray) -> bool:
        self.mean = mean
        self.directions, self.tables, rotations = np.zeros((self.width, 0)), 0, 0
        met = np.zeros(len(unit), bool)
        while met.mean() < recall and self.tables < MOST_TABLES:
            rotation = learn_rotation(unit - self.mean, self.seed + rotations)
            self.directions, rotations = np.concatenate([self.directions, rotation], 1), rotations + 1
            while met.mean() < recall and (self.tables + 1) * self.bits <= self.directions.shape[1]:
                met |= self._values(unit, self.tables) == self._values(near, self.tables)
                self.tables += 1
        self.directions = self.directions[:, : self.tables * self.bits]
        return met.mean() >= recall

    def _values(self, unit: np.ndarray, table: int) -> np.ndarray:
        directions = self.directions[:, table * self.bits : (table + 1) * self.bits]
        return ((unit - self.mean) @ directions >= 0) @ (1 << np.arange(self.bits, dtype=np.int64))

    def values(self, unit: np.ndarray) -> np.ndarray:
        """The substring of each table, a column each."""
        width, bits, tables = unit.shape[1], self.bits, self.tables
        if width == self.width:
            signs = (unit - self.mean) @ self.directions >= 0
        else:
            bits, tables = self.plain_bits, self.plain_tables
            random = np.random.default_rng([self.seed, width])
            signs = unit @ random.standard_normal((width, tables * bits)) >= 0
        return signs.reshape(len(unit), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def local_roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``size`` nodes the smallest node that the links ``a, b`` lead to."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def by_width(vectors: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    widths = vectors.map(len).to_numpy()
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        yield at, units(np.stack(vectors.iloc[at].to_numpy()).astype(np.float64))


def code_rows(batches: Iterator[pd.DataFrame], codes: Codes) -> Iterator[pd.DataFrame]:
    """``cls, label, width, codes``: the substrings of each vector, one for each table."""
    for batch in batches:
        for at, unit in by_width(batch["embedding"]):
            yield pd.DataFrame({
                "cls": batch["cls"].to_numpy()[at],
                "label": batch["label"].to_numpy()[at],
                "width": unit.shape[1],
                "codes": list(codes.values(unit)),
            })


def tile_links(rows: pd.DataFrame, unit: np.ndarray, values: np.ndarray, threshold: float) -> pd.DataFrame | None:
    """The links between the two blocks of one tile, as counts and roots and never as pairs."""
    low, high = rows["low"].iat[0], rows["high"].iat[0]
    block = rows["block"].to_numpy()
    first, second = np.flatnonzero(block == low), np.flatnonzero(block == high)
    i, j = np.nonzero(unit[first] @ unit[second].T >= threshold)
    a, b = first[i], second[j]
    if low == high:
        a, b = a[a < b], b[a < b]
    # A pair that meets in several tables counts in the first of them.
    once = (values[a] == values[b]).argmax(1) == rows["place"].iat[0]
    a, b = a[once], b[once]
    if not len(a):
        return None
    weights = rows["copies"].to_numpy()
    links = np.zeros(len(rows), np.int64)
    np.add.at(links, a, weights[b])
    np.add.at(links, b, weights[a])
    root = local_roots(len(rows), a, b)
    met = np.unique(np.concatenate([a, b]))
    ids = rows["cls"].to_numpy()
    return pd.DataFrame({"cls": ids[met], "links": links[met], "root": ids[root[met]]})


def compare_tiles(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Batches sorted by tile to the links of each tile; a tile may lie across batches."""
    keys = ["label", "width", "place", "value", "low", "high"]

    def tiles(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        cuts = np.flatnonzero((rows[keys].to_numpy()[1:] != rows[keys].to_numpy()[:-1]).any(1)) + 1
        edges = [0, *cuts.tolist(), len(rows)]
        unit = np.empty(len(rows), object)
        for at, part in by_width(rows["embedding"]):
            for k, row in zip(at, part):
                unit[k] = row
        for start, end in zip(edges, edges[1:]):
            if end - start > 1:
                values = np.stack(rows["codes"].iloc[start:end].to_numpy())
                found = tile_links(rows.iloc[start:end], np.stack(unit[start:end]), values, threshold)
                if found is not None:
                    yield found

    rest = None
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        same = (rows[keys].to_numpy() == rows[keys].iloc[-1].to_numpy()).all(1)
        start = len(rows) - int(same[::-1].argmin()) if not same.all() else 0
        rest = rows.iloc[start:].reset_index(drop=True)
        if start:
            yield from tiles(rows.iloc[:start].reset_index(drop=True))
    if rest is not None:
        yield from tiles(rest)


def embedding_links(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.995) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``.

    Rows of equal label and width are linked when they meet in a table and their cosine is at
    least ``threshold``. A vector that is null, empty, zero or holds null or non-finite entries,
    or whose label is null, has no link and is its own component. Copies are one row in the
    tables, weighted by their number. Repeated rows link with each other; of rows with the
    component's id each counts as kept. A null id names a component only if all its ids are null.
    Other columns are ignored.

    Substrings are as long as the logarithm of the number of vectors, so a table's lists stay
    short as data grows. A long list (many near copies) is split into blocks of ``BLOCK`` that are
    compared in pairs of blocks, each a task's small share.
    """
    usable = F.col("label").isNotNull() & F.coalesce(
        (F.size("embedding") > 0)
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    rows = durable(vectors.select(
        "vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"),
    ).withColumn("usable", usable)
     # Two hashes of different seeds stand for the vector.
     .withColumn("one", F.xxhash64(F.lit(1), "embedding")).withColumn("two", F.xxhash64(F.lit(2), "embedding")))
    same = ["label", "one", "two"]
    classes = durable(
        rows.filter("usable").groupBy(*same)
        .agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .withColumn("width", F.size("embedding")).withColumn("cls", F.monotonically_increasing_id())
    )
    alone = rows.filter("not usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    commonest = classes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()
    if commonest is None:
        return alone
    sample = (
        classes.filter(F.col("width") == commonest["width"]).select("one", "two", "embedding")
        .orderBy("one", "two").limit(SAMPLE).collect()
    )
    total = classes.count()
    bits = int(np.clip(np.round(np.log2(max(total, 2))), 6, 40))
    codes = Codes(np.array([r["embedding"] for r in sample], np.float64), bits, threshold, recall)

    table = ["label", "width", "place", "value"]
    # The substrings travel with the vectors: made again from another block, a sign within the
    # rounding could differ, and a pair would count twice or not at all.
    coded = durable(classes.select("cls", "label", "embedding").mapInPandas(
        lambda batches: code_rows(batches, codes), "cls long, label string, width int, codes array<long>"
    ))
    keyed = coded.select("cls", "label", "width", F.posexplode("codes").alias("place", "value"))
    met = keyed.groupBy(*table).agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    tiles = (
        keyed.join(met, table)
        .withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
        .join(classes.select("cls", "embedding", "copies"), "cls").join(coded.select("cls", "codes"), "cls")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
        .select(*table, "low", "high", "block", "cls", "copies", "codes", "embedding")
        .repartition(*table, "low", "high").sortWithinPartitions(*table, "low", "high")
    )
    found = durable(tiles.mapInPandas(
        lambda batches: compare_tiles(batches, threshold), "cls long, links long, root long"
    ))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found, "cls", "root").withColumnRenamed("node", "cls")
    joined = durable(
        classes.select(*same, "cls", "first", "copies").join(links, "cls", "left").join(roots, "cls", "left")
        .withColumn("root", F.coalesce("root", "cls"))
        .withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    )
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(least, "root").select(*same, "n_links", "component_id")
    linked = rows.filter("usable").select("vec_id", *same).join(named, same).select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
    return linked.unionByName(alone)
