"""Operator 8: SimHash near-duplicates by tiled exact comparison.

Equal fingerprints are one. Each distinct fingerprint is put into tiles by the bit counts of
its eight bytes: its own counts, and those that differ by one in one byte. Two fingerprints
within two bits differ by at most two in the sum over their byte counts, so they share a tile;
pairs of tiles whose bit counts differ by more are never met. Inside a tile all pairs are
compared with exclusive-or and bit counts, in blocks. Links become components by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.llm.batches import map_texts
from corpus_engine.shared import materialize, partitions, ship

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Fingerprints of a tile that are compared at once: blocks of BLOCK * BLOCK pairs.
BLOCK = 1024
#: Tiles above this many fingerprints are split into pairs of slices, each a task's work.
TILE_ROWS = 65_536


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half the shingles' hashes, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[min(size, len(words)) - 1 :][:n] - 1).tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs(text, *keep) -> keep, fp long (the 64 bits, signed). Null and blank texts: 0."""

    def work():
        def do(texts: list[str | None]) -> list[pa.Array]:
            return [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64), pa.int64())]

        return do

    return map_texts(docs, keep, "text", work, "fp bigint")


def byte_counts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the eight bytes of each fingerprint."""
    return np.bitwise_count(fps.astype("<i8").view(np.uint8).reshape(-1, 8))


def tiles_of(fps: np.ndarray) -> np.ndarray:
    """(n, 17) tile keys, four bits a byte; -1 where a count would leave 0 to 8."""
    counts = byte_counts(fps).astype(np.int64)
    place = np.int64(1) << (4 * np.arange(8, dtype=np.int64))
    own = (counts * place).sum(1)
    up = np.where(counts < 8, own[:, None] + place, -1)
    down = np.where(counts > 0, own[:, None] - place, -1)
    return np.concatenate([own[:, None], up, down], axis=1)


def spread(distinct: DataFrame) -> DataFrame:
    """distinct(fp) -> (tile, fp), 17 rows a fingerprint at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 50_000):
                part = fps[at : at + 50_000]
                tiles = tiles_of(part).ravel()
                held = tiles >= 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tiles[held]), pa.array(np.repeat(part, 17)[held])], names=["tile", "fp"]
                )

    return distinct.select("fp").mapInArrow(run, "tile bigint, fp bigint")


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of pairs within the radius; both sides are sorted by bit count.

    Blocks of pairs whose bit counts lie further apart than the radius are skipped.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    count_left, count_right = np.bitwise_count(left), np.bitwise_count(right)
    for i in range(0, len(left), BLOCK):
        a, low, high = left[i : i + BLOCK], int(count_left[i]), int(count_left[min(i + BLOCK, len(left)) - 1])
        for j in range(0, len(right), BLOCK):
            b = right[j : j + BLOCK]
            if int(count_right[j]) > high + radius or int(count_right[min(j + BLOCK, len(right)) - 1]) < low - radius:
                continue
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            found.append((x + i, y + j))
    if not found:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


class Forest:
    """Links of one task that join something new; the others add nothing to the components."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    def joins(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _links(forest: Forest, left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    a, b = left[i].view(np.int64), right[j].view(np.int64)
    return [(x, y) for x, y in zip(a.tolist(), b.tolist()) if x != y and forest.joins(x, y)]


def _small_tiles(tiles: np.ndarray, fps: np.ndarray, starts: np.ndarray, forest: Forest) -> list[tuple[int, int]]:
    """All pairs of many tiles at once: each row meets the k-th after it, while their tile is one."""
    links: list[tuple[int, int]] = []
    last = np.repeat(np.append(starts[1:], len(tiles)), np.diff(np.append(starts, len(tiles))))
    at, k = np.arange(len(tiles)), 1
    while len(at := at[at + k < last[at]]):
        near = at[np.bitwise_count(fps[at] ^ fps[at + k]) <= RADIUS]
        links += _links(forest, fps, fps, near, near + k)
        k += 1
    return links


def compare_tiles(rows: DataFrame) -> DataFrame:
    """(tile, fp), a tile within one partition and sorted -> links (a, b) that keep the components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done(tiles: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(tiles):
                return
            starts = np.flatnonzero(np.append(True, tiles[1:] != tiles[:-1]))
            sizes = np.diff(np.append(starts, len(tiles)))
            large = np.repeat(sizes > 64, sizes)
            few_tiles, few = tiles[~large], fps[~large]
            links = _small_tiles(few_tiles, few, np.flatnonzero(np.append(True, few_tiles[1:] != few_tiles[:-1])), forest) if len(few) else []
            for start, size in zip(starts[sizes > 64], sizes[sizes > 64]):
                own = fps[start : start + size]
                own = own[np.argsort(np.bitwise_count(own), kind="stable")]
                for i in range(0, len(own), BLOCK):
                    x, y = close_pairs(own[i : i + BLOCK], own[i:])
                    links += _links(forest, own[i : i + BLOCK], own[i:], x, y)
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            if sum(len(t) for t, _ in held) < 200_000:
                continue
            tiles, fps = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            cut = int(np.searchsorted(tiles, tiles[-1]))  # the last tile may go on
            yield from done(tiles[:cut], fps[:cut])
            held = [(tiles[cut:], fps[cut:])]
        if held:
            yield from done(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))

    return rows.mapInArrow(run, "a bigint, b bigint")


def compare_slices(rows: DataFrame) -> DataFrame:
    """Large tiles: (tile, i, j, side, fp), one pair of slices in a group -> links (a, b)."""

    def pair(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        side = table.column("side").to_numpy()
        left, right = (x[np.argsort(np.bitwise_count(x), kind="stable")] for x in (fps[side == 0], fps[side == 1]))
        right = right if len(right) else left
        forest, links = Forest(), []
        for i in range(0, len(left), BLOCK):
            x, y = close_pairs(left[i : i + BLOCK], right)
            links += _links(forest, left[i : i + BLOCK], right, x, y)
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("tile", "i", "j").applyInArrow(pair, "a bigint, b bigint")


def links(distinct: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """distinct(fp) -> (a, b): pairs within the radius, enough of them to connect each component.

    Tiles above tile_rows are cut into slices by the fingerprint's hash; every pair of slices is
    a group of its own, so no task holds more than two slices.
    """
    ship(distinct.sparkSession)
    tiled = materialize(spread(distinct), "simhash-tiles")
    large = tiled.groupBy("tile").count().where(F.col("count") > tile_rows)
    large = materialize(
        large.select(F.col("tile").alias("_tile"), F.ceil(F.col("count") / F.lit(tile_rows / 2)).cast("int").alias("_n")),
        "simhash-large",
    )
    if large.isEmpty():
        small = tiled
        found = None
    else:
        small = tiled.join(large, F.col("tile") == F.col("_tile"), "left_anti")
        cut = tiled.join(large, F.col("tile") == F.col("_tile")).withColumn(
            "s", F.pmod(F.xxhash64("fp"), F.col("_n")).cast("int")
        )
        other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
        met = cut.withColumn("o", other)
        pairs = met.select(
            "tile", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"),
            (F.col("s") > F.col("o")).cast("int").alias("side"), "fp",
        )
        found = compare_slices(pairs)
    n = partitions(distinct.sparkSession)
    near = compare_tiles(small.repartition(n, "tile").sortWithinPartitions("tile"))
    return near if found is None else near.unionByName(found)


def components(edges: DataFrame, name: str = "component") -> DataFrame:
    """edges(a, b) -> (node, root): the smallest node reachable, for all nodes with an edge.

    Large-star and small-star steps in turn, each a grouped aggregate and a written table, until
    the edges form stars. Hot nodes lose their edges to the smallest neighbour step by step; the
    steps use joins, not grouped lists, so that no node's neighbours meet in one row.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "_u")
        joined = both.join(smallest, F.col("u") == F.col("_u"))
        if large:
            moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            down = joined.where(F.col("v") < F.col("u"))
            moved = down.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
                smallest.where(F.col("m") < F.col("_u")).select(F.col("_u").alias("a"), F.col("m").alias("b"))
            )
        return moved.where(F.col("a") != F.col("b")).distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    pairs = materialize(edges.where(F.col("a") != F.col("b")).distinct(), name)
    pairs = materialize(
        pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    before = None
    while (now := mark(pairs)) != before:
        before = now
        pairs = materialize(star(materialize(star(pairs, True), name), False), name)
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs(doc_id, text) -> keep, fp, component_id, links: one row per row.

    component_id: smallest doc_id of all rows whose fingerprints are linked, directly or in steps.
    Rows of null doc_id take part but give no id; if all of a component do, it is null. Blank and
    null texts share the fingerprint 0. Equal rows keep a row each. links: whether the fingerprint
    has a link to another one. No rows: no rows.
    """
    keep = ["doc_id"] if keep is None else keep
    rows = materialize(fingerprints(docs, keep), "simhash-rows")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = materialize(components(links(distinct), "simhash-links"), "simhash-roots")
    linked = distinct.join(roots, F.col("fp") == F.col("node")).drop("node")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "_root")
    named = linked.join(smallest, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id")
    lone = distinct.join(roots.select("node"), F.col("fp") == F.col("node"), "left_anti")
    of = named.withColumn("linked", F.lit(True)).unionByName(
        lone.select(F.col("fp").alias("_fp"), F.col("first_id").alias("component_id"), F.lit(False).alias("linked"))
    )
    return rows.join(of, F.col("fp") == F.col("_fp")).drop("_fp")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op8_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; one row per row, other columns not read.

    Null, empty and blank texts have fingerprint zero and are linked by it. Null doc_ids take part in
    links but name no component; a component of such rows only has none. Texts of any length are
    read whole. No documents: no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash_tiles": op8_simhash_tiles}
ORACLE_SQL: dict[str, str] = {}
