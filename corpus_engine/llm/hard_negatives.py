"""Operator 13: hard negatives by rotated one-bit codes.

A vector x is turned by a fixed random rotation, and what is left of it is replaced, LEVELS times, by the
signs of its components: x = a1*s1 + a2*s2 + ... + r, where s has components of plus or minus
1/sqrt(d), a is the stored alignment of vector and code (their inner product), and r is what no code
holds. For an anchor q the inner products with s come from bit counts over the bit planes of its
rounded components, and since r is at right angles to the last code, Cauchy and Schwarz bound the
rest: |<r, q>| <= |r| * sqrt(|q|^2 - <s, q>^2). The interval is certain, so what lies outside the
window of wanted scores, or below what was found already, is passed by; the others get their
exact score in integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.operators.search import top_k
from corpus_engine.shared import materialize, ship

#: One-bit codes of a vector; bits of an anchor's rounded components.
LEVELS, PLANES = 4, 8
SEED = 13
#: Rows and anchors that meet in a task.
BLOCK, ANCHORS = 16_384, 1024
#: Vectors whose squared length is over this have scores that no long may hold, and take no part.
GREATEST = float(1 << 62)
POSITIVES, NEGATIVES = 5, 3


def rotation(width: int) -> np.ndarray:
    """The same random rotation everywhere."""
    turned, upper = np.linalg.qr(np.random.default_rng((SEED, width)).standard_normal((width, width)))
    return turned * np.sign(np.diag(upper))


def _width(dims: int) -> int:
    return max(64, -(-dims // 64) * 64)


def _turned(x: np.ndarray) -> np.ndarray:
    width = _width(x.shape[1])
    return np.pad(x.astype(np.float64), ((0, 0), (0, width - x.shape[1]))) @ rotation(width).T


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of integers -> (codes uint64 [row, level, word], alignments [row, level], length of the rest)."""
    rest = _turned(x)
    unit = 1 / np.sqrt(rest.shape[1])
    codes, aligned = [], []
    for _ in range(LEVELS):
        sign = rest >= 0
        codes.append(np.packbits(sign, axis=1, bitorder="little").view(np.uint64))
        signs = np.where(sign, unit, -unit)
        aligned.append((rest * signs).sum(1))
        rest = rest - aligned[-1][:, None] * signs
    return np.stack(codes, 1), np.stack(aligned, 1), np.linalg.norm(rest, axis=1)


class Anchors:
    """Anchors' components, rotated and rounded, as bit planes."""

    def __init__(self, q: np.ndarray):
        turned = _turned(q)
        self.unit = 1 / np.sqrt(turned.shape[1])
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / ((1 << PLANES) - 1), 1e-300)
        level = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.planes = np.stack([np.packbits((level >> b) & 1 == 1, axis=1, bitorder="little").view(np.uint64) for b in range(PLANES)], 1)
        rounded = self.low[:, None] + level * self.step[:, None]
        self.total = rounded.sum(1)
        self.missed = np.linalg.norm(turned - rounded, axis=1)
        self.length = np.linalg.norm(turned, axis=1)

    def intervals(self, at: int, codes: np.ndarray, aligned: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) bounds of the inner products of anchor `at` with coded rows."""
        middle, half = np.zeros(len(codes)), np.zeros(len(codes))
        for level in range(codes.shape[1]):
            own = codes[:, level]
            ones = np.bitwise_count(own).sum(1, dtype=np.int64)
            weighted = np.zeros(len(own))
            for b in range(PLANES):
                weighted += np.bitwise_count(own & self.planes[at, b]).sum(1, dtype=np.int64) * float(1 << b)
            plus = self.low[at] * ones + self.step[at] * weighted  # the sum of rounded components where the code has a one
            estimate = self.unit * (2 * plus - self.total[at])
            middle += aligned[:, level] * estimate
            half += np.abs(aligned[:, level]) * self.missed[at]
        across = np.sqrt(np.maximum(self.length[at] ** 2 - np.maximum(np.abs(estimate) - self.missed[at], 0) ** 2, 0))
        half += rest * across + 1e-9 * self.length[at] * (np.abs(aligned).sum(1) + rest) + 0.5
        return middle - half, middle + half


def coded(vectors: DataFrame, vec_id: str, label: str, vector: str) -> DataFrame:
    """vectors -> row, vec_id, label, dims, x array<long>, codes array<long>, aligned array<double>, rest; written.

    x holds floor(256 * component). Rows of null label or vector, with null or non-finite
    components, or longer than GREATEST allows, take no part.
    """
    ship(vectors.sparkSession)
    given = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")
    )
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    scaled = given.where(sound).withColumn("v", F.transform("v", lambda c: F.lit(256.0) * c))
    short = F.aggregate("v", F.lit(0.0), lambda s, c: s + (F.abs(c) + 1) * (F.abs(c) + 1)) <= GREATEST
    whole = scaled.where(short).withColumn("v", F.transform("v", lambda c: F.floor(c)))
    rows = whole.select("row", "vec_id", "label", F.size("v").alias("dims"), F.col("v").alias("x"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                codes, aligned, rest = encode(_matrix(part.column(4), part.num_rows, np.int64))
                made = [pa.array(list(codes.reshape(len(codes), -1).view(np.int64)), pa.list_(pa.int64())), pa.array(list(aligned), pa.list_(pa.float64())), pa.array(rest)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "codes", "aligned", "rest"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return materialize(rows.mapInArrow(work, f"{kinds}, codes array<long>, aligned array<double>, rest double"), "coded-vectors")


def _matrix(column, rows: int, kind) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(kind, copy=False).reshape(rows, -1)


class Block:
    """Coded rows that meet anchors in a task."""

    def __init__(self, table: pa.Table):
        n = table.num_rows
        self.x = _matrix(table.column("x"), n, np.int64)
        self.codes = _matrix(table.column("codes"), n, np.int64).view(np.uint64).reshape(n, LEVELS, -1)
        self.aligned = _matrix(table.column("aligned"), n, np.float64)
        self.rest = table.column("rest").to_numpy()
        self.row = table.column("row").to_numpy()
        ids = table.column("vec_id")
        self.nameless = np.asarray(ids.is_null())
        self.id = ids.fill_null(0).to_numpy()
        self.label = table.column("label").to_numpy()

    def best(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, may: np.ndarray, least: int, most: int, k: int) -> list[tuple[int, int]]:
        """(place, score) of the first k of the rows in `may` with scores from least to most.

        Rows whose interval lies outside are passed by, and so are those that cannot reach what was found: the
        rows of the highest bounds are scored first, then further ones while their bounds allow it.
        """
        near = np.flatnonzero(may & (high >= least) & (low <= most))
        near = near[np.argsort(-high[near], kind="stable")]
        held = np.empty(0, np.int64)
        scores = np.empty(0, np.int64)
        at, step = 0, 64
        while at < len(near):
            part = near[at : at + step]
            got = self.x[part] @ q
            good = (got >= least) & (got <= most)
            held, scores = np.concatenate((held, part[good])), np.concatenate((scores, got[good]))
            at, step = at + step, step * 2
            if len(held) >= k:
                order = np.lexsort((self.row[held], self.id[held], self.nameless[held], -scores))[:k]
                held, scores = held[order], scores[order]
                if at < len(near) and high[near[at]] < scores[-1]:
                    break
        order = np.lexsort((self.row[held], self.id[held], self.nameless[held], -scores))[:k]
        return list(zip(held[order].tolist(), scores[order].tolist()))


def _met(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, same: list[str], work: Callable, schema: str) -> DataFrame:
    """Every block of rows meets every slice of anchors that agree in `same`, in a task of its own.

    Both are dealt by the hash of their row number, so an id or label that is very frequent is spread.
    """
    blocks, slices = max(1, -(-n_rows // BLOCK)), max(1, -(-n_anchors // ANCHORS))
    left = rows.withColumn("_i", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    left = left.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = anchors.toDF(*anchors.columns).withColumn("_j", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int"))
    right = right.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["_i", "_j", *same]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(work, schema)


def positives(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """anchor (row number), rank, positive_id, positive_score: an anchor's first POSITIVES other rows of its label."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            block, asked = Block(left), Block(right)
            bits = Anchors(asked.x)
            for a in range(len(asked.x)):
                low, high = bits.intervals(a, block.codes, block.aligned, block.rest)
                may = block.row != asked.row[a]
                found += [(int(asked.row[a]), p, s) for p, s in block.best(asked.x[a], low, high, may, -(1 << 63), (1 << 63) - 1, POSITIVES)]
        return _answer(left, "chunk_id", [("anchor", [f[0] for f in found])], [f[1] for f in found], [f[2] for f in found])

    kind = rows.schema["vec_id"].dataType.simpleString()
    near = _met(rows, anchors, n_rows, n_anchors, ["dims", "label"], work, f"anchor long, row long, chunk_id {kind}, score long")
    best = top_k(near, POSITIVES, [F.desc("score"), F.asc_nulls_last("chunk_id"), F.col("row")], ("anchor",))
    return best.select("anchor", "rank", F.col("chunk_id").alias("positive_id"), F.col("score").alias("positive_score"))


def _answer(left: pa.Table, name: str, keys: list[tuple[str, list[int]]], places: list[int], scores: list[int]) -> pa.Table:
    at = pa.array(places, pa.int64())
    out = {key: pa.array(values, pa.int64()) for key, values in keys}
    return pa.table(out | {"row": left.column("row").take(at), name: left.column("vec_id").take(at), "score": pa.array(scores, pa.int64())})


def negatives(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """anchors(..., wanted array<(rank, least, most)>) -> anchor, positive (its rank), rank, negative_id, negative_score."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            block, asked = Block(left), Block(right)
            bits, wanted = Anchors(asked.x), right.column("wanted").to_pylist()
            for a in range(len(asked.x)):
                low, high = bits.intervals(a, block.codes, block.aligned, block.rest)
                may = block.label != asked.label[a]
                for w in wanted[a]:
                    best = block.best(asked.x[a], low, high, may, w["least"], w["most"], NEGATIVES)
                    found += [(int(asked.row[a]), w["rank"], p, s) for p, s in best]
        keys = [("anchor", [f[0] for f in found]), ("positive", [f[1] for f in found])]
        return _answer(left, "chunk_id", keys, [f[2] for f in found], [f[3] for f in found])

    kind = rows.schema["vec_id"].dataType.simpleString()
    near = _met(rows, anchors, n_rows, n_anchors, ["dims"], work, f"anchor long, positive long, row long, chunk_id {kind}, score long")
    best = top_k(near, NEGATIVES, [F.desc("score"), F.asc_nulls_last("chunk_id"), F.col("row")], ("anchor", "positive"))
    return best.select("anchor", "positive", "rank", F.col("chunk_id").alias("negative_id"), F.col("score").alias("negative_score"))


def hard_negatives(
    vectors: DataFrame, anchor_every: int = 50, low: int = 50, high: int = 95, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; `low` and `high` in percent of the positive's score.

    Exact: every block of rows meets every slice of the anchors, a task each, and is filtered by its codes.
    Vectors of different lengths do not meet. Rows of one vec_id are rows of their own; equal ids and scores are in any order.
    """
    rows = coded(vectors, vec_id, label, vector)
    own = rows.where(F.col("vec_id") % anchor_every == 0)
    n_rows, n_anchors = rows.count(), own.count()
    first = materialize(positives(rows, own, n_rows, n_anchors), "positives")
    score = F.col("positive_score").cast("decimal(24, 0)")
    least, most = F.ceil(score * low / 100).cast("long"), F.floor(score * high / 100).cast("long")
    window = F.struct(F.col("rank").cast("long").alias("rank"), least.alias("least"), most.alias("most"))
    wanted = first.where(least <= most).groupBy("anchor").agg(F.collect_list(window).alias("wanted"))  # POSITIVES at most
    asked = own.join(wanted, F.col("row") == F.col("anchor")).drop("anchor")
    found = negatives(rows, asked, n_rows, n_anchors).join(first.withColumnRenamed("rank", "positive"), ["anchor", "positive"])
    named = found.join(own.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 50; every row is searched.

    Rows of null label or vector, with null or non-finite components, or with 256 times their length above
    2**31 take no part. Null ids: candidates, last among equals, no anchors. Rows that repeat an
    id are rows of their own. Zero vectors score 0. Other columns are not read. No vectors: no rows.
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", shifted.alias("label"), "embedding"))


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLE_SQL: dict[str, str] = {
    "op13_hard_negatives": """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
),
p AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.other AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other)
QUALIFY row_number() OVER w <= 3
"""
}
