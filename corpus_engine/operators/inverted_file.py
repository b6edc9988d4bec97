"""Nearest vectors by an inverted file: coarse cells, probed by a bound on the distance.

Each vector lies in the cell of its nearest centroid. A cell has a radius, the distance of its
farthest vector, so none of its vectors is nearer to a query than the centroid's distance less the
radius. A query first looks into its nearest cells; the k-th distance found there bounds what is worth
looking at, and only cells within it are probed then. With reach 1 the answer is exact; a smaller
reach takes the radius for shorter, passes more cells by, and may miss neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.operators import search
from corpus_engine.shared import materialize, ship, united

#: Vectors that centroids are learned from, at most; rounds of learning; cells at most.
SAMPLE, ROUNDS, CELLS = 50_000, 8, 4096
#: Rows that are searched in one task, at most, and queries that they meet there; shares that rows are dealt into, at least.
BLOCK, SLICE, SHARES = 20_000, 20_000, 32
#: Vectors that are held against all centroids at once; probes that are handed on at once.
STEP, PROBES = 512, 16_384


def _sound(df: DataFrame, key: str) -> DataFrame:
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    return df.select(key, F.col("v").cast("array<double>").alias("v")).where(fine)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * x @ c.T, 0))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """At most STEP rows of the batches at a time, with their vectors, which are the second column."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            yield part, np.asarray(part.column(1).flatten()).reshape(part.num_rows, -1)


def _shares(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first share and how many it has. Cells lie together up to `most` rows, larger ones have shares of their own."""
    first, blocks = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // most))
    share, held = 0, 0
    for cell, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            share, held = share + 1, 0
        first[cell] = share
        if size > most:
            share += int(blocks[cell])
        else:
            held += size
    return first, blocks


def centroids(vectors: DataFrame, cells: int, sample: int = SAMPLE) -> np.ndarray:
    """`cells` centres of at most `sample` vectors(chunk_id, v), learned by ROUNDS rounds of k-means on the driver."""
    drawn = vectors.orderBy(F.xxhash64("chunk_id", F.lit("sample")), "chunk_id").limit(sample).select("v").toArrow()
    x = np.asarray(drawn.column("v").combine_chunks().flatten()).reshape(drawn.num_rows, -1)
    different = np.unique(x, axis=0)
    centre = different[np.random.default_rng(5).permutation(len(different))[:cells]]
    for _ in range(ROUNDS):
        near = np.concatenate([_distances(part, centre).argmin(1) for part in np.array_split(x, max(1, len(x) // 4096))])
        sums, sizes = np.zeros_like(centre), np.bincount(near, minlength=len(centre))
        np.add.at(sums, near, x)
        centre = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centre)
    return centre


class InvertedFile:
    """vectors(chunk_id, v) by cells, written; all of one length.

    rows(chunk_id, v, cell, share): a share has whole cells of at most BLOCK rows together, or a part of a larger cell, so a
    cell that holds a third of all rows is the work of many tasks. `sizes`, `radius`, `first` (its first share) and `blocks`
    (how many shares it has) have a number a cell.
    """

    def __init__(self, vectors: DataFrame, cells: int | None = None):
        spark = vectors.sparkSession
        ship(spark)
        sound = _sound(vectors, "chunk_id")
        common = sound.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        self.dims, self.n = (common.d, common.n) if common else (0, 0)
        sound = sound.where(F.size("v") == self.dims)
        self.centre = centroids(sound, cells or int(min(CELLS, max(1, 2 * self.n**0.5)))) if self.n else np.zeros((1, 0))
        shared = spark.sparkContext.broadcast(self.centre)  # CELLS rows at most
        kind = vectors.schema["chunk_id"].dataType.simpleString()

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, x in _parts(batches):
                d = _distances(x, shared.value)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["chunk_id", "v", "cell", "away"])

        cut = sound.mapInArrow(placed, f"chunk_id {kind}, v array<double>, cell int, away double")
        cut = materialize(cut, "cells")
        found = cut.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect()  # CELLS rows at most
        self.sizes, self.radius = np.zeros(len(self.centre), np.int64), np.zeros(len(self.centre))
        for r in found:
            self.sizes[r.cell], self.radius[r.cell] = r.n, r.r * (1 + 1e-9) + 1e-9
        self.first, self.blocks = _shares(self.sizes, min(BLOCK, max(1, -(-self.n // SHARES))))
        table = list(zip(range(len(self.sizes)), self.first.tolist(), self.blocks.tolist()))
        deal = F.broadcast(spark.createDataFrame(table, "cell int, first int, blocks int"))  # CELLS rows at most
        numbered = cut.withColumn("number", F.xxhash64("chunk_id", F.monotonically_increasing_id())).join(deal, "cell")
        dealt = numbered.withColumn("share", (F.col("first") + F.pmod("number", "blocks")).cast("int")).repartition("share")
        self.rows = materialize(dealt.select("chunk_id", "v", "cell", "share"), "inverted-file")

    def search(self, queries: DataFrame, k: int, first: int = 2, reach: float = 1.0) -> tuple[DataFrame, int]:
        """queries(query_id, v) -> (query_id, chunk_id, distance, rank) as search.knn_search gives them, and how many pairs were compared."""
        asked = _sound(queries, "query_id").where(F.size("v") == self.dims)
        kind = queries.schema["query_id"].dataType.simpleString()
        shared = queries.sparkSession.sparkContext.broadcast((self.centre, self.radius, self.first, self.blocks, self.sizes))

        def probes(own: bool):
            """Cells for each query, by shares: its nearest ones, with rows enough, or the others within `kth`."""

            def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                centre, radius, shares, blocks, sizes = shared.value
                for part, x in _parts(batches):
                    d = _distances(x, centre)
                    order = np.argsort(d, axis=1, kind="stable")
                    kth = None if own else part.column(2).to_numpy(zero_copy_only=False)
                    taken = []
                    for i in range(len(d)):
                        held = np.cumsum(sizes[order[i]])
                        begun = max(first, int(np.searchsorted(held, k)) + 1)  # as many cells as hold k rows
                        mine = order[i][:begun] if own else order[i][begun:]
                        if not own and not np.isnan(kth[i]):
                            mine = mine[d[i][mine] - reach * radius[mine] <= np.sqrt(kth[i]) + 1e-6]
                        taken.append(mine[sizes[mine] > 0].astype(np.int32))
                    cells, of = np.concatenate(taken), np.repeat(np.arange(len(d)), [len(t) for t in taken])
                    several = blocks[cells]
                    begin = np.repeat(np.cumsum(several) - several, several)
                    cells, of = np.repeat(cells, several), np.repeat(of, several)
                    share = shares[cells] + np.arange(len(cells)) - begin
                    sort = np.lexsort((share, of))
                    cells, of, share = cells[sort], of[sort], share[sort]
                    starts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (share[1:] != share[:-1])]) if len(of) else np.empty(0, np.int64)
                    pairs = np.add.reduceat(-(-sizes[cells] // blocks[cells]), starts) if len(of) else starts
                    ends = np.r_[starts[1:], len(of)]
                    for at in range(0, len(starts), PROBES):
                        these, until = starts[at : at + PROBES], ends[at : at + PROBES]
                        query = pa.array(of[these], pa.int64())
                        lists = pa.ListArray.from_arrays(pa.array(np.r_[these, until[-1]] - these[0], pa.int32()), pa.array(cells[these[0] : until[-1]]))
                        columns = [part.column(0).take(query), part.column(1).take(query), pa.array(share[these].astype(np.int32)), lists, pa.array(pairs[at : at + PROBES], pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "v", "share", "cells", "pairs"])

            return work

        slices = -(-max(asked.count(), 1) // SLICE)
        schema = f"query_id {kind}, v array<double>, share int, cells array<int>, pairs long"
        near = materialize(asked.mapInArrow(probes(True), schema), "probes")
        best = materialize(self._scored(near, k, kind, slices), "near")
        bound = best.where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("distance").alias("kth"))
        bounded = asked.join(bound, F.col("query_id") == F.col("_q"), "left").select("query_id", "v", "kth")
        further = materialize(bounded.mapInArrow(probes(False), schema), "further-probes")
        every = united(best.drop("rank"), self._scored(further, k, kind, slices).drop("rank"))
        compared = sum(df.agg(F.sum("pairs")).first()[0] or 0 for df in (near, further))
        return search.top_k(every, k, [F.col("distance"), F.col("chunk_id")]), compared

    def _scored(self, probes: DataFrame, k: int, kind: str, slices: int) -> DataFrame:
        """The k nearest of each query in the cells it probes. A share meets the queries of one slice in a task of its own."""
        name = self.rows.schema["chunk_id"].dataType.simpleString()

        def work(left: pa.Table, right: pa.Table) -> pa.Table:
            at, places, found = [], [], []
            if left.num_rows and right.num_rows:
                left = left.take(pa.array(np.argsort(np.asarray(left.column("cell")), kind="stable")))
                x, q = (np.asarray(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (left, right))
                ids, lists = np.asarray(left.column("chunk_id")), right.column("cells").combine_chunks()
                cells, begins, ends = np.unique(np.asarray(left.column("cell")), return_index=True, return_counts=True)
                ends = begins + ends
                probed, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
                for i, one in enumerate(q):
                    of = np.isin(cells, probed[offsets[i] : offsets[i + 1]])
                    own = slice(None) if of.all() else np.concatenate([np.arange(b, e) for b, e in zip(begins[of], ends[of])] or [np.empty(0, int)])
                    d = np.round(((x[own] - one) ** 2).sum(1), 6)
                    best = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                    best = best[np.lexsort((ids[own][best], d[best]))[:k]]
                    at.append(np.full(len(best), i))
                    places.append(best if of.all() else own[best])
                    found.append(d[best])
            joined = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
            out = {"query_id": right.column("query_id").take(pa.array(joined(at, int), pa.int64())), "chunk_id": left.column("chunk_id").take(pa.array(joined(places, int), pa.int64()))}
            return pa.table(out | {"distance": pa.array(joined(found, float))})

        rows = self.rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        asked = probes.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int"))
        met = rows.groupBy("share", "slice").cogroup(asked.groupBy("share", "slice")).applyInArrow(work, f"query_id {kind}, chunk_id {name}, distance double")
        return search.top_k(met, k, [F.col("distance"), F.col("chunk_id")])


def recall(found: DataFrame, exact: DataFrame, compared: int, pairs: int) -> DataFrame:
    """One row: the share of exact(query_id, chunk_id) that is in found, and the share of pairs that were compared."""
    got = found.select("query_id", "chunk_id").withColumn("_hit", F.lit(1))
    met = exact.select("query_id", "chunk_id").join(got, ["query_id", "chunk_id"], "left")
    return met.agg(F.round(F.avg(F.coalesce("_hit", F.lit(0))), 6).alias("recall")).withColumn("compared", F.round(F.lit(compared / max(pairs, 1)), 6))
