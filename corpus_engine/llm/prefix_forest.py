"""Operator 6: approximate nearest neighbours by a hash-prefix forest.

Every tree gives each vector a long hash string and holds the strings sorted. A query descends in all
trees to its longest matching prefixes and ascends in all of them together, letter by letter, until
the vectors under its prefixes are enough; those are ranked by their exact inner products.

The forest is planted once: equal vectors become one, and runs of prefixes of the first tree are
blocks, each with its part of every tree. In the block where a query's own string lies it ascends
until it has a few hundred candidates; their scores tell how near its neighbours are at least, and
so the depth at which a neighbour as near as that shares a prefix with it in some tree, but for a
chance of MISS. The query then visits the blocks that hold such prefixes and ranks what is under
them. So a query among near neighbours ranks few vectors in few blocks, and one without any must
rank many; no count of candidates or visits is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpus_engine.shared import materialize, ship

TOP = 20
#: Trees, letters (bits) of a hash string.
TREES, LETTERS = 64, 32
#: Vectors of a block on average; queries that meet one block in one task.
BLOCK_ROWS, QUERY_ROWS = 8192, 16_384
#: Letters of the first tree's prefixes that blocks are made of.
CELL = 18
#: Distinct vectors at which a query stops ascending in its own block, and the share of the block at which it does.
HOME, HOME_SHARE = 2048, 0.25
#: Chance that a neighbour as near as the last one found at home shares no prefix with the query.
MISS = 0.1
#: Lengths of prefixes by which blocks are found; queries that need shorter ones visit all blocks.
LEVELS = (12, 18, 24)
SEED = 7
#: Stands for a null id while it is sorted: such vectors come last among equals.
NO_ID = 2**63 - 1


def usable(vector: str) -> F.Column:
    """Whether a vector is there, not zero, and has finite components only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def planes(dims: int, trees: int = TREES, letters: int = LETTERS) -> np.ndarray:
    """Random hyperplanes, one a letter, over the vector and one more component."""
    return np.random.default_rng(SEED).standard_normal((dims + 1, trees * letters)).astype(np.float32)


def hash_strings(vectors: np.ndarray, extra: np.ndarray, cuts: np.ndarray, trees: int, letters: int = LETTERS) -> np.ndarray:
    """(n, trees) hash strings as integers, the first letter highest."""
    place = np.int64(1) << np.arange(letters - 1, -1, -1, dtype=np.int64)
    out = np.empty((len(vectors), trees), np.int64)
    full = np.concatenate([vectors, extra[:, None]], axis=1).astype(np.float32)
    for t in range(trees):
        out[:, t] = (full @ cuts[:, t * letters : (t + 1) * letters] > 0) @ place
    return out


def strings_of(vectors: np.ndarray, longest: float | None, trees: int = TREES) -> np.ndarray:
    """Hash strings of vectors scaled by the greatest length, or (None) of queries scaled to length 1.

    Vectors get one more component that makes each a unit vector, which is 0 for queries: so the
    largest inner product with a query is the smallest angle to it.
    """
    cuts = planes(vectors.shape[1])
    if longest is None:
        scaled, extra = vectors / np.sqrt((vectors**2).sum(1, keepdims=True)), np.zeros(len(vectors))
    else:
        scaled = vectors / longest
        extra = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))
    return hash_strings(scaled, extra, cuts, trees)


def depths(cosines: np.ndarray, miss: float = MISS, trees: int = TREES, letters: int = LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """(length of the prefix that is looked under, in how many trees one letter more will do).

    A vector at an angle a to the query has each letter in common with it by a chance of 1 - a/pi;
    the lengths are the greatest at which it has no prefix in common in any tree by a chance of `miss`
    at most.
    """
    letter = 1 - np.arccos(np.clip(cosines, -1, 1)) / np.pi
    with np.errstate(divide="ignore", invalid="ignore"):
        one = np.log(1 - miss ** (1 / trees)) / np.log(letter)
        length = np.where(letter >= 1, letters, np.where(letter <= 0, 0, one))
        length = np.clip(np.floor(length), 0, letters).astype(np.int64)
        apart, deeper = np.log1p(-(letter**length)), np.log1p(-(letter ** (length + 1)))
        more = np.where(length == 0, 0, np.floor((np.log(miss) - trees * apart) / (deeper - apart)))
    more = np.where((length >= letters) | ~np.isfinite(more), 0, np.clip(more, 0, trees))
    return length, more.astype(np.int64)


class Forest:
    """The sorted arrays of one block of distinct vectors; ids of vector k are ids[heads[k] : heads[k + 1]], ascending."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, heads: np.ndarray, strings: np.ndarray):
        self.vectors, self.ids, self.heads = vectors, ids, heads
        self.trees = strings.shape[1]
        strings = np.ascontiguousarray(strings.T)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.strings = np.take_along_axis(strings, self.order, axis=1)

    def slices(self, own: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in each tree's array the strings begin and end that share a prefix with `own`; lengths (n, trees)."""
        low, high = np.empty(own.shape, np.int64), np.empty(own.shape, np.int64)
        for t in range(self.trees):
            rest = LETTERS - length[:, t]
            first = own[:, t] >> rest << rest
            low[:, t] = np.searchsorted(self.strings[t], first, "left")
            high[:, t] = np.searchsorted(self.strings[t], first + (np.int64(1) << rest), "left")
        return low, high

    def _under(self, low: np.ndarray, high: np.ndarray, seen: np.ndarray) -> np.ndarray:
        for t in np.flatnonzero(low < high).tolist():
            seen[self.order[t, low[t] : high[t]]] = True
        rows = np.flatnonzero(seen)
        seen[rows] = False
        return rows

    def ascend(self, own: np.ndarray, most: int) -> list[np.ndarray]:
        """For each query the vectors under its prefixes, at the longest length at which there are enough distinct ones.

        HOME_SHARE of the block's are enough, and `most` are in any case.
        """
        n = len(self.vectors)
        enough = min(most, int(np.ceil(HOME_SHARE * n)))
        found = [np.arange(n)] * len(own)
        todo = np.arange(len(own) if enough < n else 0)
        seen = np.zeros(n, bool)
        for length in range(LETTERS, 0, -1):
            if not len(todo):
                break
            low, high = self.slices(own[todo], np.full((len(todo), self.trees), length))
            done = np.zeros(len(todo), bool)
            for k in np.flatnonzero((high - low).sum(1) >= enough):  # a vector counts once a tree, so these may have enough
                rows = self._under(low[k], high[k], seen)
                if len(rows) >= enough:
                    found[todo[k]], done[k] = rows, True
            todo = todo[~done]
        return found

    def at_depth(self, own: np.ndarray, length: np.ndarray, more: np.ndarray) -> Iterator[np.ndarray]:
        """For each query the vectors under its prefixes of `length`, one letter longer in the first `more` trees."""
        n, seen = len(self.vectors), np.zeros(len(self.vectors), bool)
        for at in range(0, len(own), 1024):
            part = slice(at, at + 1024)
            wanted = length[part, None] + (np.arange(self.trees) < more[part, None])
            low, high = self.slices(own[part], wanted)
            for k in range(len(low)):
                yield np.arange(n) if length[at + k] == 0 else self._under(low[k], high[k], seen)

    def best(self, query: np.ndarray, near: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, scores, vectors they are of) of the best rows among the candidates, ties by id."""
        if len(near) > 4 * top:  # near enough to the top to be in it
            rough = self.vectors[near] @ query
            edge = np.partition(rough, len(rough) - top)[len(rough) - top]
            near = near[rough >= edge - 1e-9 * max(1.0, abs(edge))]
        scores = (self.vectors[near] * query).sum(1)
        first = np.lexsort((self.ids[self.heads[near]], -scores))[:top]
        near, scores = near[first], scores[first]
        counts = np.minimum(self.heads[near + 1] - self.heads[near], top)
        at = np.repeat(self.heads[near] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        ids, scores, near = self.ids[at], np.repeat(scores, counts), np.repeat(near, counts)
        first = np.lexsort((ids, -scores))[:top]
        return ids[first], scores[first], near[first]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values in a row, where each list begins, and the end)."""
    values = column.combine_chunks()
    offsets = np.concatenate(([0], np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    return values.flatten().to_numpy(zero_copy_only=False), offsets


def _strings(column: pa.ChunkedArray, trees: int = TREES) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), trees).astype(np.int64)


FOREST = "kind int, q1 bigint, q2 bigint, dims int, block int, strings binary, length int, more int, least double"


def dealt(cells: list[tuple[int, int]], block_rows: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cells [(prefix, vectors)] in order -> (prefixes, their first block, how many blocks they are spread over).

    Neighbours share a block until it is full; a prefix of more vectors than a block has several of its own.
    """
    blocks, spread, block, held = [], [], first, 0
    for _, n in cells:
        parts = -(-n // block_rows)
        if held and (parts > 1 or held + n > block_rows):
            block, held = block + 1, 0
        blocks.append(block)
        spread.append(parts)
        block, held = (block + parts, 0) if parts > 1 else (block, held + n)
    return np.array([c for c, _ in cells]), np.array(blocks), np.array(spread)


def planted(vectors: DataFrame, queries: DataFrame, top: int = TOP, block_rows: int = BLOCK_ROWS, home: int = HOME, miss: float = MISS) -> DataFrame:
    """The forest as a written table: a row for each distinct vector (kind 0) and each distinct query vector (kind 1).

    Columns: those of FOREST, v, and ids: the smallest ids of the vector's rows, as many as can be in a
    result. Only those are kept, so a vector with any number of copies is one row. length and more
    say at which depth a query must look, see depths(), least is a score that as many rows reach as are asked
    for. A task holds one block.
    """
    spark = vectors.sparkSession
    ship(spark)
    simple = {df.schema["embedding"].dataType.simpleString() for df in (vectors, queries)} == {"array<float>"}
    kind = "array<float>" if simple else "array<double>"
    zero = F.lit(0.0).cast("float" if simple else "double")

    def clean(df: DataFrame) -> DataFrame:
        v = F.transform(F.col("embedding").cast(kind), lambda x: x + zero)  # no negative zeros
        return df.where(usable("embedding")).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), v.alias("v"))

    rows = clean(vectors)
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    groups = rows.withColumn("_r", first).where(F.col("_r") <= top + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = clean(queries).select("v").distinct().withColumn("ids", F.array().cast("array<bigint>"))
    both = groups.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)))
    both = both.select("kind", F.xxhash64("v").alias("q1"), F.xxhash64(F.lit(1), "v").alias("q2"), F.size("v").alias("dims"), "v", "ids")
    long2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    sizes = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.sqrt(F.max(long2)).alias("longest")).collect()  # a row a length
    longest = {r.dims: r.longest for r in sizes}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, np.int64)
            kinds, dims = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            for d, k in set(zip(dims.tolist(), kinds.tolist())):
                at = np.flatnonzero((dims == d) & (kinds == k))
                if d in longest:
                    found[at] = strings_of(_matrix(batch.column(4).take(pa.array(at))), None if k else longest[d], 1)[:, 0] >> (LETTERS - CELL)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "cell"])

    placed = both.mapInArrow(place, f"kind int, q1 bigint, q2 bigint, dims int, v {kind}, ids array<bigint>, cell bigint")
    counts: dict[int, list[tuple[int, int]]] = {}
    for r in placed.where("kind = 0").groupBy("dims", "cell").count().orderBy("dims", "cell").collect():  # 2**CELL rows a length at most
        counts.setdefault(r.dims, []).append((r.cell, r["count"]))
    maps, used = {}, 0
    for d, cells in counts.items():
        maps[d] = dealt(cells, block_rows, used)
        used = int((maps[d][1] + maps[d][2]).max())
    shared = spark.sparkContext.broadcast(maps)  # three numbers a cell

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell, mark = (batch.column(i).to_numpy() for i in (3, 6, 1))
            block = np.full(batch.num_rows, -1, np.int64)
            for d in set(dims.tolist()) & set(shared.value):
                prefixes_, first, spread = shared.value[d]
                at = np.flatnonzero(dims == d)
                own = np.maximum(np.searchsorted(prefixes_, cell[at], "right") - 1, 0)
                block[at] = first[own] + mark[at] % spread[own]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(block.astype(np.int32))], names=[*batch.schema.names[:6], "block"])

    blocks = placed.mapInArrow(deal, f"kind int, q1 bigint, q2 bigint, dims int, v {kind}, ids array<bigint>, block int").where("block >= 0")

    def plant(rows: pa.Table) -> pa.Table:
        kinds, d = rows.column("kind").to_numpy(), rows.column("dims")[0].as_py()
        own, met = (rows.take(pa.array(np.flatnonzero(kinds == k))) for k in (0, 1))
        forest, out = None, []
        for part in (own, met):
            if not part.num_rows:
                continue
            matrix, n = _matrix(part.column("v")), part.num_rows
            length, more, least = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -np.inf)
            if part is own:
                strings = strings_of(matrix, longest[d])
                forest = Forest(matrix, *_lists(part.column("ids")), strings)
            else:
                strings, cosines = strings_of(matrix, None), np.full(n, -1.0)
                for k, near in enumerate(forest.ascend(strings, home) if forest else []):
                    _, scores, _ = forest.best(matrix[k], near, top + 1)  # its own row may be one of them
                    if len(scores) > top:
                        least[k] = scores[-1]
                        cosines[k] = least[k] / (np.sqrt((matrix[k] ** 2).sum()) * longest[d])
                length, more = depths(cosines, miss)
            made = {
                "strings": pa.array([s.tobytes() for s in strings.astype("<u4")], pa.binary()), "length": pa.array(length.astype(np.int32)),
                "more": pa.array(more.astype(np.int32)), "least": pa.array(least),
            }
            out.append(pa.table({name: made[name] if name in made else part.column(name) for name in columns}))
        return pa.concat_tables(out)

    columns = [*[c.split()[0] for c in FOREST.split(", ")], "v", "ids"]
    return materialize(blocks.groupBy("dims", "block").applyInArrow(plant, f"{FOREST}, v {kind}, ids array<bigint>"), "forest")


def prefixes(forest: DataFrame, keep: list[str], levels: list[int]) -> DataFrame:
    """keep, level, prefix: the prefixes of each row's strings in all trees, at `level` if it has one, else at all of `levels`."""
    own = "level" in forest.columns
    sent = forest.select(*keep, "strings", *["level"] * own)
    fields = [f"{k} {sent.schema[k].dataType.simpleString()}" for k in keep]
    tree = np.arange(TREES, dtype=np.int64) << LETTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            strings = _strings(batch.column(len(keep)))
            for level in levels:
                at = np.flatnonzero(batch.column(len(keep) + 1).to_numpy() == level) if own else np.arange(batch.num_rows)
                found = tree + (strings[at] >> (LETTERS - level))
                rows = pa.array(np.repeat(at, TREES))
                made = pa.table([*[batch.column(i).take(rows) for i in range(len(keep))], pa.array(np.full(found.size, level, np.int32)), pa.array(found.ravel())], names=[*keep, "level", "prefix"])
                made = made if own else made.group_by([*keep, "level", "prefix"]).aggregate([])
                yield from made.combine_chunks().to_batches()

    return sent.mapInArrow(run, ", ".join([*fields, "level int", "prefix bigint"]))


def visits(forest: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Which query vectors visit which blocks: q1, q2, dims, block, home, v, strings, length, more, least.

    A block is visited if it holds a vector that shares a prefix with the query in any tree, of the
    greatest of `levels` that is no longer than the query must look under.
    """
    base, asked = forest.where("kind = 0"), forest.where("kind = 1").withColumnRenamed("block", "home").drop("ids", "kind")
    level = F.lit(0)
    for step in sorted(levels):
        level = F.when(F.col("length") >= step, step).otherwise(level)
    asked = asked.withColumn("level", level)
    present = base.groupBy("dims").agg(F.collect_set("block").alias("blocks"))  # an array a length, a number a block
    wide = asked.where("level = 0").join(present.withColumnRenamed("dims", "_dims"), F.col("dims") == F.col("_dims")).withColumn("block", F.explode("blocks"))
    columns = ["q1", "q2", "dims", "block", "home", "v", "strings", "length", "more", "least"]
    found = wide.select(*columns)
    used = sorted(r.level for r in asked.where("level > 0").select("level").distinct().collect())  # a number a level
    if used:
        index = prefixes(base, ["dims", "block"], used).distinct()
        keyed = prefixes(asked.where("level > 0"), ["q1", "q2", "dims"], used)
        routed = keyed.join(index, ["dims", "level", "prefix"]).select("q1", "q2", "dims", "block").distinct()
        found = found.unionByName(asked.join(routed, ["q1", "q2", "dims"]).select(*columns))
    return found


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    top: int = TOP,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
    miss: float = MISS,
    levels: tuple[int, ...] = LEVELS,
    home: int = HOME,
) -> DataFrame:
    """vectors(vec_id, embedding), queries(vec_id, embedding) -> query_id, rank, vec_id, score.

    Vectors that are not usable() take no part on either side. Only vectors of a query's own
    length are candidates. A query's own row (same id, same vector, one of it) is no candidate;
    further rows with its id are. Equal queries are asked once; queries that share an id but not
    a vector are answered each. Vectors of null id are candidates, after others of their score, and
    give a null vec_id. Each distinct query vector is searched for once, whatever number of queries
    has it.
    """
    forest = planted(vectors, queries, top, block_rows, home, miss)
    met = materialize(visits(forest, levels), "forest-visits")
    tiles = met.groupBy("dims", "block").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("_tiles"))
    tiles = F.broadcast(tiles.select(F.col("dims").alias("_dims"), F.col("block").alias("_block"), "_tiles"))  # a row a block
    same = (F.col("dims") == F.col("_dims")) & (F.col("block") == F.col("_block"))
    left = forest.where("kind = 0").select("dims", "block", "q1", "q2", "v", "ids", "strings").join(tiles, same)
    left = left.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).drop("_dims", "_block", "_tiles")
    right = met.join(tiles, same).withColumn("tile", F.pmod("q2", "_tiles").cast("int")).drop("_dims", "_block", "_tiles")

    def search(own: pa.Table, asked: pa.Table) -> pa.Table:
        kinds = {"q1": pa.int64(), "q2": pa.int64(), "vec_id": pa.int64(), "score": pa.float64(), "same": pa.bool_()}
        parts = {name: [] for name in kinds}
        if own.num_rows and asked.num_rows:
            grove = Forest(_matrix(own.column("v")), *_lists(own.column("ids")), _strings(own.column("strings")))
            q1, q2 = (own.column(c).to_numpy() for c in ("q1", "q2"))
            wanted = {c: asked.column(c).to_numpy() for c in ("q1", "q2", "length", "more", "least")}
            matrix, strings = _matrix(asked.column("v")), _strings(asked.column("strings"))
            here = np.flatnonzero(asked.column("home").to_numpy() == asked.column("block").to_numpy())
            again = dict(zip(here.tolist(), grove.ascend(strings[here], home)))  # what `least` comes from
            near = grove.at_depth(strings, wanted["length"].astype(np.int64), wanted["more"].astype(np.int64))
            for k, rows in enumerate(near):
                rows = np.union1d(rows, again[k]) if k in again else rows
                ids, scores, of = grove.best(matrix[k], rows, top + 1)
                good = scores >= wanted["least"][k]  # as many as are asked for are so near
                ids, scores, of = ids[good], scores[good], of[good]
                one, two = wanted["q1"][k], wanted["q2"][k]
                for name, values in (("q1", np.full(len(ids), one)), ("q2", np.full(len(ids), two)), ("vec_id", ids), ("score", scores), ("same", (q1[of] == one) & (q2[of] == two))):
                    parts[name].append(values)
        return pa.table({name: pa.array(np.concatenate(p) if p else [], kinds[name]) for name, p in parts.items()})

    key = ["dims", "block", "tile"]
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "q1 bigint, q2 bigint, vec_id bigint, score double, same boolean")
    order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id")
    best = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top + 1)
    lists = best.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("_r", "vec_id", "score", "same"))).alias("found"))
    return _answered(queries, lists, top, vectors)


def _answered(queries: DataFrame, lists: DataFrame, top: int, vectors: DataFrame) -> DataFrame:
    """The queries' ids again, each without its own row."""
    simple = {df.schema["embedding"].dataType.simpleString() for df in (vectors, queries)} == {"array<float>"}
    zero = F.lit(0.0).cast("float" if simple else "double")
    v = F.transform(F.col("embedding").cast("array<float>" if simple else "array<double>"), lambda x: x + zero)
    ids = queries.where(usable("embedding")).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("query_id"), v.alias("v"))
    ids = ids.select("query_id", F.xxhash64("v").alias("_1"), F.xxhash64(F.lit(1), "v").alias("_2")).distinct()
    met = ids.join(lists, (F.col("_1") == F.col("q1")) & (F.col("_2") == F.col("q2")))
    own = F.coalesce(F.array_min(F.transform(F.filter("found", lambda x: x["same"] & (x["vec_id"] == F.col("query_id"))), lambda x: x["_r"])), F.lit(0))
    others = met.withColumn("_own", own).select("query_id", F.posexplode(F.filter("found", lambda x: x["_r"] != F.col("_own"))).alias("_at", "x"))
    return others.where(F.col("_at") < top).select(
        F.nullif(F.col("query_id"), F.lit(NO_ID)).alias("query_id"), (F.col("_at") + 1).alias("rank"), F.nullif(F.col("x.vec_id"), F.lit(NO_ID)).alias("vec_id"),
        F.col("x.score").alias("score"),
    )


def op6_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth embedding among all others.

    Null, zero and non-finite vectors take no part; repeated rows are candidates each; ties go to the
    smaller vec_id, null ones last. A null vec_id asks nothing. Vectors of different lengths do not
    meet. No embeddings: no rows.
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


QUERIES = {"op6_prefix_forest": op6_prefix_forest}
ORACLE_SQL: dict[str, str] = {}
