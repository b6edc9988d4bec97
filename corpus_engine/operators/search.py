"""Retrieval: BM25, exact vector search in blocks, fusion and cuts of ranked lists.

A ranked list has the columns query_id, chunk_id, rank, score; ties end on chunk_id. Whole
tables of queries are answered at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_engine.functions.text import hash_place, hash_sign, tokenize
from corpus_engine.shared import TASK_BYTES, deal, materialize, ship, united

K1, B, EPS = 1.5, 0.75, 0.25
#: Tokens, and sums (of a query and chunk) that one task holds, about.
TASK_TOKENS, TASK_SUMS = 1_000_000, 500_000


@dataclass
class Index:
    """postings(chunk_id, term, tf, dl), terms(term, df, idf) and totals(n, avgdl), one row."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame


def bm25_index(chunks: DataFrame, tokenizer: Callable[[Column], Column] = tokenize, eps: float = EPS) -> Index:
    """Index chunks(chunk_id, text). Terms in over half the chunks have a negative idf, which is
    replaced by eps times the mean idf, negative ones included. Texts are taken apart once: the postings
    are written, and all statistics come from them. Chunks without tokens count in n
    and in the mean length, and match nothing. Texts are dealt out by chunk before they are taken apart,
    so postings, which are more than they, are not shuffled; rows that share a chunk_id are one chunk and meet in one task.
    Texts are measured first, and a task gets about TASK_BYTES of them, since it holds all their postings."""
    spark = chunks.sparkSession
    size = chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    dealt = deal(chunks.select("chunk_id", "text"), size.bytes, TASK_BYTES, "chunk_id")
    tokens = dealt.select("chunk_id", tokenizer(F.col("text")).alias("tokens"))
    single = tokens.select("chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    postings = materialize(single.groupBy("chunk_id", "term", "dl").agg(F.count("*").alias("tf")), "postings")
    summed = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")).first().tokens
    avgdl = F.lit(summed / size.n if size.n else None).cast("double")
    totals = spark.range(1).select(F.lit(size.n).cast("long").alias("n"), avgdl.alias("avgdl"))
    return Index(postings, term_weights(postings.groupBy("term").agg(F.count("*").alias("df")), totals, eps), totals)


def term_weights(df: DataFrame, totals: DataFrame, eps: float = EPS) -> DataFrame:
    """df(term, df), totals(n) -> term, df, idf; see bm25_index for weights below zero."""
    one = F.broadcast(totals)  # one row
    idf = df.join(one).withColumn("idf", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = F.broadcast(idf.agg(F.avg("idf").alias("mean_idf")))  # one row
    terms = idf.join(mean).withColumn("idf", F.when(F.col("idf") < 0, F.lit(eps) * F.col("mean_idf")).otherwise(F.col("idf")))
    return terms.select("term", "df", "idf")


def top_k(scored: DataFrame, k: int, by: list[Column], groups: tuple[str, ...] = ("query_id",), out: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1; each task keeps k rows a group before the shuffle."""
    return scored.withColumn(out, F.row_number().over(Window.partitionBy(*groups).orderBy(*by))).where(F.col(out) <= k)


def best_first() -> list[Column]:
    return [F.desc("score"), F.col("chunk_id")]


def query_terms(queries: DataFrame, tokenizer: Callable[[Column], Column] = tokenize) -> DataFrame:
    """queries(query_id, query) -> query_id, term, qtf; queries without tokens have no row."""
    return queries.select("query_id", F.explode(tokenizer(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(
        F.count("*").alias("qtf")
    )


#: Most rows of weighted query terms that are broadcast at once.
QUERY_TERMS = 200_000


def bm25_scores(terms: DataFrame, index: Index, k1: float = K1, b: float = B, keep: DataFrame | None = None, tile_rows: int = QUERY_TERMS) -> DataFrame:
    """All matches of query terms: query_id, chunk_id, score. Statistics are those of the whole index.

    The postings of the queries' terms are picked out where they lie (if these are few enough to be broadcast) and
    dealt out by chunk, once; the queries' terms come to them in tiles of about
    tile_rows rows, each broadcast after its rows were counted (one query with more terms than that
    is left to Spark). So a chunk's scores are summed where its postings lie, and matches are not
    shuffled. keep(chunk_id): only these chunks are scored. Postings are dealt out to so many tasks that
    one sums about TASK_SUMS scores: at most one for each match, and for each query and chunk.
    """
    weighted = terms.join(index.terms, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"), "df")
    weighted = materialize(weighted, "query-terms")
    size = weighted.agg(F.count("*").alias("rows"), F.countDistinct("term").alias("terms")).first()
    tiles = max(1, -(-size.rows // tile_rows))
    placed = weighted.withColumn("_tile", F.pmod(F.xxhash64("query_id"), F.lit(tiles)))
    counts = placed.groupBy("_tile").agg(F.count("*").alias("rows"), F.sum("df").alias("matches"), F.countDistinct("query_id").alias("queries"))
    found = counts.collect()  # a row a tile
    sizes, placed = {r._tile: r.rows for r in found}, placed.drop("df")
    n = index.totals.first().n
    most = max((min(r.matches, r.queries * n) for r in found), default=0)
    postings = index.postings
    if size.terms <= 4 * tile_rows:
        postings = postings.join(F.broadcast(weighted.select("term").distinct()), "term", "left_semi")
    postings = deal(postings, most, TASK_SUMS, "chunk_id")
    if keep is not None:  # an inner join: a semi join is pushed below the deal, and shuffles and sorts the postings once more
        postings = postings.join(keep.select("chunk_id").distinct(), "chunk_id")
    tf = F.col("tf")
    norm = tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    parts = []
    for tile in range(tiles):
        own = placed.where(F.col("_tile") == tile).drop("_tile")
        own = F.broadcast(own) if sizes.get(tile, 0) <= 4 * tile_rows else own
        matches = postings.join(own, "term").join(F.broadcast(index.totals))  # one row
        part = matches.groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * tf * (k1 + 1) / norm).alias("score"))
        parts.append(part)
    return parts[0] if tiles == 1 else united(*parts)


def bm25_search(
    queries: DataFrame, index: Index, k: int, keep: DataFrame | None = None, tokenizer: Callable[[Column], Column] = tokenize
) -> DataFrame:
    """The k best chunks of each query; `keep`(chunk_id) filters results, not statistics. Only matched chunks are listed."""
    scores = bm25_scores(query_terms(queries, tokenizer), index, keep=keep).withColumn("score", F.round("score", 6))
    return top_k(scores, k, best_first()).select("query_id", "chunk_id", "rank", "score")


def _unit_vectors(parts: DataFrame, key: str, dims: int) -> DataFrame:
    """parts(key, at, w) -> key, v of unit length; rows that come to nothing have none."""
    held = parts.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("at", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
    )
    values = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm"))
    return held.where("norm > 0").select(key, values.alias("v"))


def posting_vectors(index: Index, dims: int = 64) -> DataFrame:
    """hash_vectors of the indexed chunks, from their postings: texts are not read again. A task gets about TASK_TOKENS tokens' postings."""
    size = index.totals.first()
    placed = index.postings.select("chunk_id", hash_place(F.col("term"), dims).alias("at"), (hash_sign(F.col("term")) * F.col("tf")).alias("w"))
    dealt = deal(placed, int(size.n * (size.avgdl or 0)), TASK_TOKENS, "chunk_id")
    return _unit_vectors(dealt.groupBy("chunk_id", "at").agg(F.sum("w").alias("w")), "chunk_id", dims)


def hash_vectors(rows: DataFrame, key: str, dims: int = 64, tokenizer: Callable[[Column], Column] = tokenize) -> DataFrame:
    """rows(key, text) -> key, v array<double>: signed term hashing, unit length; no tokens: no row."""
    terms = rows.select(key, F.explode(tokenizer(F.col("text"))).alias("term"))
    parts = terms.groupBy(key, hash_place(F.col("term"), dims).alias("at")).agg(F.sum(hash_sign(F.col("term"))).alias("w"))
    return _unit_vectors(parts, key, dims)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance_to_similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


METRICS = ("l2sq", "cosine", "dot")


def knn_search(
    queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2sq", groups: list[str] | None = None, block_rows: int = 20_000
) -> DataFrame:
    """queries(query_id, v), vectors(chunk_id, v[, groups]) -> query_id[, groups], chunk_id, distance, rank.

    Exact: every block of vectors meets every block of queries in a task of its own, which gives
    its k nearest a query (and group); these are merged. Both sides are dealt into blocks by
    hash, about block_rows each. Distances are rounded to six places before they are compared.
    Vectors that are null or hold a null or non-finite component take no part; vectors of different
    lengths do not meet. Under cosine a zero vector is at distance 1 of all.
    """
    spark = vectors.sparkSession
    ship(spark)
    groups = groups or []
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    asked = queries.select("query_id", F.col("v").cast("array<double>").alias("v")).where(sound)
    rows = vectors.select("chunk_id", *groups, F.col("v").cast("array<double>").alias("v")).where(sound)
    n_rows, n_asked = -(-max(rows.count(), 1) // block_rows), -(-max(asked.count(), 1) // block_rows)
    left = rows.withColumn("i", F.pmod(F.xxhash64("chunk_id"), F.lit(n_rows)).cast("int"))
    left = left.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    right = asked.withColumn("j", F.pmod(F.xxhash64("query_id"), F.lit(n_asked)).cast("int"))
    right = right.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    left, right = (side.withColumn("_size", F.size("v")) for side in (left, right))

    def matrix(table: pa.Table) -> np.ndarray:
        column = table.column("v").combine_chunks()
        return np.asarray(column.flatten()).reshape(table.num_rows, -1)

    def work(vectors_: pa.Table, queries_: pa.Table) -> pa.Table:
        taken, asked_ = [], []
        found = []
        if vectors_.num_rows and queries_.num_rows:
            v, q = matrix(vectors_), matrix(queries_)
            names = np.asarray(vectors_.column("chunk_id"))
            parts = [np.arange(len(v))]
            if groups:
                keys = list(zip(*[vectors_.column(g).to_pylist() for g in groups]))
                place: dict = {}
                for row, key in enumerate(keys):
                    place.setdefault(key, []).append(row)
                parts = [np.array(p) for p in place.values()]
            for part in parts:
                own, ids = v[part], names[part]
                for at, one in enumerate(q):
                    if metric == "l2sq":
                        d = ((own - one) ** 2).sum(1)
                    elif metric == "dot":
                        d = -(own * one).sum(1)
                    else:
                        length = np.sqrt((own**2).sum(1) * (one**2).sum())
                        d = 1 - np.divide((own * one).sum(1), length, out=np.zeros(len(own)), where=length > 0)
                    d = np.round(d, 6)
                    best = np.argpartition(d, k)[: k + 1] if len(d) > k + 1 else np.arange(len(d))
                    best = np.flatnonzero(d <= d[best].max()) if len(d) > k + 1 else best
                    best = best[np.lexsort((ids[best], d[best]))[:k]]
                    taken.append(part[best])
                    asked_.append(np.full(len(best), at))
                    found.append(d[best])
        rows_ = np.concatenate(taken) if taken else np.empty(0, int)
        ats = np.concatenate(asked_) if asked_ else np.empty(0, int)
        out = {"query_id": queries_.column("query_id").take(pa.array(ats, pa.int64()))}
        out |= {g: vectors_.column(g).take(pa.array(rows_, pa.int64())) for g in groups}
        out["chunk_id"] = vectors_.column("chunk_id").take(pa.array(rows_, pa.int64()))
        out["distance"] = pa.array(np.concatenate(found) if found else np.empty(0))
        return pa.table(out)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | {"query_id": asked.schema["query_id"].dataType.simpleString()}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("query_id", *groups, "chunk_id")) + ", distance double"
    key = ("i", "j", "_size")
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(work, schema)
    return top_k(near, k, [F.col("distance"), F.col("chunk_id")], ("query_id", *groups))


def similarity_threshold(near: DataFrame, least: float = 0.5) -> DataFrame:
    """Distances as similarities 1 / (1 + distance); those below `least` go."""
    return near.withColumn("score", F.round(distance_to_similarity(F.col("distance")), 6)).where(F.col("score") >= least)


def minmax_norm(ranked: DataFrame) -> DataFrame:
    """Scores of each query to 0..1; where all are equal (or one), 1 / (1 + score)."""
    own = Window.partitionBy("query_id")
    low, high = F.min("score").over(own), F.max("score").over(own)
    scaled = F.when(high == low, 1 / (1 + F.col("score"))).otherwise((F.col("score") - low) / (high - low))
    return ranked.withColumn("score", F.round(scaled, 6))


def rrf(vector: DataFrame, bm25: DataFrame, k: int, rrf_k: int = 60, wv: float = 1.0, wb: float = 1.0, key: str = "key") -> DataFrame:
    """Reciprocal rank fusion of two ranked lists that both have the column `key`.

    Rows of one list with the same key add up. A query that has one list only keeps its raw
    scores. Ties: the vector list first, then the better rank, then chunk_id. fusion_method says
    which it was.
    """
    both = united(vector.withColumns({"_list": F.lit(0), "_w": F.lit(wv)}), bm25.withColumns({"_list": F.lit(1), "_w": F.lit(wb)}))
    lists = Window.partitionBy("query_id")
    both = both.withColumn("_lists", F.max("_list").over(lists) - F.min("_list").over(lists) + 1)
    place = F.struct("_list", "rank", "chunk_id")
    fused = both.groupBy("query_id", key).agg(
        F.sum(F.col("_w") / (rrf_k + F.col("rank"))).alias("_rrf"),
        F.min_by("score", place).alias("_raw"),
        F.min_by("chunk_id", place).alias("chunk_id"),
        F.min(F.struct("_list", "rank")).alias("_first"),
        F.max("_lists").alias("_n"),
        F.max("_list").alias("_has_bm25"),
        F.min("_list").alias("_l"),
    )
    score = F.round(F.when(F.col("_n") == 2, F.col("_rrf")).otherwise(F.col("_raw")), 6)
    fused = fused.withColumn("score", score).withColumn("fusion_method", F.when(F.col("_n") == 2, "RRF").when(F.col("_l") == 0, "vector-only").otherwise("bm25-only"))
    order = [F.desc("score"), F.col("_first"), F.col("chunk_id")]
    return top_k(fused, k, order).select("query_id", "chunk_id", "rank", "score", "fusion_method")


def dedup_keep_first(ranked: DataFrame, content: str = "text") -> DataFrame:
    """Of rows of a query with equal content, the best ranked stays."""
    seen = Window.partitionBy("query_id", F.md5(F.col(content))).orderBy("rank", "chunk_id")
    return ranked.withColumn("_n", F.row_number().over(seen)).where("_n = 1").drop("_n")


def fetch_budget(k: int, multiplier: Column, doubled: bool = True) -> Column:
    """How many candidates to fetch for k results."""
    return F.greatest(F.lit(k), F.floor(F.lit(k * (2 if doubled else 1)) * multiplier)).cast("int")
