"""What follows retrieval: parents and neighbours of hits, external scores, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_engine.shared import materialize


def with_texts(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """ranked(chunk_id, ...) with what chunks(chunk_id, ...) hold of each hit; hits that are not there go.

    Hits are written and their chunks picked out first, so that no join deals out or sorts the texts of all chunks.
    """
    ranked = materialize(ranked, "hits")  # read twice
    own = chunks.join(ranked.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return ranked.join(materialize(own, "own"), "chunk_id")


def expand_to_parent(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """ranked(query_id, chunk_id, rank, score), chunks(chunk_id, parent_chunk_id, text) and their parents.

    Each hit takes its parent's id and text and keeps its rank and score; without a parent it stays. Hits and
    their parents are picked out of the chunks first, so that an outer join does not sort all texts.
    """
    ranked = materialize(ranked, "hits")  # read twice
    own = chunks.join(ranked.select("chunk_id").distinct(), "chunk_id", "left_semi")
    own = materialize(own.select("chunk_id", "parent_chunk_id", F.col("text").alias("_own")), "own")  # read twice
    wanted = own.select(F.col("parent_chunk_id").alias("chunk_id")).distinct()
    parents = chunks.join(wanted, "chunk_id", "left_semi").select(F.col("chunk_id").alias("_parent"), F.col("text").alias("_text"))
    parents = materialize(parents, "parents")
    met = ranked.join(own, "chunk_id", "left").join(parents, F.col("parent_chunk_id") == F.col("_parent"), "left")
    return met.select(
        "query_id", F.coalesce("_parent", "chunk_id").alias("chunk_id"), "rank", "score", F.coalesce("_text", "_own").alias("text")
    )


def expand_window(ranked: DataFrame, chunks: DataFrame, w: int = 1) -> DataFrame:
    """Each hit with its neighbours up to `w` away in the same document.

    ranked(query_id, doc_id, chunk_index, rank, score) -> query_id, doc_id, chunk_index, score,
    hit, position, text. A chunk that several hits reach belongs to the best ranked one, but a hit
    keeps its own score. Hits follow by rank, their chunks by index. They are written and their texts picked out first, so that
    no join deals out or sorts the texts of all chunks.
    """
    near = ranked.withColumn("_at", F.explode(F.sequence(F.col("chunk_index") - w, F.col("chunk_index") + w)))
    near = near.withColumn("_hit", (F.col("_at") == F.col("chunk_index")).cast("int"))
    first = Window.partitionBy("query_id", "doc_id", "_at").orderBy("rank")
    near = near.withColumns({
        "_n": F.row_number().over(first),
        "_own": F.max(F.when(F.col("_hit") == 1, F.col("score"))).over(Window.partitionBy("query_id", "doc_id", "_at")),
    }).where("_n = 1")
    near = materialize(near, "near")  # read twice
    wanted = near.select(F.col("doc_id").alias("_d"), F.col("_at").alias("_i")).distinct()
    texts = chunks.select(F.col("doc_id").alias("_d"), F.col("chunk_index").alias("_i"), "text").join(wanted, ["_d", "_i"], "left_semi")
    met = near.join(materialize(texts, "own"), (F.col("doc_id") == F.col("_d")) & (F.col("_at") == F.col("_i")))
    order = Window.partitionBy("query_id").orderBy("rank", "_at", "doc_id")
    return met.select(
        "query_id", "doc_id", F.col("_at").alias("chunk_index"), F.coalesce("_own", "score").alias("score"),
        F.col("_own").isNotNull().alias("hit"), F.row_number().over(order).alias("position"), "text",
    )


def rerank(ranked: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """scores(query_id, chunk_id, score) replace scores and order; queries of k rows or fewer stay as they are."""
    new = scores.select("query_id", "chunk_id", F.col("score").alias("_new"))
    met = ranked.join(new, ["query_id", "chunk_id"], "left").withColumn("_n", F.count("*").over(Window.partitionBy("query_id")))
    many = F.col("_n") > k
    met = met.withColumn("score", F.when(many, F.coalesce("_new", "score")).otherwise(F.col("score")))
    order = Window.partitionBy("query_id").orderBy(F.when(~many, F.col("rank")), F.desc("score"), "chunk_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "chunk_id", "rank", "score")


def hybrid_counts(ranked: DataFrame) -> DataFrame:
    """ranked(query_id, retriever) -> query_id, vector_count, bm25_count, fusion_method."""
    counts = ranked.groupBy("query_id").agg(
        F.count(F.when(F.col("retriever") == "vector", 1)).alias("vector_count"),
        F.count(F.when(F.col("retriever") == "bm25", 1)).alias("bm25_count"),
    )
    return counts.withColumn("fusion_method", F.when(F.col("bm25_count") > 0, "RRF").otherwise("vector-only"))


def stage_result_counts(results: DataFrame, stages: list[str]) -> DataFrame:
    """results(query_id, stage) -> query_id and the number of results of each stage."""
    return results.groupBy("query_id").pivot("stage", stages).count().na.fill(0)
