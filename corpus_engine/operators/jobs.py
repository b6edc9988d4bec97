"""Jobs that join several operators: ingest, retrieval by route, and the summaries they report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_engine.functions import rules, text
from corpus_engine.operators import chunk, search, store
from corpus_engine.shared import materialize


def ingest(files: DataFrame, known: DataFrame, steps: tuple = text.DEFAULT_STEPS) -> DataFrame:
    """files(doc_id, file_name, text): new ones cleaned by all steps, classified and cut into chunks of both kinds.

    Markdown files pass as they are. Chunks carry the file's hash and the confidence of its kind.
    """
    fresh = store.dedup_ingest(files, known).select("doc_id", "file_name", "text", "file_hash")
    cleaned = text.clean_corpus(fresh, steps=steps, source="file_name").select("doc_id", "file_name", "text", "file_hash")
    kinds = rules.classify_documents(cleaned).select("doc_id", "file_name", "text", "file_hash", "doc_type", "confidence")
    kinds = materialize(kinds, "kinds")  # read twice
    facts = kinds.select("doc_id", "file_hash", F.col("confidence").alias("classification_confidence"))
    chunks = chunk.route_and_split(kinds.select("doc_id", "file_name", "text", "doc_type"))
    return chunks.join(facts, "doc_id")


def stored(chunks: DataFrame, path: str, collection: str, dims: int = 64) -> DataFrame:
    """Chunks with ids and hash vectors appended to a collection at `path`; gives back what the store then holds."""
    numbered = chunks.withColumn("chunk_id", F.coalesce("chunk_id", chunk.chunk_id(F.col("doc_id").cast("string"), F.col("chunk_type"), F.coalesce(F.col("chunk_index"), F.col("grp")).cast("string"))))
    numbered = numbered.select("chunk_id", "doc_id", "doc_type", "chunk_type", "text")
    found = search.hash_vectors(numbered, "chunk_id", dims).withColumnRenamed("chunk_id", "_id")
    store.append_to_collection(numbered.join(found, F.col("chunk_id") == F.col("_id"), "left").drop("_id"), path, collection)
    return chunks.sparkSession.read.parquet(path)


def ingest_summary(chunks: DataFrame) -> DataFrame:
    """For each file: how many chunks, its kind and how sure that is, its hash."""
    return chunks.groupBy("doc_id", "doc_type", "classification_confidence", "file_hash").agg(F.count("*").alias("chunk_count"))


def preprocess_summary(docs: DataFrame) -> DataFrame:
    """docs(text): how many can be cleaned and how many are pending, having no text."""
    pending = F.col("text").isNull() | (F.col("text") == "")
    return docs.agg(F.count_if(~pending).alias("processed"), F.count_if(pending).alias("pending"))


def routed_search(prepared: DataFrame, index: search.Index, doc_types: DataFrame, k: int) -> DataFrame:
    """prepared(query_id, query, tools), doc_types(chunk_id, doc_type) -> query_id, scope, chunk_id, rank, score.

    Each scope searches its kind of documents; statistics are those of all. Queries without a
    scope find nothing.
    """
    scopes = prepared.select("query_id", "query", F.explode("tools").alias("scope"))
    kinds = doc_types.select("chunk_id", F.concat("doc_type", F.lit("_search")).alias("scope"))
    scores = search.bm25_scores(search.query_terms(prepared), index).withColumn("score", F.round("score", 6))
    met = scopes.select("query_id", "scope").join(scores.join(kinds, "chunk_id"), ["query_id", "scope"])
    return search.top_k(met, k, search.best_first(), ("query_id", "scope")).select("query_id", "scope", "chunk_id", "rank", "score")


def concat_sort(ranked: DataFrame) -> DataFrame:
    """Lists of several scopes as one, by score."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id", "scope")
    return ranked.withColumn("rank", F.row_number().over(order))


def tool_stats(ranked: DataFrame, times: DataFrame, parallel: bool = False) -> DataFrame:
    """ranked(query_id, scope), times(query_id, scope, ms) -> query_id, results, total_ms: the sum, or the longest if parallel."""
    counts = ranked.groupBy("query_id").agg(F.count("*").alias("results"))
    total = F.max("ms") if parallel else F.sum("ms")
    return times.groupBy("query_id").agg(total.alias("total_ms")).join(counts, "query_id", "left").na.fill({"results": 0})


def top_score_confidence(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """Score of the first result, 0 without one; the kind of question it was."""
    best = ranked.groupBy("query_id").agg(F.min_by("score", "rank").alias("_s"))
    met = queries.select("query_id").join(best, "query_id", "left")
    return met.select("query_id", F.coalesce("_s", F.lit(0.0)).alias("confidence"), F.when(F.col("_s").isNull(), "general").otherwise("rag").alias("question_type"))


def distinct_kinds(findings: DataFrame) -> DataFrame:
    """findings(doc_id, error_type, rule, description, severity): of a document, type and rule the first by description and severity."""
    first = F.min(F.struct("description", "severity"))
    return findings.groupBy("doc_id", "error_type", "rule").agg(first.alias("f")).select("doc_id", "error_type", "rule", "f.description", "f.severity")
