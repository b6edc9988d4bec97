"""Retrieval as a whole: queries prepared, searched both ways, assembled, reranked, cut and deduplicated.

chunks(chunk_id, parent_chunk_id, doc_id, chunk_index, text, doc_type) is what is searched; parents
are rows of it. Whole tables of queries are answered at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_engine.functions import rules
from corpus_engine.operators import assemble, search, store
from corpus_engine.shared import materialize, united

LAW, CASE = "法条", "案例"
SCOPES = {"law_search": ("law", LAW), "case_search": ("case", CASE)}
#: Characters of a text by which two results are one in a fusion.
KEY = 120


def hybrid(
    queries: DataFrame, index: search.Index, vectors: DataFrame, chunks: DataFrame, most: int, doc_type: str | None = None, filters: dict | None = None
) -> DataFrame:
    """queries(query_id, query, budget) -> query_id, chunk_id, rank, score, fusion_method: at most `budget` results each.

    budget is at most `most`. doc_type, filters (see store.metadata_predicate): only such chunks are found;
    statistics are those of all. vectors are counted, then searched, so they should be written; such as have the column doc_type
    are of chunks that the filters passed.
    """
    kept = chunks if doc_type is None else chunks.where(F.col("doc_type") == doc_type)
    kept = kept.where(store.metadata_predicate(filters)) if filters else kept
    narrowed = doc_type is not None or bool(filters)
    budget = queries.select("query_id", "budget")
    words = search.bm25_search(queries, index, most, kept.select("chunk_id") if narrowed else None)
    asked = search.hash_vectors(queries.select("query_id", F.col("query").alias("text")), "query_id")
    if "doc_type" in vectors.columns:
        vectors = vectors if doc_type is None else vectors.where(F.col("doc_type") == doc_type)
    elif narrowed:
        vectors = vectors.join(kept.select("chunk_id"), "chunk_id", "left_semi")
    near = search.knn_search(asked, vectors, most)
    near = near.select("query_id", "chunk_id", "rank", F.round(search.distance_to_similarity(F.col("distance")), 6).alias("score"))
    within = lambda ranked: ranked.join(budget, "query_id").where(F.col("rank") <= F.col("budget")).drop("budget")
    keys = kept.select("chunk_id", F.substring("text", 1, KEY).alias("key"))
    fused = search.rrf(within(near).join(keys, "chunk_id"), search.minmax_norm(within(words)).join(keys, "chunk_id"), most)
    return within(fused)


def assembled(ranked: DataFrame, chunks: DataFrame, w: int = 1) -> DataFrame:
    """ranked(query_id, chunk_id, rank, score, retrieval_type) -> query_id, chunk_id, rank, score, text.

    Hits of statutes take their parents' place, hits of cases get their neighbours, others stay.
    """
    law, case = ranked.where(F.col("retrieval_type") == LAW), ranked.where(F.col("retrieval_type") == CASE)
    other = assemble.with_texts(ranked.where(~F.col("retrieval_type").isin(LAW, CASE)), chunks.select("chunk_id", "text"))
    columns = ["query_id", "chunk_id", "rank", "score", "text"]
    parents = assemble.expand_to_parent(law, chunks).select(*columns)
    places = chunks.select("chunk_id", "doc_id", "chunk_index")
    near = assemble.expand_window(case.join(places, "chunk_id"), chunks, w).select("query_id", "doc_id", "chunk_index", "score", "text", F.col("position").alias("rank"))
    near = near.join(places, ["doc_id", "chunk_index"]).select(*columns)
    return united(other.select(*columns), parents, near)


def renumbered(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id")))


def retrieve(
    prepared: DataFrame, index: search.Index, vectors: DataFrame, chunks: DataFrame, k: int, scores: DataFrame | Callable[[DataFrame], DataFrame] | None = None, most: int | None = None
) -> DataFrame:
    """rules.prepare_queries() rows -> query_id, rank, chunk_id, score, text: the whole of retrieval.

    The corrected query is searched with a budget by its strategy; hits are assembled by its retrieval type.
    Where reranking is on, scores(query_id, chunk_id, score), or what they give for the assembled
    rows(query_id, chunk_id, text), replace scores and order; all are cut to k, and of equal texts the first stays. `most` bounds the budgets: by
    default the greatest that the strategies give.
    """
    highest = max([2.0, *(s[0] for s in rules.STRATEGIES.values())])
    most = most or int(2 * k * highest)
    budget = F.least(search.fetch_budget(k, F.col("k_multiplier")), F.lit(most))
    asked = prepared.select("query_id", F.col("corrected_query").alias("query"), budget.alias("budget"), "retrieval_type", "enable_rerank")
    vectors = materialize(vectors, "vectors")  # read twice
    found = materialize(hybrid(asked, index, vectors, chunks, most), "hybrid").join(asked.select("query_id", "retrieval_type"), "query_id")
    parts = materialize(renumbered(assembled(found, chunks)), "assembled")  # read twice
    marked = parts.join(asked.select("query_id", "enable_rerank"), "query_id")
    if scores is None:
        cut = marked.where(F.col("rank") <= k)
    else:
        again = marked.where("enable_rerank")
        scores = scores(again.select("query_id", "chunk_id", "text").dropDuplicates(["query_id", "chunk_id"])) if callable(scores) else scores
        light = assemble.rerank(again.select("query_id", "chunk_id", "rank", "score"), scores, k)
        texts = parts.select("query_id", "chunk_id", "text").dropDuplicates(["query_id", "chunk_id"])
        plain = marked.where("not enable_rerank").where(F.col("rank") <= k).select(*light.columns, "text")
        cut = united(plain, light.join(texts, ["query_id", "chunk_id"]))
    return renumbered(search.dedup_keep_first(cut)).select("query_id", "rank", "chunk_id", "score", "text")


def routed(prepared: DataFrame, index: search.Index, vectors: DataFrame, chunks: DataFrame, k: int, filters: dict | None = None) -> DataFrame:
    """prepared(query_id, query, tools) -> query_id, rank, chunk_id, score.

    Each scope searches its kind of documents both ways, assembles its hits and drops repeated texts. The
    lists of queries of two scopes are fused by reciprocal rank and cut to k, laws first among equals;
    of one scope, they are sorted by score. filters, on columns of chunks, hold in every scope for what is
    found, not for the parents and neighbours that it is assembled with. Vectors, with the kinds of their chunks, and the weights of
    the queries' terms are written once for all scopes.
    """
    kept = chunks.where(store.metadata_predicate(filters)) if filters else chunks
    vectors = materialize(vectors.join(kept.select("chunk_id", "doc_type").distinct(), "chunk_id"), "vectors")
    terms = index.terms.join(search.query_terms(prepared).select("term").distinct(), "term", "left_semi")
    index = search.Index(index.postings, materialize(terms, "terms"), index.totals)
    parts = []
    for tool, (doc_type, kind) in SCOPES.items():
        asked = prepared.where(F.array_contains("tools", tool)).select("query_id", "query", F.lit(k).alias("budget"))
        found = materialize(hybrid(asked, index, vectors, chunks, k, doc_type, filters), "hybrid").withColumn("retrieval_type", F.lit(kind))
        parts.append(materialize(renumbered(search.dedup_keep_first(renumbered(assembled(found, chunks)))), "scope"))
    both = prepared.where(F.size("tools") == 2).select("query_id")
    of = lambda part, how: part.join(both, "query_id", how)
    keyed = [of(p, "left_semi").withColumn("key", F.substring("text", 1, KEY)).drop("text") for p in parts]
    fused = search.rrf(*keyed, k).select("query_id", "rank", "chunk_id", "score")
    alone = united(of(parts[0], "left_anti"), of(parts[1], "left_anti"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "chunk_id")
    alone = alone.withColumn("_n", F.row_number().over(order)).select("query_id", F.col("_n").alias("rank"), "chunk_id", "score")
    return united(fused, alone)


def stages(near: DataFrame, words: DataFrame, kinds: DataFrame, chunks: DataFrame, scorer: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """The lists of all six stages of a retrieval run: stage, query_id, rank, chunk_id, text, for metrics.relevance.

    near and words (query_id, chunk_id, rank, score, key) are fused, assembled by kinds(query_id,
    retrieval_type), reranked to k and deduplicated. scorer gives (query_id, chunk_id, score) of the
    different rows(query_id, chunk_id, text) that were assembled. Queries missing in kinds, or of a null
    type, are assembled as they are; every stage is written once.
    """
    texts = chunks.select("chunk_id", "text")
    near, words = materialize(near, "near"), materialize(words, "words")
    fused = materialize(search.rrf(near, words, k), "fused")
    typed = fused.join(kinds.select("query_id", "retrieval_type"), "query_id", "left").na.fill("", ["retrieval_type"])
    met = materialize(renumbered(assembled(typed, chunks)), "assembled")
    scores = scorer(met.select("query_id", "chunk_id", "text").dropDuplicates(["query_id", "chunk_id"]))
    light = materialize(assemble.rerank(met.drop("text"), scores, k), "reranked")
    parts = {"vector": near, "bm25": words, "fusion": fused, "assembly": met, "rerank": light}
    parts["dedup"] = renumbered(search.dedup_keep_first(assemble.with_texts(light, texts)))
    lists = [part.select(F.lit(name).alias("stage"), "query_id", "rank", "chunk_id") for name, part in parts.items()]
    return assemble.with_texts(united(*lists), texts)
