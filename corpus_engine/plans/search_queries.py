"""Registered queries of retrieval and evaluation, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.operators import assemble, chunk, metrics, search
from corpus_engine.shared import materialize, united


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each passage its first 80 characters, which relevant documents contain."""
    return passages(spark, sf_dir).select("query_id", F.substring("query", 1, 80).alias("truth"))


def bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return search.bm25_search(passages(spark, sf_dir), search.bm25_index(whole(spark, sf_dir)), k)


def vectors(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    queries = search.hash_vectors(passages(spark, sf_dir).withColumnRenamed("query", "text"), "query_id")
    return search.knn_search(queries, materialize(search.hash_vectors(whole(spark, sf_dir), "chunk_id"), "vectors"), k)  # read twice


TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]{{2,}}')"
BM25 = f"""
tok AS (SELECT doc_id AS chunk_id, {TOKENS.format('text')} AS toks FROM documents),
post AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS term FROM tok) GROUP BY ALL),
tot AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM tok),
idf0 AS (SELECT term, count(*) AS df, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, tot GROUP BY term, n),
terms AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM qt JOIN terms USING (term) JOIN post USING (term), tot GROUP BY ALL),
ranked AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, score FROM bm)
"""
SQUARED = "list_sum(list_transform(list_zip({0}, {1}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"


def _hash_terms(source: str, key: str) -> str:
    return f"""SELECT {key}, (('0x' || substr(md5(term), 1, 8))::BIGINT % 64)::INT AS place,
        sum(CASE WHEN ('0x' || substr(md5(term), 9, 1))::INT < 8 THEN 1.0 ELSE -1.0 END)::DOUBLE AS w
        FROM (SELECT {key}, unnest(toks) AS term FROM {source}) GROUP BY ALL"""


def _hash_vectors(terms: str, key: str) -> str:
    return f"""SELECT {key}, list_transform(range(0, 64), lambda i: coalesce(m[i::INT], 0.0)::DOUBLE / norm) AS v
        FROM (SELECT {key}, map(list(place), list(w)) AS m, sqrt(sum(w * w)) AS norm FROM {terms} GROUP BY {key}) WHERE norm > 0"""


VECTORS = f"""
qtok AS (SELECT item_id AS query_id, {TOKENS.format('text')} AS toks FROM benchmark),
dterm AS ({_hash_terms('tok', 'chunk_id')}), qterm AS ({_hash_terms('qtok', 'query_id')}),
dvec AS ({_hash_vectors('dterm', 'chunk_id')}), qvec AS ({_hash_vectors('qterm', 'query_id')}),
dist AS (SELECT query_id, chunk_id, round({SQUARED.format('q.v', 'd.v')}, 6) AS distance FROM qvec q, dvec d),
vranked AS (SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM dist)
"""


def bm25_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency and weight of every term of the documents."""
    return search.bm25_index(whole(spark, sf_dir)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25_index(whole(spark, sf_dir)).totals.select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of every passage."""
    return bm25(spark, sf_dir, 5)


def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: statistics over all documents, results from English ones."""
    keep = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("chunk_id"))
    return search.bm25_search(passages(spark, sf_dir), search.bm25_index(whole(spark, sf_dir)), 5, keep)


def bm25_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3."""
    return search.minmax_norm(bm25(spark, sf_dir, 5))


def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest embeddings of every twentieth one."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    return search.knn_search(rows.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), rows, 10)


def knn_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of those the ones of enough similarity."""
    return search.similarity_threshold(knn_exact(spark, sf_dir), 0.4).select("query_id", "chunk_id", "rank", "score")


def knn_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest in each label, merged, the five nearest of all."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), "label")
    near = search.knn_search(rows.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "v"), rows, 3, groups=["label"])
    return search.top_k(near.drop("rank"), 5, [F.col("distance"), F.col("chunk_id")])


def knn_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed term vectors of documents near those of the passages."""
    return vectors(spark, sf_dir, 5)


def _both(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Lists of vectors and of words, both from one index."""
    keys, index = whole(spark, sf_dir).select("chunk_id", F.substring("text", 1, 120).alias("key")), search.bm25_index(whole(spark, sf_dir))
    asked = search.hash_vectors(passages(spark, sf_dir).withColumnRenamed("query", "text"), "query_id")
    near = search.knn_search(asked, materialize(search.posting_vectors(index), "vectors"), k)  # read twice
    near = near.withColumn("score", F.round(search.distance_to_similarity(F.col("distance")), 6)).drop("distance")
    return near.join(keys, "chunk_id"), search.minmax_norm(search.bm25_search(passages(spark, sf_dir), index, k)).join(keys, "chunk_id")


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed vectors and BM25 fused by reciprocal ranks of 120-character prefixes."""
    return search.rrf(*_both(spark, sf_dir, 20), k=10)


def hybrid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many results each retriever gave."""
    near, words = _both(spark, sf_dir, 20)
    ranked = united(near.withColumn("retriever", F.lit("vector")), words.withColumn("retriever", F.lit("bm25")))
    return assemble.hybrid_counts(ranked)


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: equal texts among the twenty best of each passage, the best ranked kept."""
    ranked = assemble.with_texts(bm25(spark, sf_dir, 20), whole(spark, sf_dir))
    return search.dedup_keep_first(ranked).select("query_id", "chunk_id", "rank", "score")


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from elsewhere (here: a hash of the pair) replace the order of ten."""
    ranked = materialize(bm25(spark, sf_dir, 10), "hits")  # read twice
    pair = F.md5(F.concat_ws("|", F.col("query_id").cast("string"), F.col("chunk_id").cast("string")))
    scores = ranked.select("query_id", "chunk_id", (F.conv(F.substring(pair, 1, 6), 16, 10).cast("double") / 16777216).alias("score"))
    return assemble.rerank(ranked, scores, 3).withColumn("score", F.round("score", 6))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """passages' best chunks of 500 characters, with their neighbours."""
    chunks = chunk.split_fixed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    chunks = chunks.withColumn("chunk_id", F.col("doc_id") * 100_000 + F.col("chunk_index"))
    ranked = search.bm25_search(passages(spark, sf_dir), search.bm25_index(chunks), 3)
    ranked = ranked.select(
        "query_id", "rank", "score", (F.expr("chunk_id div 100000")).alias("doc_id"), (F.col("chunk_id") % 100_000).cast("int").alias("chunk_index")
    )
    return assemble.expand_window(ranked, chunks)


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits on 500-character chunks take the place of their document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = chunk.split_fixed(docs).select((F.col("doc_id") * 100_000 + F.col("chunk_index") + 1).alias("chunk_id"), (F.col("doc_id") * 100_000).alias("parent_chunk_id"), "text")
    whole_ = docs.select((F.col("doc_id") * 100_000).alias("chunk_id"), F.lit(None).cast("long").alias("parent_chunk_id"), "text")
    ranked = search.bm25_search(passages(spark, sf_dir), search.bm25_index(chunks), 3)
    return assemble.expand_to_parent(ranked, chunks.unionByName(whole_)).withColumn("text", F.md5("text"))


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = whole(spark, sf_dir)
    near, words = (materialize(part, "lists") for part in _both(spark, sf_dir, 10))
    fused = materialize(search.rrf(near, words, k=10), "fused")
    parts = {"vector": near, "bm25": words, "fusion": fused}
    parts["dedup"] = search.dedup_keep_first(assemble.with_texts(fused, texts)).select("query_id", "chunk_id", "rank", "score")
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("stage"), "query_id", "rank", "chunk_id")
        out = part if out is None else out.unionByName(part)
    return assemble.with_texts(out, texts)


def _relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.relevance(_stages(spark, sf_dir), truths(spark, sf_dir), lambda text, truth: text.contains(truth))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit, recall, precision, NDCG and MRR of BM25 over all passages."""
    found = assemble.with_texts(bm25(spark, sf_dir, 10), whole(spark, sf_dir)).withColumn("stage", F.lit("bm25"))
    rel = metrics.relevance(found, truths(spark, sf_dir), lambda text, truth: text.contains(truth))
    return metrics.stage_metrics(metrics.metrics_at_k(rel), passages(spark, sf_dir))


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of every stage."""
    return metrics.stage_metrics(metrics.metrics_at_k(_relevance(spark, sf_dir)), passages(spark, sf_dir))


def evaluation_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stage changes."""
    return metrics.stage_deltas(evaluation(spark, sf_dir))


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of an answer from the similarities of its hits."""
    return metrics.answer_confidence(knn_similar(spark, sf_dir))


def lenient_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance by containment or shared tokens, the default match."""
    found = assemble.with_texts(bm25(spark, sf_dir, 5), whole(spark, sf_dir)).withColumn("stage", F.lit("bm25"))
    return metrics.relevance(found, passages(spark, sf_dir).withColumnRenamed("query", "truth"))


_FIRST = "SELECT query_id, chunk_id, rank, score FROM ranked"
_MINMAX = """SELECT query_id, chunk_id, rank, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 / (1 + score)
    ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS score FROM ({0}) WINDOW w AS (PARTITION BY query_id)"""
_VSIM = "SELECT query_id, chunk_id, rank, round(1 / (1 + distance), 6) AS score FROM vranked WHERE rank <= {0}"


def _lists(k: int) -> str:
    return f"""vlist AS ({_VSIM.format(k)}), blist AS ({_MINMAX.format(f'{_FIRST} WHERE rank <= {k}')}),
both_lists AS (SELECT *, 0 AS l FROM vlist UNION ALL SELECT *, 1 AS l FROM blist),
keyed AS (SELECT b.*, substr(d.text, 1, 120) AS key, max(l) OVER (PARTITION BY query_id) - min(l) OVER (PARTITION BY query_id) + 1 AS n
          FROM both_lists b JOIN documents d ON d.doc_id = b.chunk_id),
fused0 AS (SELECT query_id, key, sum(1.0::DOUBLE / (60 + rank)) AS rrf, arg_min(score, l * 1000 + rank) AS raw, arg_min(chunk_id, l * 1000 + rank) AS chunk_id,
           min(l * 1000 + rank) AS first, max(n) AS n, min(l) AS ml FROM keyed GROUP BY ALL),
fused1 AS (SELECT *, round(CASE WHEN n = 2 THEN rrf ELSE raw END, 6) AS score,
           CASE WHEN n = 2 THEN 'RRF' WHEN ml = 0 THEN 'vector-only' ELSE 'bm25-only' END AS fusion_method FROM fused0),
fused AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_id) AS rank, score, fusion_method FROM fused1)"""


def _metrics(stages: str) -> str:
    """Metric SQL over stages(stage, query_id, rank, chunk_id)."""
    return f"""st AS ({stages}),
rel AS (SELECT s.stage, s.query_id, s.rank, contains(d.text, substr(b.text, 1, 80))::INT AS rel
        FROM st s JOIN documents d ON d.doc_id = s.chunk_id JOIN benchmark b ON b.item_id = s.query_id),
cut AS (SELECT * FROM rel, (SELECT unnest([1, 3, 5, 10]) AS k)),
per AS (SELECT stage, query_id, k, sum(CASE WHEN rank <= k THEN rel ELSE 0 END) AS hits,
        sum(CASE WHEN rank <= k THEN rel ELSE 0 END / log2(rank + 1)) AS dcg, min(CASE WHEN rel = 1 THEN rank END) AS first FROM cut GROUP BY ALL),
pq AS (SELECT stage, k, hits::DOUBLE AS recall, hits / k AS precision,
       CASE WHEN hits > 0 THEN dcg / list_sum(list_transform(range(1, hits::INT + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg,
       (hits > 0)::INT AS hit, coalesce(1.0::DOUBLE / first, 0) AS rr FROM per),
m AS (SELECT stage, k::INT AS k, sum(recall) / n AS recall, sum(precision) / n AS precision, sum(ndcg) / n AS ndcg, sum(hit) / n AS hit, sum(rr) / n AS mrr, n
      FROM pq, (SELECT count(*) AS n FROM benchmark) GROUP BY stage, k, n),
mm AS (SELECT stage, k, round(recall, 4) AS recall, round(precision, 4) AS precision, round(ndcg, 4) AS ndcg, round(hit, 4) AS hit, round(mrr, 4) AS mrr,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 4) AS f1, n FROM m)"""


_STAGES = """SELECT 'vector' AS stage, query_id, rank, chunk_id FROM vlist UNION ALL SELECT 'bm25', query_id, rank, chunk_id FROM blist
UNION ALL SELECT 'fusion', query_id, rank, chunk_id FROM fused WHERE rank <= 10
UNION ALL SELECT 'dedup', query_id, rank, chunk_id FROM (SELECT f.*, row_number() OVER (PARTITION BY query_id, md5(d.text) ORDER BY rank, chunk_id) AS x
          FROM fused f JOIN documents d ON d.doc_id = f.chunk_id WHERE rank <= 10) WHERE x = 1"""
_EVALUATION = f"WITH {BM25}, {VECTORS}, {_lists(10)}, {_metrics(_STAGES)}"
_KNN = f"""edist AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, e.label, round({SQUARED.format('q.embedding::DOUBLE[]', 'e.embedding::DOUBLE[]')}, 6) AS distance
FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
eranked AS (SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM edist)"""
_SIMILAR = "SELECT query_id, chunk_id, rank, score FROM (SELECT *, round(1 / (1 + distance), 6) AS score FROM eranked WHERE rank <= 10) WHERE score >= 0.4"
_CHUNKS = """SELECT doc_id, i::INT AS chunk_index, doc_id * 100000 + i AS chunk_id, substr(text, i * 450 + 1, 500) AS text
FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil((len(text) - 50) / 450.0)::INT))) AS i FROM documents)"""
_CHUNK_BM25 = BM25.replace("SELECT doc_id AS chunk_id,", "SELECT chunk_id,").replace("FROM documents)", "FROM ch)")

QUERIES = {
    f.__name__: f
    for f in (
        knn_exact, knn_similar, knn_collections, bm25_totals, bm25_terms, bm25_top5, bm25_filtered, bm25_minmax, knn_text, hybrid_rrf,
        hybrid_summary, deduped, reranked, windows, parents, flagship, evaluation, evaluation_gain, confidence, lenient_relevance,
    )
}
ORACLE_SQL = {
    "bm25_terms": f"""WITH t AS (SELECT unnest(list_distinct({TOKENS.format('text')})) AS term FROM documents), d AS (SELECT term, count(*) AS df FROM t GROUP BY term),
        i AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM d, (SELECT count(*) AS n FROM documents))
        SELECT term, df, round(CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i) ELSE idf END, 6) AS idf FROM i""",
    "bm25_totals": f"SELECT count(*) AS n, round(avg(len({TOKENS.format('text')})), 6) AS avgdl FROM documents",
    "bm25_top5": f"WITH {BM25} {_FIRST} WHERE rank <= 5",
    "bm25_filtered": f"""WITH {BM25} SELECT query_id, chunk_id, rank, score FROM (SELECT query_id, chunk_id, score,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
        FROM bm WHERE chunk_id IN (SELECT doc_id FROM documents WHERE lang = 'en')) WHERE rank <= 5""",
    "bm25_minmax": f"WITH {BM25} {_MINMAX.format(f'{_FIRST} WHERE rank <= 5')}",
    "knn_exact": f"WITH {_KNN} SELECT query_id, chunk_id, distance, rank FROM eranked WHERE rank <= 10",
    "knn_similar": f"WITH {_KNN} {_SIMILAR}",
    "knn_collections": f"""WITH {_KNN} SELECT query_id, label, chunk_id, distance, rank FROM (SELECT query_id, label, chunk_id, distance,
        row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, chunk_id) AS r FROM edist) WHERE r <= 3) WHERE rank <= 5""",
    "knn_text": f"WITH {BM25}, {VECTORS} SELECT query_id, chunk_id, distance, rank FROM vranked WHERE rank <= 5",
    "hybrid_rrf": f"WITH {BM25}, {VECTORS}, {_lists(20)} SELECT * FROM fused WHERE rank <= 10",
    "hybrid_summary": f"""WITH {BM25}, {VECTORS}, {_lists(20)} SELECT query_id, count(*) FILTER (l = 0) AS vector_count, count(*) FILTER (l = 1) AS bm25_count,
        CASE WHEN count(*) FILTER (l = 1) > 0 THEN 'RRF' ELSE 'vector-only' END AS fusion_method FROM both_lists GROUP BY query_id""",
    "deduped": f"""WITH {BM25} SELECT query_id, chunk_id, rank, score FROM (SELECT r.*, row_number() OVER (PARTITION BY query_id, md5(d.text) ORDER BY rank, chunk_id) AS x
        FROM ranked r JOIN documents d ON d.doc_id = r.chunk_id WHERE rank <= 20) WHERE x = 1""",
    "reranked": f"""WITH {BM25}, t AS (SELECT query_id, chunk_id, rank, score, ('0x' || substr(md5(query_id || '|' || chunk_id), 1, 6))::BIGINT / 16777216 AS new,
        count(*) OVER (PARTITION BY query_id) AS n FROM ranked WHERE rank <= 10)
        SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT query_id, chunk_id, CASE WHEN n > 3 THEN new ELSE score END AS score,
        row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 3 THEN rank END, CASE WHEN n > 3 THEN new ELSE score END DESC, chunk_id) AS rank FROM t) WHERE rank <= 3""",
    "windows": f"""WITH ch AS ({_CHUNKS}), {_CHUNK_BM25},
        near AS (SELECT query_id, chunk_id // 100000 AS doc_id, chunk_id % 100000 AS ci, rank, score, unnest(range(chunk_id % 100000 - 1, chunk_id % 100000 + 2)) AS pos FROM ranked WHERE rank <= 3),
        own AS (SELECT *, row_number() OVER w AS x, max(CASE WHEN pos = ci THEN score END) OVER (PARTITION BY query_id, doc_id, pos) AS own FROM near WINDOW w AS (PARTITION BY query_id, doc_id, pos ORDER BY rank))
        SELECT query_id, o.doc_id, pos::INT AS chunk_index, coalesce(own, score) AS score, own IS NOT NULL AS hit,
        row_number() OVER (PARTITION BY query_id ORDER BY rank, pos, o.doc_id) AS position, c.text FROM own o JOIN ch c ON c.doc_id = o.doc_id AND c.chunk_index = o.pos WHERE x = 1""",
    "parents": f"""WITH ch AS (SELECT doc_id, chunk_id + 1 AS chunk_id, text FROM ({_CHUNKS})), {_CHUNK_BM25}
        SELECT query_id, doc_id * 100000 AS chunk_id, rank, score, md5(d.text) AS text FROM ranked JOIN documents d ON d.doc_id = (chunk_id - 1) // 100000 WHERE rank <= 3""",
    "flagship": f"WITH {BM25}, {_metrics(chr(39).join(['SELECT ', 'bm25', ' AS stage, query_id, rank, chunk_id FROM ranked WHERE rank <= 10']))} SELECT * FROM mm",
    "evaluation": f"{_EVALUATION} SELECT * FROM mm",
    "evaluation_gain": f"""{_EVALUATION}, o AS (SELECT *, list_position(['vector', 'bm25', 'fusion', 'assembly', 'rerank', 'dedup'], stage) AS no FROM mm)
        SELECT stage, k, {', '.join(f'round({c} - lag({c}) OVER w, 4) AS {c}_gain' for c in ('recall', 'precision', 'ndcg', 'hit', 'mrr'))} FROM o WINDOW w AS (PARTITION BY k ORDER BY no)""",
    "confidence": f"WITH {_KNN} SELECT query_id, round(least((0.6 * max(score) + 0.4 * avg(score)) * least(count(*) / 5, 1), 1), 6) AS confidence FROM ({_SIMILAR}) GROUP BY query_id",
    "lenient_relevance": f"""WITH {BM25}, r AS (SELECT query_id, rank, lower(trim(d.text)) AS a, lower(trim(b.text)) AS t FROM ranked JOIN documents d ON d.doc_id = chunk_id JOIN benchmark b ON b.item_id = query_id WHERE rank <= 5),
        s AS (SELECT *, list_distinct({TOKENS.format('a')}) AS own, list_distinct({TOKENS.format('t')}) AS wanted FROM r)
        SELECT 'bm25' AS stage, query_id, rank, (a <> '' AND (contains(a, t) OR contains(t, a) OR len(list_intersect(own, wanted)) / len(wanted) >= 0.3))::INT AS rel, 1 AS total FROM s""",
}
