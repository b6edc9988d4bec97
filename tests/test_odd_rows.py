"""Nulls, repeats, ties and odd vectors in the library's operators; joins that are approximate against exact ones."""

import numpy as np
from pyspark.sql import functions as F

from corpus_engine.functions import parsing
from corpus_engine.operators import assemble, chunk, context, inverted_file, jobs, quality, search, store
from corpus_engine.plans import text_queries
from corpus_engine.streaming import jobs as streams


def test_observation_of_texts_with_rules_and_nulls(spark):
    schema = "query_id long, rank int, source string, doc_type string, score double, text string"
    rows = [(1, 1, "a", "law", 0.5, "x\n---\ny"), (1, 2, None, None, 0.0, None), (1, 3, "c | d", "case", 1.0, "z" * 801)]
    block = parsing.observation_block(spark.createDataFrame(rows, schema), "law_search", spark.createDataFrame([(1,), (2,)], "query_id long"))
    texts = {r.query_id: r.observation for r in block.collect()}
    assert texts[2] == "[law_search] 未找到相关结果。建议尝试不同的关键词重新检索。"
    assert texts[1].startswith("[law_search] 共找到 3 条结果（返回前 3 条，耗时 0ms）:\n\n[结果1] 来源: a | 类型: law | 相关度: 0.500\nx\n---\ny\n\n---\n\n[结果2] 来源: 未知来源 | 类型:  | 相关度: N/A\n")
    found = [tuple(r)[1:] for r in parsing.parsed_observation(block).orderBy("query_id", "rank").collect()]
    assert found == [(1, "a", "law", 0.5, "x\n---\ny"), (2, "未知来源", "", 0.0, ""), (3, "c | d", "case", 1.0, "z" * 800 + "……")]


def test_ingest_keeps_null_texts_and_one_of_equal_rows(spark):
    rows = spark.createDataFrame([(1, None, 1), (2, None, 2), (3, "a", 3), (3, "a", 3), (3, "a", 4), (4, "a", 5), (5, "b", 6)], "doc_id long, text string, x int")
    known = spark.createDataFrame([("b",)], "text string").select(F.sha2("text", 256).alias("file_hash"))
    found = store.dedup_ingest(rows, known).collect()
    assert sorted((r.doc_id, r.text) for r in found if r.text) == [(3, "a")] and sorted(r.doc_id for r in found if r.text is None) == [1, 2]


def test_context_of_null_sources(spark):
    rows = spark.createDataFrame([(1, 1, None, "a"), (1, 2, "s", None)], "query_id long, rank int, source string, text string")
    assert context.context_block(rows).first().context == "检索到的文档内容：\n[1] 来源: 未知\n内容: a\n\n---\n\n[2] 来源: s\n内容: "


def test_vectors_of_several_lengths_and_odd_components(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, None), (7, [0.0, 0.0])], "chunk_id long, v array<double>")
    asked = rows.where("chunk_id in (1, 3, 4)").withColumnRenamed("chunk_id", "query_id")
    for metric in search.METRICS:
        found = {(r.query_id, r.chunk_id): r.distance for r in search.knn_search(asked, rows, 9, metric).collect()}
        assert set(found) == {(1, 1), (1, 2), (1, 7), (3, 3)} and all(np.isfinite(list(found.values())))


def test_rows_that_share_an_id_are_split_apart(spark):
    law = "第一条 甲\n第二条 乙"
    rows = [(1, "a.md", "x" * 700, "case"), (1, "b.md", "y" * 700, "case"), (2, "a.md", law, "law"), (2, "a.md", law, "law"), (3, "c.md", None, None)]
    found = chunk.route_and_split(spark.createDataFrame(rows, "doc_id long, file_name string, text string, doc_type string"))
    counts = {(r.doc_id, r.chunk_type): r["count"] for r in found.groupBy("doc_id", "chunk_type").count().collect()}
    assert counts == {(1, "plain"): 4, (2, "parent"): 2, (2, "child"): 4}
    assert {r.text for r in found.where("chunk_type = 'child'").collect()} == {"第一条 甲", "第二条 乙"}


def test_updates_that_repeat_an_id(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id long, text string")
    new = spark.createDataFrame([(1, "c"), (1, "d"), (1, None), (2, None), (9, "e")], "chunk_id long, text string")
    assert sorted((r.chunk_id, r.text, r.re_embed) for r in store.update_by_id(rows, new).collect()) == [(1, "d", True), (2, "b", False)]
    titled = context.retitle_sessions(spark.createDataFrame([(1, None)], "session_id long, title string"), spark.createDataFrame([(1, "x"), (1, "y")], "session_id long, title string"))
    assert titled.first().title == "y" and context.create_sessions(spark.createDataFrame([(1, None)], "session_id long, title string")).first().title == "新对话"


def test_approximate_search_is_near_the_exact_one(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    for scale in (1.0, 100.0):
        scaled = rows.withColumn("v", F.transform("v", lambda x: x * scale))
        asked = scaled.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
        exact = {(r.query_id, r.chunk_id) for r in search.knn_search(asked, scaled, 10).collect()}
        found = inverted_file.InvertedFile(scaled).search(asked, 10)[0].collect()
        assert {(r.query_id, r.chunk_id) for r in found} == exact and len(found) == len(exact)
    few = rows.where("chunk_id < 3")
    assert inverted_file.InvertedFile(few).search(few.withColumnRenamed("chunk_id", "query_id"), 10)[0].count() == 9


def test_places_of_findings_are_as_many_as_are_counted(spark, small):
    rows = text_queries.personal(spark, small).unionByName(spark.createDataFrame(
        [(-1, "see http://x&b hElLoWoRlD ABCDef aBCd XMLHttp & a@b.cd\n a@b.cd \n#x (]【））{"), (-2, None), (-3, "HTTPServerABC éABc abcDEf_ g")], "doc_id long, text string"))
    counted = {(r.doc_id, r.rule): r.findings for r in quality.quality_findings(rows).collect()}
    placed = {(r.doc_id, r.rule): r["count"] for r in quality.finding_positions(rows).groupBy("doc_id", "rule").count().collect()}
    assert placed == counted and {r for _, r in counted} == set(quality.RULES)


def test_sources_of_messages(spark):
    schema = "session_id long, id long, role string, content string, created_at timestamp, sources array<struct<content:string,metadata:map<string,string>,score:double>>"
    new = spark.createDataFrame([(1, 5, "user", "q", None, [("c", {"source": "s"}, 0.5)]), (1, 6, "user", "r", None, []), (2, 7, "user", "z", None, None)], schema)
    new = new.withColumn("created_at", F.timestamp_seconds(F.col("id")))
    held = spark.createDataFrame([(1, 4, "user", "o", None, "{bad")], "session_id long, id long, role string, content string, created_at timestamp, sources string")
    sessions = spark.createDataFrame([(1, "t")], "session_id long, title string")
    everything, unknown, touched = context.append_messages(sessions, held, new)
    assert [r.id for r in unknown.collect()] == [7] and touched.first().updated_at is not None
    found = context.session_detail(sessions, everything).first().messages
    assert [(m.id, m.sources[0].content if m.sources else None) for m in found] == [(4, None), (5, "c"), (6, None)]


def test_repeats_in_a_stream_are_those_in_a_table(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/conversations.parquet").select(
        F.col("conv_id").alias("session_id"), (F.col("conv_id") * 60 + F.col("turn")).alias("id"), "role", F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60).alias("created_at"),
    )
    rows.write.parquet(str(tmp_path / "in"))
    stream = streams.repeat_query_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("append").format("memory").queryName("repeats").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = {(r.session_id, r.id, r.likeness) for r in context.repeat_queries(rows).collect()}
    assert {(r.session_id, r.id, r.likeness) for r in spark.table("repeats").collect()} == want and want


def test_bm25_in_tiles_is_the_same(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    asked = spark.read.parquet(f"{small}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    index, terms = search.bm25_index(docs), search.query_terms(asked)
    whole = {(r.query_id, r.chunk_id): r.score for r in search.bm25_scores(terms, index).collect()}
    tiled = {(r.query_id, r.chunk_id): r.score for r in search.bm25_scores(terms, index, tile_rows=50).collect()}
    assert set(whole) == set(tiled) and all(abs(whole[k] - tiled[k]) < 1e-9 for k in whole)


def test_rerank_after_retrieval_and_ingest_into_a_store(spark, small, tmp_path):
    ranked = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.8), (1, 12, 3, 0.7)], "query_id long, chunk_id long, rank int, score double")
    scores = spark.createDataFrame([(1, 12, 5.0)], "query_id long, chunk_id long, score double")
    assert [r.chunk_id for r in assemble.rerank(ranked, scores, 2).orderBy("rank").collect()] == [12, 10]
    known = spark.createDataFrame([], "file_hash string")
    chunks = jobs.ingest(text_queries.legal_files(spark, small).limit(12), known)
    held = jobs.stored(chunks, str(tmp_path / "store"), "laws")
    assert held.count() == chunks.count() and held.where("v is null").count() == 0 and held.select("chunk_id").distinct().count() == held.count()
    assert {r.file_hash is not None for r in jobs.ingest_summary(chunks).collect()} == {True}
