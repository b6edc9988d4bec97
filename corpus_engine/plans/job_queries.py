"""Registered queries of whole jobs and their reports, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.functions import rules, text
from corpus_engine.operators import assemble, context, jobs, metrics, quality, retrieve, search
from corpus_engine.operators.contexts import build_contexts
from corpus_engine.operators.findings import distinct_findings
from corpus_engine.operators.inverted_file import InvertedFile
from corpus_engine.plans import search_queries, store_queries, text_queries
from corpus_engine.plans.search_queries import bm25, passages, table, whole
from corpus_engine.sources import files
from corpus_engine.streaming import jobs as streams


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as statutes and decisions: deduplicated, cleaned, classified, cut."""
    known = table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("file_hash"))
    return jobs.ingest_summary(jobs.ingest(text_queries.legal_files(spark, sf_dir), known))


def preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D19."""
    return jobs.preprocess_summary(table(spark, sf_dir, "documents"))


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = passages(spark, sf_dir).withColumn("tools", F.when(F.col("query_id") % 5 == 4, F.array().cast("array<string>")).when(F.col("query_id") % 2 == 0, F.array(F.lit("law_search"))).otherwise(F.array(F.lit("law_search"), F.lit("case_search"))))
    kinds = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("lang") == "en", "law").otherwise("case").alias("doc_type"))
    return jobs.routed_search(asked, search.bm25_index(whole(spark, sf_dir)), kinds, 3)


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes of each query searched apart and sorted together."""
    return jobs.concat_sort(_routed(spark, sf_dir))


def routed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of each query and the time of its scopes, one after the other."""
    found = _routed(spark, sf_dir)
    times = found.groupBy("query_id", "scope").agg(F.sum("rank").alias("ms"))
    return jobs.tool_stats(found, times)


def top_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the queries that search anything."""
    return jobs.top_score_confidence(passages(spark, sf_dir), jobs.concat_sort(_routed(spark, sf_dir)))


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time up to each stage, from turns as stages and lengths as times."""
    turns = table(spark, sf_dir, "conversations")
    return metrics.stage_latency(turns.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("stage_no"), F.concat(F.lit("s"), F.col("turn").cast("string")).alias("stage"), F.length("text").alias("ms")))


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn against the turn before."""
    turns = table(spark, sf_dir, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    answers = turns.where("role = 'assistant'").join(before, ["conv_id", "turn"], "left")
    return metrics.generation_metrics(answers.select(F.col("text").alias("answer"), "reference", F.array(F.substring("reference", 1, 5)).alias("refs")))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which queries need a model, and what of its answer is taken."""
    asked = text_queries.questions(spark, sf_dir)
    new = F.when(F.col("query_id") % 3 == 0, F.lit("")).when(F.col("query_id") % 3 == 1, F.concat("query", F.lit("。"))).otherwise(F.repeat("query", 4))
    return asked.select(
        "query_id", rules.needs_correction(F.col("query")).alias("needed"), rules.accept_correction(F.col("query"), new).alias("taken"),
        text.sanitise_query(F.concat(F.lit(" user: <<"), "query", F.lit(">>"))).alias("safe"),
    )


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best documents of each passage as a context."""
    found = assemble.with_texts(bm25(spark, sf_dir, 3), whole(spark, sf_dir)).withColumn("source", F.col("chunk_id").cast("string"))
    return context.context_block(found).withColumn("context", F.md5("context"))


def session_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their messages in order."""
    rows = store_queries.messages(spark, sf_dir)
    found = context.session_detail(rows.select("session_id").distinct(), rows)
    return found.select("session_id", F.array_join(F.transform("messages", lambda m: m["id"].cast("string")), ",").alias("ids"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: two ways of cleaning against none, by type of finding."""
    rows = text_queries.personal(spark, sf_dir)
    before = quality.quality_findings(rows, ("spaces", "newlines", "controls"))
    out = None
    for name, step in (("control", text.strip_control), ("space", text.collapse_space)):
        after = quality.quality_findings(rows.withColumn("text", step(F.col("text"))), ("spaces", "newlines", "controls"))
        part = quality.compare_before_after(before, after).withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def knn_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest embeddings of every twentieth one by an inverted file whose bound passes no neighbour by."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    return InvertedFile(rows).search(rows.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), 10)[0]


def findings_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a document that are not much like another one."""
    found = quality.quality_findings(text_queries.personal(spark, sf_dir))
    described = found.select("doc_id", "error_type", F.concat("rule", F.lit(" found "), F.col("findings").cast("string")).alias("description"), "severity")
    return distinct_findings(described)


def _decades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the ten chunks of a file each, the first of which is the parent of the others; English ones are laws."""
    doc_id = F.col("doc_id")
    place = (doc_id % 10).cast("int")
    return table(spark, sf_dir, "documents").select(
        doc_id.alias("chunk_id"), F.when(place > 0, doc_id - place).alias("parent_chunk_id"), F.expr("doc_id div 10").alias("doc_id"), place.alias("chunk_index"), "text",
        F.when(F.col("lang") == "en", "law").otherwise("case").alias("doc_type"),
    )


def _lawful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages behind questions of all kinds, the first 60 characters of them."""
    asked = F.element_at(F.array(*[F.lit(q) for q in text_queries.QUESTIONS]), (F.col("item_id") % len(text_queries.QUESTIONS) + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(asked, F.lit(" "), F.substring("text", 1, 60)).alias("query"))


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions corrected, classified, searched both ways by their budgets, assembled, reranked, cut to 3, deduplicated."""
    chunks, prepared = _decades(spark, sf_dir), rules.prepare_queries(_lawful(spark, sf_dir), text_queries.AS_OF_YEAR)
    index = search.bm25_index(chunks)
    pair = F.md5(F.concat_ws("|", F.col("query_id").cast("string"), F.col("chunk_id").cast("string")))
    found = retrieve.retrieve(prepared, index, search.posting_vectors(index), chunks, 3)
    return found.select("query_id", "rank", "chunk_id", "score", F.md5("text").alias("text"), F.substring(pair, 1, 4).alias("pair"))


def retrieved_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As retrieved, and where the strategy reranks, hashes of pairs as the scores of another model."""
    chunks, prepared = _decades(spark, sf_dir), rules.prepare_queries(_lawful(spark, sf_dir), text_queries.AS_OF_YEAR)
    index = search.bm25_index(chunks)
    pair = F.md5(F.concat_ws("|", F.col("query_id").cast("string"), F.col("chunk_id").cast("string")))
    score = F.conv(F.substring(pair, 1, 6), 16, 10).cast("double") / 16777216
    scorer = lambda rows: rows.select("query_id", "chunk_id", score.alias("score"))
    found = retrieve.retrieve(prepared, index, search.posting_vectors(index), chunks, 3, scorer)
    return found.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"), F.md5("text").alias("text"))


def contexts_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest message of each session as its question, passages as what was retrieved; history in 300 tokens."""
    turns = store_queries.messages(spark, sf_dir)
    newest = turns.groupBy("session_id").agg(F.max(F.struct("created_at", "id", "content")).alias("n"))
    kind = F.when(F.col("session_id") % 3 == 0, "law").when(F.col("session_id") % 3 == 1, "odd")
    asked = newest.select("session_id", F.col("n.content").alias("question"), kind.alias("query_type"))
    history = turns.join(newest.select(F.col("n.id").alias("id")), "id", "left_anti")
    found = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "passage")
    met = asked.where("session_id % 4 > 0").join(found, (F.col("session_id") % 10 == F.col("item_id") % 10) & (F.col("item_id") < 30))
    results = met.select("session_id", F.expr("int(item_id div 10)").alias("rank"), F.col("item_id").cast("string").alias("source"), F.col("passage").alias("text"))
    known = spark.createDataFrame([("law", "LAW {retrieval_block} END", "law alone"), ("other", "ANY {retrieval_block}", "any alone")], "query_type string, with_context string, without_context string")
    built = build_contexts(history, asked, results, known, "other", 1500, 500)
    return built.withColumn("content", F.md5("content"))


def routed_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes searched both ways and assembled; those of queries of two are fused."""
    chunks = _decades(spark, sf_dir)
    index = search.bm25_index(chunks)
    scopes = F.when(F.col("query_id") % 3 == 0, F.array(F.lit("law_search"))).when(F.col("query_id") % 3 == 1, F.array(F.lit("case_search"))).otherwise(F.array(F.lit("law_search"), F.lit("case_search")))
    return retrieve.routed(passages(spark, sf_dir).withColumn("tools", scopes), index, search.posting_vectors(index), chunks, 4)


def routed_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As routed_both_ways, only chunks of five years and three sources are found."""
    made = (2015 + F.col("chunk_id") % 10).cast("int")
    chunks = _decades(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source"), "chunk_id").withColumn("year", made)
    index = search.bm25_index(chunks)
    scopes = F.when(F.col("query_id") % 3 == 0, F.array(F.lit("law_search"))).when(F.col("query_id") % 3 == 1, F.array(F.lit("case_search"))).otherwise(F.array(F.lit("law_search"), F.lit("case_search")))
    filters = {"year_range": {"start": 2017, "end": 2021}, "source": ["src1", "src2", "src5"], "unused": []}
    return retrieve.routed(passages(spark, sf_dir).withColumn("tools", scopes), index, search.posting_vectors(index), chunks, 4, filters)


def evaluation_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of all six stages; passages take parents, neighbours or nothing by turns, hashes of the pairs rerank them."""
    kind = F.when(F.col("query_id") % 3 == 0, retrieve.LAW).when(F.col("query_id") % 3 == 1, retrieve.CASE).otherwise("其他")
    asked = passages(spark, sf_dir).select("query_id", kind.alias("retrieval_type"))
    pair = F.md5(F.concat_ws("|", F.col("query_id").cast("string"), F.col("chunk_id").cast("string")))
    score = F.conv(F.substring(pair, 1, 6), 16, 10).cast("double") / 16777216
    near, words = search_queries._both(spark, sf_dir, 10)
    found = retrieve.stages(near, words, asked, _decades(spark, sf_dir), lambda rows: rows.select("query_id", "chunk_id", score.alias("score")), 10)
    rel = metrics.relevance(found, search_queries.truths(spark, sf_dir), lambda text, truth: text.contains(truth))
    return metrics.stage_metrics(metrics.metrics_at_k(rel), passages(spark, sf_dir))


def numbered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages of their conversation."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 2 + 5).alias("position"))
    return files.number_pages(turns)


def appended_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turns appended to sessions of even ids; those of others are turned away, the time of the session follows."""
    rows = store_queries.messages(spark, sf_dir)
    last = rows.where("id % 60 >= 3")
    sessions = rows.where("session_id % 2 = 0").select("session_id").distinct()
    everything, unknown, touched = context.append_messages(sessions, rows.where("id % 60 < 3"), last)
    counts = everything.groupBy("session_id").agg(F.count("*").alias("messages"))
    return counts.join(unknown.groupBy("session_id").agg(F.count("*").alias("unknown")), "session_id", "left").join(touched, "session_id", "left")


def samples_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of samples merged, 20 of each, none without a truth."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), F.when(F.col("doc_id") % 4 > 0, F.array("source")).otherwise(F.array().cast("array<string>")).alias("ground_truth"))
    both = files.merge_datasets([rows.where("position % 2 = 0"), rows.where("position % 3 = 0")])
    return files.drop_samples_without_truth(files.limit_per_dataset(both, 20)).select("dataset", "position")


def truth_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as questions of two kinds, and those that some document answers."""
    rows = table(spark, sf_dir, "benchmark").select(
        F.when(F.col("item_id") % 2 == 0, "qa").otherwise("mcq").alias("source_type"), F.when(F.length("text") % 3 > 0, F.array("text")).otherwise(F.array().cast("array<string>")).alias("ground_truth")
    )
    return metrics.ground_truth_coverage(rows)


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many results each stage gave each passage."""
    return assemble.stage_result_counts(search_queries._stages(spark, sf_dir).select("query_id", "stage"), ["vector", "bm25", "fusion", "dedup"])


def language_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each collection, the batch twin of the stream."""
    return streams.corpus_counts(table(spark, sf_dir, "documents").withColumnRenamed("lang", "collection"))


def bm25_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: BM25 with another tokenizer: runs of letters, case kept."""
    letters = lambda text: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))
    return search.bm25_search(passages(spark, sf_dir), search.bm25_index(whole(spark, sf_dir), letters), 5, tokenizer=letters)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of every passage, with the context of those that have an even id."""
    known = spark.createDataFrame([("law", "LAW {retrieval_block} END", "law alone"), ("other", "ANY {retrieval_block}", "any alone")], "query_type string, with_context string, without_context string")
    kind = F.when(F.col("query_id") % 3 == 0, "law").when(F.col("query_id") % 3 == 1, "odd")
    texts = passages(spark, sf_dir).where("query_id % 2 = 0").select("query_id", F.col("query").alias("context"))
    return context.select_prompt(passages(spark, sf_dir).withColumn("query_type", kind), known, texts, "other")


def findings_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H41, native: the first finding of each document, type and rule."""
    found = quality.quality_findings(text_queries.personal(spark, sf_dir), ("spaces", "newlines", "controls"))
    described = found.select("doc_id", "error_type", "rule", F.explode(F.array(F.concat("rule", F.lit(" b")), F.concat("rule", F.lit(" a")))).alias("description"), "severity")
    return jobs.distinct_kinds(described)


QUERIES = {
    f.__name__: f
    for f in (
        retrieved_reranked, routed_filtered, contexts_built, ingested, preprocessed, routed, routed_stats, top_confidence, latencies, generated, corrections, contexts, session_details, variants,
        knn_approximate, findings_apart, retrieved, routed_both_ways, evaluation_whole, numbered_pages, appended_messages, samples_kept, truth_coverage, stage_counts,
        language_sizes, bm25_letters, prompts, findings_by_kind,
    )
}
_ROUTED = f"""WITH {search_queries.BM25}, sc AS (SELECT item_id AS query_id, unnest(CASE WHEN item_id % 5 = 4 THEN []::VARCHAR[] WHEN item_id % 2 = 0 THEN ['law_search'] ELSE ['law_search', 'case_search'] END) AS scope FROM benchmark),
kd AS (SELECT doc_id AS chunk_id, CASE WHEN lang = 'en' THEN 'law_search' ELSE 'case_search' END AS scope FROM documents),
rt AS (SELECT * FROM (SELECT query_id, scope, chunk_id, score, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, chunk_id) AS r FROM bm JOIN kd USING (chunk_id) JOIN sc USING (query_id, scope)) WHERE r <= 3),
cs AS (SELECT query_id, scope, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id, scope) AS rank FROM rt)"""
_MADE = f"CASE WHEN query_id % 3 = 0 THEN '' WHEN query_id % 3 = 1 THEN query || '。' ELSE repeat(query, 4) END"
_FORMAT = (" {3,}", "\\n{3,}", "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]")


def _variant(name: str, cleaned: str) -> str:
    count = lambda column: "sum(" + " + ".join(f"len(regexp_extract_all({column}, '{p}'))" for p in _FORMAT) + ")::BIGINT"
    return f"""SELECT '{name}' AS variant, 'format' AS error_type, before, after, before - after AS errors_reduced,
        CASE WHEN before > 0 THEN round((before - after) / before * 100, 2) ELSE 0 END AS reduction_rate
        FROM (SELECT {count('text')} AS before, {count('t')} AS after FROM (SELECT text, {cleaned} AS t FROM ({text_queries._PERSONAL})))"""


def _fused(name: str, near: str, words: str, texts: str = "documents") -> str:
    """CTE `name` of fused results of near and words (query_id, chunk_id, rank, score), as search.rrf gives them."""
    return f"""{name}_m AS ({search_queries._MINMAX.format(f'SELECT query_id, chunk_id, rank, score FROM {words}')}),
{name}_l AS (SELECT *, 0 AS l FROM (SELECT query_id, chunk_id, rank, score FROM {near}) UNION ALL SELECT *, 1 AS l FROM {name}_m),
{name}_k AS (SELECT b.*, substr(d.text, 1, 120) AS key, max(l) OVER (PARTITION BY query_id) - min(l) OVER (PARTITION BY query_id) + 1 AS n FROM {name}_l b JOIN {texts} d ON d.doc_id = b.chunk_id),
{name}_0 AS (SELECT query_id, key, sum(1.0::DOUBLE / (60 + rank)) AS rrf, arg_min(score, l * 1000 + rank) AS raw, arg_min(chunk_id, l * 1000 + rank) AS chunk_id, min(l * 1000 + rank) AS first, max(n) AS n FROM {name}_k GROUP BY query_id, key),
{name}_1 AS (SELECT *, round(CASE WHEN n = 2 THEN rrf ELSE raw END, 6) AS score FROM {name}_0),
{name} AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_id) AS rank, score FROM {name}_1)"""


def _assembled(name: str, found: str) -> str:
    """CTE `name` of found(query_id, chunk_id, rank, score, kind): laws' parents, cases' neighbours, others; ranks run from 1."""
    return f"""{name}_p AS (SELECT query_id, coalesce(p.doc_id, chunk_id) AS chunk_id, rank, score FROM {found} LEFT JOIN documents p ON p.doc_id = chunk_id // 10 * 10 AND chunk_id % 10 > 0 WHERE kind = '法条'),
{name}_n AS (SELECT query_id, chunk_id // 10 AS f, chunk_id % 10 AS ci, rank, score, unnest(range(chunk_id % 10 - 1, chunk_id % 10 + 2)) AS pos FROM {found} WHERE kind = '案例'),
{name}_o AS (SELECT *, row_number() OVER w AS x, max(CASE WHEN pos = ci THEN score END) OVER (PARTITION BY query_id, f, pos) AS own FROM {name}_n WINDOW w AS (PARTITION BY query_id, f, pos ORDER BY rank)),
{name}_w AS (SELECT query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, pos, f) AS rank, coalesce(own, score) AS score FROM {name}_o JOIN documents ON doc_id = f * 10 + pos AND pos BETWEEN 0 AND 9 WHERE x = 1),
{name} AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS rank, score FROM (
  SELECT * FROM {name}_p UNION ALL SELECT * FROM {name}_w UNION ALL SELECT query_id, chunk_id, rank, score FROM {found} WHERE kind NOT IN ('法条', '案例')))"""


def _deduped(name: str, found: str) -> str:
    return f"""{name} AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS rank, score FROM (
  SELECT r.*, row_number() OVER (PARTITION BY query_id, md5(d.text) ORDER BY rank, chunk_id) AS x FROM {found} r JOIN documents d ON d.doc_id = chunk_id) WHERE x = 1)"""


def _retrieved_sql(rerank: bool = False) -> str:
    asked = f"asked AS (SELECT item_id AS query_id, {text_queries._LIST}[item_id % {len(text_queries.QUESTIONS)} + 1] || ' ' || substr(text, 1, 60) AS query FROM benchmark)"
    prepared = text_queries._prepared_sql().replace(text_queries._ASKED, asked).replace(" AS doc_type FROM t", " AS doc_type, q FROM t")
    tokens = """(SELECT query_id, unnest(list_concat(
      list_filter(regexp_extract_all(lower(q), '(?:[^\\P{L}\\x{4e00}-\\x{9fff}]|[^\\P{N}\\x{4e00}-\\x{9fff}])+'), lambda t: len(t) > 1),
      flatten(list_transform(regexp_extract_all(lower(q), '[\\x{4e00}-\\x{9fff}]{2,}'), lambda r: list_transform(range(1, len(r)), lambda i: substr(r, i, 2)))))) AS term FROM pq)"""
    words = search_queries.BM25.replace(f"(SELECT item_id AS query_id, unnest({search_queries.TOKENS.format('text')}) AS term FROM benchmark)", tokens)
    near = search_queries.VECTORS.replace(f"qtok AS (SELECT item_id AS query_id, {search_queries.TOKENS.format('text')} AS toks FROM benchmark),", f"qtok AS (SELECT query_id, list(term) AS toks FROM {tokens} GROUP BY query_id),")
    return f"""WITH pq AS ({prepared}), pb AS (SELECT query_id, greatest(3, floor(6 * k_multiplier)::INT) AS budget, retrieval_type AS kind, enable_rerank FROM pq), {words}, {near},
rv AS (SELECT query_id, chunk_id, rank, round(1 / (1 + distance), 6) AS score FROM vranked JOIN pb USING (query_id) WHERE rank <= budget),
rw AS (SELECT query_id, chunk_id, rank, score FROM ranked JOIN pb USING (query_id) WHERE rank <= budget),
{_fused('rf', 'rv', 'rw')}, rk AS (SELECT rf.*, kind FROM rf JOIN pb USING (query_id) WHERE rank <= budget),
{_assembled('ra', 'rk')}, {_RERANKED if rerank else 'rc AS (SELECT * FROM ra WHERE rank <= 3)'}, {_deduped('rd', 'rc')}
SELECT query_id, rank, chunk_id, {'round(score, 6) AS score' if rerank else 'score'}, md5(text) AS text{'' if rerank else ", substr(md5(query_id || '|' || chunk_id), 1, 4) AS pair"} FROM rd JOIN documents ON doc_id = chunk_id"""


_RERANKED = """rn AS (SELECT ra.*, enable_rerank AND count(*) OVER (PARTITION BY query_id) > 3 AS many, ('0x' || substr(md5(query_id || '|' || chunk_id), 1, 6))::BIGINT / 16777216 AS new FROM ra JOIN pb USING (query_id)),
ro AS (SELECT query_id, chunk_id, CASE WHEN many THEN new ELSE score END AS score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN NOT many THEN rank END, CASE WHEN many THEN new ELSE score END DESC, chunk_id) AS place FROM rn),
rc AS (SELECT query_id, chunk_id, score, place AS rank FROM ro WHERE place <= 3)"""
_BUILT = f"""WITH {store_queries._M}, n AS (SELECT *, {store_queries._NEWEST} AS n FROM m),
q AS (SELECT session_id, content AS question FROM n WHERE n = 1), h AS (SELECT *, n <= 5 AS protected FROM n WHERE n > 1),
ctx AS (SELECT session_id, '检索到的文档内容：' || chr(10) || string_agg('[' || (item_id // 10 + 1) || '] 来源: ' || item_id || chr(10) || '内容: ' || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY item_id) AS context
  FROM q JOIN benchmark ON session_id % 10 = item_id % 10 AND item_id < 30 WHERE session_id % 4 > 0 GROUP BY 1),
p AS (SELECT session_id, question, CASE WHEN context IS NOT NULL AND session_id % 3 = 0 THEN 'LAW ' || context || ' END' WHEN context IS NOT NULL THEN 'ANY ' || context WHEN session_id % 3 = 0 THEN 'law alone' ELSE 'any alone' END AS prompt
  FROM q LEFT JOIN ctx USING (session_id)),
b AS (SELECT session_id, 1000 - {store_queries._TOKENS.replace('content', 'prompt')} - {store_queries._TOKENS.replace('content', 'question')} AS budget FROM p),
t AS (SELECT session_id, sum({store_queries._TOKENS}) AS history FROM h GROUP BY 1),
c AS (SELECT session_id, budget, budget >= 0 AND coalesce(history, 0) > budget AS compress FROM b LEFT JOIN t USING (session_id)),
o AS (SELECT h.*, row_number() OVER (PARTITION BY session_id, role = 'user' ORDER BY created_at, id) AS k FROM h JOIN c USING (session_id) WHERE compress AND NOT protected),
s AS (SELECT session_id, min(id) AS id, max(created_at) AS created_at, '[历史对话摘要]' || chr(10) || coalesce(string_agg(substr(content, 1, 40), '；' ORDER BY k) FILTER (role = 'user' AND k <= 5), '') AS content FROM o GROUP BY 1),
l AS (SELECT session_id, id, role, content, created_at, 2 AS k FROM h JOIN c USING (session_id) WHERE protected OR NOT compress UNION ALL SELECT session_id, id, 'assistant', content, created_at, 0 FROM s),
f AS (SELECT session_id, id, role, content, created_at, k FROM (SELECT l.*, budget, sum({store_queries._TOKENS}) OVER (PARTITION BY session_id ORDER BY k DESC, created_at DESC, id DESC) AS upto FROM l JOIN c USING (session_id)) WHERE upto <= budget),
r AS (SELECT * FROM f UNION ALL SELECT session_id, NULL, 'system', prompt, NULL, -1 FROM p UNION ALL SELECT session_id, NULL, 'user', question, NULL, 3 FROM p)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY k, created_at, id) - 1 AS place, role, md5(content) AS content, {store_queries._TOKENS} AS tokens,
  sum({store_queries._TOKENS}) OVER (PARTITION BY session_id)::BIGINT AS total_tokens, compress AS was_compressed FROM r JOIN c USING (session_id)"""


def _scope_sql(name: str, doc_type: str, kind: str, rest: int) -> str:
    own = f"JOIN kd USING (chunk_id) WHERE doc_type = '{doc_type}' AND query_id % 3 <> {rest}"
    return f"""{name}v AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank, round(1 / (1 + distance), 6) AS score FROM dist {own}) WHERE rank <= 4),
{name}b AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, score FROM bm {own}) WHERE rank <= 4),
{_fused(name + 'f', name + 'v', name + 'b')}, {name}k AS (SELECT *, '{kind}' AS kind FROM {name}f WHERE rank <= 4),
{_assembled(name + 'a', name + 'k')}, {_deduped(name + 'd', name + 'a')}"""


_ROUTED_BOTH = f"""WITH {search_queries.BM25}, {search_queries.VECTORS}, kd AS (SELECT doc_id AS chunk_id, CASE WHEN lang = 'en' THEN 'law' ELSE 'case' END AS doc_type FROM documents),
{_scope_sql('la', 'law', '法条', 1)}, {_scope_sql('ca', 'case', '案例', 0)},
two_l AS (SELECT *, 0 AS l FROM lad WHERE query_id % 3 = 2 UNION ALL SELECT *, 1 AS l FROM cad WHERE query_id % 3 = 2),
two_k AS (SELECT b.*, substr(d.text, 1, 120) AS key, max(l) OVER (PARTITION BY query_id) - min(l) OVER (PARTITION BY query_id) + 1 AS n FROM two_l b JOIN documents d ON d.doc_id = b.chunk_id),
two_0 AS (SELECT query_id, key, sum(1.0::DOUBLE / (60 + rank)) AS rrf, arg_min(score, l * 1000 + rank) AS raw, arg_min(chunk_id, l * 1000 + rank) AS chunk_id, min(l * 1000 + rank) AS first, max(n) AS n FROM two_k GROUP BY query_id, key),
two_1 AS (SELECT *, round(CASE WHEN n = 2 THEN rrf ELSE raw END, 6) AS score FROM two_0),
two AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_id) AS rank, chunk_id, score FROM two_1)
SELECT * FROM two WHERE rank <= 4
UNION ALL SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, chunk_id) AS rank, chunk_id, score FROM (SELECT * FROM lad UNION ALL SELECT * FROM cad) WHERE query_id % 3 <> 2"""
_SIX_STAGES = """SELECT 'vector' AS stage, query_id, rank, chunk_id FROM vlist UNION ALL SELECT 'bm25', query_id, rank, chunk_id FROM blist
UNION ALL SELECT 'fusion', query_id, rank, chunk_id FROM ek UNION ALL SELECT 'assembly', query_id, rank, chunk_id FROM ea
UNION ALL SELECT 'rerank', query_id, rank, chunk_id FROM er UNION ALL SELECT 'dedup', query_id, rank, chunk_id FROM ed"""
_WHOLE_EVALUATION = f"""WITH {search_queries.BM25}, {search_queries.VECTORS}, {search_queries._lists(10)},
ek AS (SELECT query_id, chunk_id, rank, score, CASE query_id % 3 WHEN 0 THEN '法条' WHEN 1 THEN '案例' ELSE '其他' END AS kind FROM fused WHERE rank <= 10),
{_assembled('ea', 'ek')},
en AS (SELECT *, ('0x' || substr(md5(query_id || '|' || chunk_id), 1, 6))::BIGINT / 16777216 AS new, count(*) OVER (PARTITION BY query_id) > 10 AS many FROM ea),
eo AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN NOT many THEN rank END, new DESC, chunk_id) AS place FROM en),
er AS (SELECT query_id, chunk_id, score, place AS rank FROM eo WHERE place <= 10),
{_deduped('ed', 'er')}, {search_queries._metrics(_SIX_STAGES)} SELECT * FROM mm"""
_LETTER_BM25 = search_queries.BM25.replace(search_queries.TOKENS.format("text"), "regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')")
ORACLE_SQL = {
    "preprocessed": "SELECT count(*) FILTER (text <> '') AS processed, count(*) FILTER (text IS NULL OR text = '') AS pending FROM documents",
    "routed": f"{_ROUTED} SELECT query_id, scope, chunk_id, rank, score FROM cs",
    "routed_stats": f"{_ROUTED} SELECT query_id, sum(r)::BIGINT AS total_ms, count(*) AS results FROM rt GROUP BY 1",
    "top_confidence": f"{_ROUTED} SELECT item_id AS query_id, coalesce(score, 0) AS confidence, CASE WHEN score IS NULL THEN 'general' ELSE 'rag' END AS question_type FROM benchmark LEFT JOIN cs ON item_id = query_id AND rank = 1",
    "latencies": "SELECT 's' || turn AS stage, round(avg(s), 4) AS avg_latency_ms FROM (SELECT turn, sum(len(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations) GROUP BY 1",
    "corrections": f"""WITH {text_queries._ASKED} SELECT query_id, regexp_matches(query, '啊{{3,}}|0{{3,}}|1{{3,}}') OR regexp_matches(query, '咋|啥|肿么|木有') OR (len(query) > 30 AND NOT regexp_matches(query, '法|诉|判|案|律|权')) AS needed,
        CASE WHEN query_id % 3 = 1 THEN query || '。' ELSE query END AS taken, query AS safe FROM asked""",
    "contexts": f"""WITH {search_queries.BM25} SELECT query_id, md5('检索到的文档内容：' || chr(10) || string_agg('[' || rank || '] 来源: ' || chunk_id || chr(10) || '内容: ' || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context FROM ranked JOIN documents ON doc_id = chunk_id WHERE rank <= 3 GROUP BY 1""",
    "session_details": f"WITH {store_queries._M} SELECT session_id, string_agg(id::VARCHAR, ',' ORDER BY created_at, id) AS ids FROM m GROUP BY 1",
    "variants": _variant("control", text_queries._CLEAN["strip_control"]) + " UNION ALL " + _variant("space", text_queries._CLEAN["collapse_space"]),
    "knn_approximate": search_queries.ORACLE_SQL["knn_exact"],
    "retrieved": _retrieved_sql(),
    "retrieved_reranked": _retrieved_sql(True),
    "contexts_built": _BUILT,
    "routed_both_ways": _ROUTED_BOTH,
    "routed_filtered": _ROUTED_BOTH.replace(" AS doc_type FROM documents)", " AS doc_type FROM documents WHERE doc_id % 10 BETWEEN 2 AND 6 AND source IN ('src1', 'src2', 'src5'))", 1),
    "evaluation_whole": _WHOLE_EVALUATION,
    "numbered_pages": "SELECT conv_id AS doc_id, turn * 2 + 5 AS position, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page_number FROM conversations",
    "appended_messages": f"""WITH {store_queries._M}, g AS (SELECT session_id, count(*) FILTER (session_id % 2 = 0 OR id % 60 < 3) AS messages, nullif(count(*) FILTER (session_id % 2 = 1 AND id % 60 >= 3), 0) AS unknown,
        max(created_at) FILTER (session_id % 2 = 0 AND id % 60 >= 3) AS updated_at FROM m GROUP BY 1) SELECT * FROM g WHERE messages > 0""",
    "samples_kept": """SELECT dataset, position FROM (SELECT dataset, position, row_number() OVER (PARTITION BY dataset ORDER BY position) AS n FROM (
        SELECT 0 AS dataset, doc_id AS position FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 1, doc_id FROM documents WHERE doc_id % 3 = 0)) WHERE n <= 20 AND position % 4 > 0""",
    "truth_coverage": "SELECT source_type, count(*) AS samples, count(*) FILTER (len(text) % 3 > 0) AS evaluated FROM (SELECT *, CASE WHEN item_id % 2 = 0 THEN 'qa' ELSE 'mcq' END AS source_type FROM benchmark) GROUP BY GROUPING SETS ((source_type), ())",
    "stage_counts": search_queries._EVALUATION + " SELECT query_id, " + ", ".join(f"count(*) FILTER (stage = '{x}') AS {x}" for x in ("vector", "bm25", "fusion", "dedup")) + " FROM st GROUP BY query_id",
    "language_sizes": "SELECT lang AS collection, count(*) AS documents FROM documents GROUP BY 1",
    "bm25_letters": f"WITH {_LETTER_BM25} SELECT query_id, chunk_id, rank, score FROM ranked WHERE rank <= 5",
    "prompts": """SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 AND item_id % 3 = 0 THEN 'LAW ' || text || ' END' WHEN item_id % 2 = 0 THEN 'ANY ' || text
        WHEN item_id % 3 = 0 THEN 'law alone' ELSE 'any alone' END AS prompt FROM benchmark""",
    "findings_by_kind": "SELECT doc_id, 'format' AS error_type, rule, rule || ' a' AS description, severity FROM (" + text_queries.ORACLE_SQL["quality_report"] + ") WHERE rule IN ('spaces', 'newlines', 'controls')",
}
