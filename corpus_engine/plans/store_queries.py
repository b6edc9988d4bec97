"""Registered queries of stores, conversations, streams and data sets, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.operators import context, store
from corpus_engine.plans import search_queries
from corpus_engine.plans.search_queries import evaluation, table
from corpus_engine.shared import new_path
from corpus_engine.sources import files
from corpus_engine.streaming import jobs


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of a collection for each language."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), "text", "source", "n_chars", F.col("lang").alias("collection"), (2015 + F.col("doc_id") % 10).cast("int").alias("year"))


_C = "c AS (SELECT doc_id AS chunk_id, text, source, n_chars, lang AS collection, (2015 + doc_id % 10)::INT AS year FROM documents)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    minutes = F.col("conv_id") * 60 + F.col("turn")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + minutes * 60)
    return talk.select(F.col("conv_id").alias("session_id"), minutes.alias("id"), "role", F.col("text").alias("content"), at.alias("created_at"))


_M = "m AS (SELECT conv_id AS session_id, conv_id * 60 + turn AS id, role, text AS content, TIMESTAMP '2024-01-01' + to_minutes(conv_id * 60 + turn) AS created_at FROM conversations)"
_TOKENS = "(4 + CASE WHEN content = '' THEN 0 ELSE greatest(1, len(content) // 2) END)"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("task_id"), "ts", F.col("event_type").alias("stage"), F.col("value").alias("progress"), "event_id"
    )


def filtered_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: a scalar, a list and a range of years together."""
    keep = store.metadata_predicate({"collection": ["en", "de"], "year_range": {"start": 2017, "end": 2021}, "source": "src5", "note": {}, "none": []})
    return collections(spark, sf_dir).where(keep).select("chunk_id", "collection", "year")


def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a word, case-sensitive."""
    return store.keyword_filter(collections(spark, sf_dir), "License").select("chunk_id", "collection")


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose ids labels name."""
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"))
    return store.get_by_ids(collections(spark, sf_dir), ids).select("chunk_id", "source")


def deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays when labelled documents go."""
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"))
    return store.delete_by_ids(collections(spark, sf_dir), ids)[0].select("chunk_id", "source")


def updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents get a new text."""
    new = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("quality "), "quality").alias("text"))
    return store.update_by_id(collections(spark, sf_dir), new).select("chunk_id", F.md5("text").alias("text"), "re_embed")


def page_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the third page of fifty, with the total."""
    return store.paginate(collections(spark, sf_dir).select("chunk_id", "source"), 100, 50)


def collection_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, G2."""
    return store.collection_counts(collections(spark, sf_dir))


def collection_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection that is there and one that is not."""
    rows = collections(spark, sf_dir)
    return store.collection_info(rows, "en").unionByName(store.collection_info(rows, "zz"))


def new_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each text, none with the text of a passage."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("file_hash"))
    return store.dedup_ingest(docs, known).select("doc_id", "file_hash")


def known_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which doubled ids exist."""
    docs = collections(spark, sf_dir)
    return store.compare_ids(docs.select((F.col("chunk_id") * 2).alias("chunk_id")), docs)


def appended_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections written one by one, one dropped, the rest read back."""
    rows, path, kept = collections(spark, sf_dir), new_path(spark, "store"), new_path(spark, "store")
    for name in ("en", "fr", "de", "es"):
        store.append_to_collection(rows.where(F.col("collection") == name).drop("collection"), path, name)
    return store.drop_collection(spark, path, "fr", kept).select("chunk_id", "collection")


def session_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D18."""
    return context.conversation_tokens(messages(spark, sf_dir))


def session_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8."""
    return context.split_protected(messages(spark, sf_dir)).select("session_id", "id", "protected")


def session_fitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest messages that fit into 400 tokens."""
    return context.truncate_to_budget(messages(spark, sf_dir), 400).select("session_id", "id")


def session_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E10."""
    return context.history_budget(messages(spark, sf_dir), 1000, 200)


def session_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions much like an earlier one."""
    return context.repeat_queries(messages(spark, sf_dir))


def session_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D17, F5."""
    return context.session_summary(messages(spark, sf_dir))


def session_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries by the first questions."""
    return context.fallback_summary(messages(spark, sf_dir))


def session_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H51."""
    return context.transcript(messages(spark, sf_dir)).select("session_id", F.md5("transcript").alias("transcript"))


def sessions_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unprotected messages replaced by a summary."""
    rows = messages(spark, sf_dir)
    old = context.split_protected(rows).where("not protected").select("id")
    return context.replace_with_summary(rows, old, context.fallback_summary(rows)).select("session_id", "id", "role", F.md5("content").alias("content"), "summary")


def sessions_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: messages that stay when every third session goes."""
    rows = messages(spark, sf_dir)
    ids = rows.select("session_id").distinct()
    _, kept = context.delete_sessions(ids, rows, ids.where("session_id % 3 = 0"))
    return kept.select("session_id", "id")


def sessions_titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even sessions get a title, others the default."""
    ids = messages(spark, sf_dir).select("session_id").distinct().withColumn("title", F.lit(None).cast("string"))
    return context.retitle_sessions(ids, ids.where("session_id % 2 = 0").select("session_id", F.concat(F.lit("talk "), F.col("session_id").cast("string")).alias("title")))


def sessions_older(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all but the last two messages."""
    return context.last_messages(messages(spark, sf_dir), 2).select("session_id", F.md5("digest").alias("digest"), "kept")


def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last report of each task."""
    return jobs.latest_task_stage(tasks(spark, sf_dir))


def task_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of each stage by the hour."""
    return jobs.stage_counts(tasks(spark, sf_dir))


def task_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By hours that begin every quarter."""
    return jobs.stage_counts(tasks(spark, sf_dir), "1 hour", "15 minutes")


def task_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of activity of each task, parted by three hours."""
    rows = tasks(spark, sf_dir).select(F.col("task_id").alias("session_id"), F.col("ts").alias("created_at"))
    return jobs.session_activity(rows, "3 hours")


def evaluation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of each stage at each cut."""
    return files.metrics_report(evaluation(spark, sf_dir))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions, answers and references of samples that are made of every document."""
    docs = table(spark, sf_dir, "documents")
    source, number = F.col("source"), F.col("doc_id").cast("string")
    letter = F.substring(F.lit("ABCD"), (F.col("doc_id") % 4 + 1).cast("int"), F.lit(1))
    asked = F.concat(F.lit("Question: "), source, F.lit("是什么\nA. 一\nB. 二"))
    told = F.concat(F.lit("根据《民法典》的第"), number, F.lit("条规定，正确答案是："), letter)
    ref = F.concat(F.lit("民法-2018-10-26:    \"第"), number, F.lit("条 "), source, F.lit("\""))
    return docs.select(
        "doc_id", files.mcq_question(asked).alias("question"), files.mcq_answer(told).alias("answer"), F.array_join(files.law_references(told), "|").alias("refs"),
        files.normalise_reference(ref).alias("reference"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        filtered_metadata, keyword_hits, fetched, deleted, updated, page_of_documents, collection_sizes, collection_state, new_documents, known_ids,
        appended_store, session_tokens, session_protected, session_fitting, session_budgets, session_repeats, session_summaries, session_digests,
        session_transcripts, sessions_compressed, sessions_kept, sessions_titled, sessions_older, task_states, task_windows, task_sliding,
        task_sessions, evaluation_matrix, references,
    )
}
_NEWEST = "row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC)"
_SUMMARY = "SELECT session_id, string_agg(substr(content, 1, 40), '；' ORDER BY n) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS n FROM m WHERE role = 'user') WHERE n <= 5 GROUP BY session_id"
_LETTERS = "list_distinct(list_filter(string_split({0}, ''), lambda c: c <> ''))"
_PROTECTED = f"SELECT session_id, id, role, content, created_at, {_NEWEST} <= 4 AS protected FROM m"
ORACLE_SQL = {
    "filtered_metadata": f"WITH {_C} SELECT chunk_id, collection, year FROM c WHERE collection IN ('en', 'de') AND year BETWEEN 2017 AND 2021 AND source = 'src5'",
    "keyword_hits": f"WITH {_C} SELECT chunk_id, collection FROM c WHERE contains(text, 'License')",
    "fetched": f"WITH {_C} SELECT chunk_id, source FROM c WHERE chunk_id IN (SELECT doc_id FROM labels)",
    "deleted": f"WITH {_C} SELECT chunk_id, source FROM c WHERE chunk_id NOT IN (SELECT doc_id FROM labels)",
    "updated": f"WITH {_C} SELECT chunk_id, md5(coalesce('quality ' || quality, text)) AS text, quality IS NOT NULL AS re_embed FROM c LEFT JOIN labels ON chunk_id = doc_id",
    "page_of_documents": f"WITH {_C} SELECT chunk_id, source, total FROM (SELECT chunk_id, source, count(*) OVER () AS total FROM c) ORDER BY chunk_id LIMIT 50 OFFSET 100",
    "collection_sizes": f"WITH {_C} SELECT collection, count(*) AS documents FROM c GROUP BY 1",
    "collection_state": f"WITH {_C} SELECT 'en' AS collection, count(*) AS documents, count(*) > 0 AS initialised FROM c WHERE collection = 'en' UNION ALL SELECT 'zz', count(*), count(*) > 0 FROM c WHERE collection = 'zz'",
    "new_documents": "SELECT min(doc_id) AS doc_id, sha256(text) AS file_hash FROM documents WHERE text NOT IN (SELECT text FROM benchmark) GROUP BY text",
    "known_ids": "SELECT DISTINCT doc_id * 2 AS chunk_id, doc_id * 2 IN (SELECT doc_id FROM documents) AS found FROM documents",
    "appended_store": f"WITH {_C} SELECT chunk_id, collection FROM c WHERE collection IN ('en', 'de', 'es')",
    "session_tokens": f"WITH {_M} SELECT session_id, sum({_TOKENS})::BIGINT AS tokens, count(*) AS messages FROM m GROUP BY 1",
    "session_protected": f"WITH {_M} SELECT session_id, id, protected FROM ({_PROTECTED})",
    "session_fitting": f"WITH {_M} SELECT session_id, id FROM (SELECT *, sum({_TOKENS}) OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS s FROM m) WHERE s <= 400",
    "session_budgets": f"WITH {_M}, n AS (SELECT *, {_NEWEST} AS n FROM m), s AS (SELECT session_id, sum(CASE WHEN n > 1 THEN {_TOKENS} ELSE 0 END)::BIGINT AS history, sum(CASE WHEN n = 1 THEN {_TOKENS} END)::BIGINT AS now FROM n GROUP BY 1) SELECT session_id, history, greatest(800 - now, 0) AS budget, history > greatest(800 - now, 0) AS compress FROM s",
    "session_repeats": f"""WITH {_M}, u AS (SELECT *, {_LETTERS.format('content')} AS c FROM m WHERE role = 'user') SELECT session_id, id, max(l) AS likeness FROM (SELECT a.session_id, a.id,
        round(len(list_intersect(a.c, b.c)) / len(list_distinct(list_concat(a.c, b.c))), 6) AS l FROM u a JOIN u b ON a.session_id = b.session_id AND (b.created_at, b.id) < (a.created_at, a.id)) WHERE l > 0.6 GROUP BY ALL""",
    "session_summaries": f"WITH {_M} SELECT session_id, max(created_at) AS updated_at, count(*) AS messages FROM m GROUP BY 1",
    "session_digests": f"WITH {_M} {_SUMMARY}",
    "session_transcripts": f"WITH {_M} SELECT session_id, md5(string_agg(CASE role WHEN 'user' THEN '用户: ' ELSE '助手: ' END || substr(content, 1, 2000), chr(10) ORDER BY created_at, id)) AS transcript FROM m WHERE role IN ('user', 'assistant') GROUP BY 1",
    "sessions_compressed": f"""WITH {_M}, p AS ({_PROTECTED}), s AS ({_SUMMARY}) SELECT session_id, id, role, md5(content) AS content, false AS summary FROM p WHERE protected
        UNION ALL SELECT g.session_id, g.id, 'assistant', md5('[历史对话摘要]' || chr(10) || s.summary), true FROM (SELECT session_id, min(id) AS id FROM p WHERE NOT protected GROUP BY 1) g JOIN s USING (session_id)""",
    "sessions_kept": f"WITH {_M} SELECT session_id, id FROM m WHERE session_id % 3 <> 0",
    "sessions_titled": f"WITH {_M} SELECT DISTINCT session_id, CASE WHEN session_id % 2 = 0 THEN 'talk ' || session_id ELSE '新对话' END AS title FROM m",
    "sessions_older": f"""WITH {_M}, n AS (SELECT *, {_NEWEST} AS n, count(*) OVER (PARTITION BY session_id) AS a FROM m) SELECT session_id, 2 AS kept, md5(string_agg(CASE WHEN role = 'user' THEN substr(content, 1, 100)
        WHEN len(content) > 150 THEN substr(content, 1, 150) || '…' ELSE content END, chr(10) ORDER BY created_at, id)) AS digest FROM n WHERE n > 2 AND a > 3 AND role <> 'system' GROUP BY 1""",
    "task_states": "SELECT user_id AS task_id, event_type AS stage, value AS progress, n AS events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r = 1",
    "task_windows": 'SELECT date_trunc(\'hour\', ts)::TIMESTAMP AS start, (date_trunc(\'hour\', ts) + INTERVAL 1 HOUR)::TIMESTAMP AS "end", event_type AS stage, count(*) AS events FROM events GROUP BY ALL',
    "task_sliding": 'SELECT s::TIMESTAMP AS start, (s + INTERVAL 1 HOUR)::TIMESTAMP AS "end", event_type AS stage, count(*) AS events FROM (SELECT event_type, unnest([time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) FOR k IN range(4)]) AS s FROM events) GROUP BY ALL',
    "task_sessions": """SELECT user_id AS session_id, min(ts) AS start, count(*) AS messages FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, run""",
    "references": "SELECT doc_id, source || '是什么' AS question, substr('ABCD', (doc_id % 4 + 1)::INT, 1) AS answer, '民法典第' || doc_id || '条规定' AS refs, '第' || doc_id || '条 ' || source AS reference FROM documents",
    "evaluation_matrix": "SELECT stage, " + ", ".join(f"max(CASE WHEN k = {k} THEN recall END) AS at_{k}" for k in (1, 3, 5, 10)) + f" FROM ({search_queries.ORACLE_SQL['evaluation']}) GROUP BY stage",
}
