"""Conversations: budgets, protected rounds, summaries, contexts; whole tables of sessions at once.

messages(session_id, id, role, content, created_at[, summary]); sessions are as long as talks
are, so their messages may be ordered in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_engine.functions.text import characters, estimate_tokens, jaccard
from corpus_engine.shared import united

PER_MESSAGE = 4
SUMMARY_MARK = "[历史对话摘要]\n"
NEW_TITLE = "新对话"
ROLES = {"user": "用户: ", "assistant": "助手: "}


def newest_first() -> list[Column]:
    return [F.desc("created_at"), F.desc("id")]


def message_tokens() -> Column:
    return PER_MESSAGE + estimate_tokens(F.col("content"))


def conversation_tokens(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.sum(message_tokens()).alias("tokens"), F.count("*").alias("messages"))


def split_protected(messages: DataFrame, rounds: int = 2) -> DataFrame:
    """`protected`: whether a message is among the last 2 * rounds of its session."""
    return messages.withColumn("protected", F.row_number().over(Window.partitionBy("session_id").orderBy(*newest_first())) <= 2 * rounds)


def truncate_to_budget(messages: DataFrame, budget: int) -> DataFrame:
    """The longest run of newest messages whose tokens fit."""
    upto = Window.partitionBy("session_id").orderBy(*newest_first()).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("_sum", F.sum(message_tokens()).over(upto)).where(F.col("_sum") <= budget).drop("_sum")


def history_budget(messages: DataFrame, window: int = 30_000, reserved: int = 2_000, system: int = 0, tools: int = 0) -> DataFrame:
    """session_id, history (tokens), budget, compress: the newest message is the current one."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(*newest_first()))
    sums = messages.withColumn("_n", place).groupBy("session_id").agg(
        F.sum(F.when(F.col("_n") > 1, message_tokens()).otherwise(0)).alias("history"), F.sum(F.when(F.col("_n") == 1, message_tokens())).alias("_now")
    )
    budget = F.greatest(window - reserved - system - tools - F.col("_now"), F.lit(0))
    return sums.select("session_id", "history", budget.alias("budget"), (F.col("history") > budget).alias("compress"))


def repeat_queries(messages: DataFrame, threshold: float = 0.6) -> DataFrame:
    """User messages whose characters are much like those of an earlier one of the session.

    A session's messages are reduced to their different sets of characters. Sets of a likeness above
    the threshold share one of the first characters, rarest first, of which a set of n has
    n - ceil(threshold * n) + 1; only sets that do are compared. Empty texts are like none.
    """
    asked = messages.where("role = 'user'").select(
        "session_id", "id", "created_at", F.array_sort(F.array_distinct(characters(F.coalesce("content", F.lit(""))))).alias("c")
    ).where(F.size("c") > 0)
    asked = asked.withColumn("set", F.xxhash64("c"))
    sets = asked.groupBy("session_id", "set", "c").agg(F.min(F.struct("created_at", "id")).alias("first"))
    single = sets.select("session_id", "set", "c", F.explode("c").alias("ch"))
    rare = single.groupBy("ch").agg(F.count("*").alias("_n")).withColumnRenamed("ch", "_ch")
    own = Window.partitionBy("session_id", "set", "c").orderBy("_n", "ch")
    n = F.size("c")
    prefix = single.join(rare, F.col("ch") == F.col("_ch")).withColumn("_k", F.row_number().over(own))
    prefix = prefix.where(F.col("_k") <= n - F.ceil(F.lit(threshold) * n) + 1).select("session_id", "ch", "set", "c")
    other = prefix.select(F.col("session_id").alias("_s"), F.col("ch").alias("_ch"), F.col("set").alias("_set"), F.col("c").alias("_c"))
    met = prefix.join(other, (F.col("session_id") == F.col("_s")) & (F.col("ch") == F.col("_ch")) & ((F.col("set") != F.col("_set")) | (F.col("c") != F.col("_c"))))
    pairs = met.select("session_id", "set", "c", "_set", "_c").distinct().withColumn("like", F.round(jaccard(F.col("c"), F.col("_c")), 6))
    pairs = pairs.where(F.col("like") > threshold)
    same = sets.select("session_id", "set", "c", F.lit(1.0).alias("like"), "first")
    firsts = sets.select(F.col("session_id").alias("_s"), F.col("set").alias("_set2"), F.col("c").alias("_c2"), "first")
    near = pairs.join(firsts, (F.col("session_id") == F.col("_s")) & (F.col("_set") == F.col("_set2")) & (F.col("_c") == F.col("_c2")))
    near = united(near.select("session_id", "set", "c", "like", "first"), same)
    near = near.select(F.col("session_id").alias("_s"), F.col("set").alias("_set"), F.col("c").alias("_c"), "like", "first")
    earlier = (F.col("session_id") == F.col("_s")) & (F.col("set") == F.col("_set")) & (F.col("c") == F.col("_c")) & (F.col("first") < F.struct("created_at", "id"))
    return asked.join(near, earlier).groupBy("session_id", "id").agg(F.max("like").alias("likeness"))


def session_summary(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.max("created_at").alias("updated_at"), F.count("*").alias("messages"))


SOURCES = "array<struct<content:string,metadata:map<string,string>,score:double>>"


def session_detail(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """sessions(session_id, title) with their messages in order; `sources` texts are decoded, bad JSON gives null."""
    held = ["created_at", "id", "role", "content"]
    if "sources" in messages.columns:
        decoded = F.from_json("sources", SOURCES)
        messages = messages.withColumn("sources", F.when(F.exists(decoded, lambda s: s.isNotNull()) | (F.size(decoded) == 0), decoded))
        held.append("sources")
    parts = F.collect_list(F.struct(*held))
    ordered = F.array_sort(parts, lambda a, b: F.when((a["created_at"] < b["created_at"]) | ((a["created_at"] == b["created_at"]) & (a["id"] < b["id"])), -1).when(
        (a["created_at"] == b["created_at"]) & (a["id"] == b["id"]), 0).otherwise(1))
    found = messages.groupBy("session_id").agg(ordered.alias("messages"))
    return sessions.join(found, "session_id", "left")


def fallback_summary(messages: DataFrame, first: int = 5, size: int = 40) -> DataFrame:
    """session_id, summary: the first user texts, each cut, joined by ；."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "id"))
    asked = messages.where("role = 'user'").withColumn("_n", place).where(F.col("_n") <= first)
    parts = F.sort_array(F.collect_list(F.struct("_n", F.substring("content", 1, size).alias("t"))))
    return asked.groupBy("session_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "；").alias("summary"))


def transcript(messages: DataFrame, size: int = 2000) -> DataFrame:
    mark = F.lit("")
    for role, text in ROLES.items():
        mark = F.when(F.col("role") == role, text).otherwise(mark)
    parts = F.sort_array(F.collect_list(F.struct("created_at", "id", F.concat(mark, F.substring("content", 1, size)).alias("t"))))
    spoken = messages.where(F.col("role").isin(*ROLES))
    return spoken.groupBy("session_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("transcript"))


def replace_with_summary(messages: DataFrame, old: DataFrame, summaries: DataFrame) -> DataFrame:
    """Without the messages in old(id), and with one summary message a session, at the time of its last old one."""
    gone = messages.join(old.select("id"), "id", "left_semi").groupBy("session_id").agg(F.max("created_at").alias("created_at"), F.min("id").alias("id"))
    new = gone.join(summaries, "session_id").select(
        "session_id", "id", F.lit("assistant").alias("role"), F.concat(F.lit(SUMMARY_MARK), "summary").alias("content"), "created_at", F.lit(True).alias("summary")
    )
    kept = messages.join(old.select("id"), "id", "left_anti").withColumn("summary", F.lit(False))
    return united(kept, new)


def delete_sessions(sessions: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select("session_id")
    return sessions.join(gone, "session_id", "left_anti"), messages.join(gone, "session_id", "left_anti")


def append_messages(sessions: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all messages, new ones of unknown sessions, sessions with the time of their last new message as updated_at).

    `sources` of new messages, an array of structs, are kept as JSON; an empty one as null.
    """
    if "sources" in new.columns:
        new = new.withColumn("sources", F.when(F.size("sources") > 0, F.to_json("sources")))
    known = new.join(sessions.select("session_id"), "session_id", "left_semi")
    last = known.groupBy("session_id").agg(F.max("created_at").alias("_at"))
    held = F.col("updated_at") if "updated_at" in sessions.columns else F.lit(None).cast("timestamp")
    touched = sessions.join(last, "session_id", "left").withColumn("updated_at", F.coalesce("_at", held)).drop("_at")
    unknown = new.join(sessions.select("session_id"), "session_id", "left_anti")
    return united(messages, known), unknown, touched


def create_sessions(new: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """new(session_id, title) appended to sessions; without a title one is called 新对话."""
    made = new.withColumn("title", F.coalesce("title", F.lit(NEW_TITLE)))
    return made if sessions is None else united(sessions, made)


def retitle_sessions(sessions: DataFrame, titles: DataFrame) -> DataFrame:
    """titles(session_id, title) replace titles; of several for a session the greatest counts, null ones do nothing."""
    new = titles.groupBy("session_id").agg(F.max("title").alias("_new"))
    return sessions.join(new, "session_id", "left").withColumn("title", F.coalesce("_new", "title", F.lit(NEW_TITLE))).drop("_new")


CONTEXT_HEAD = "检索到的文档内容：\n"


def context_block(results: DataFrame) -> DataFrame:
    """results(query_id, rank, source, text) -> query_id, context: numbered parts with their sources.

    Null sources are 未知, null texts empty; parts are numbered by rank, then text.
    """
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "text"))
    part = F.concat(
        F.lit("["), F.col("_n").cast("string"), F.lit("] 来源: "), F.coalesce(F.col("source").cast("string"), F.lit("未知")), F.lit("\n内容: "), F.coalesce("text", F.lit(""))
    )
    parts = F.sort_array(F.collect_list(F.struct("_n", part.alias("t"))))
    joined = F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n---\n\n")
    return results.withColumn("_n", place).groupBy("query_id").agg(F.concat(F.lit(CONTEXT_HEAD), joined).alias("context"))


# The instructions before a question, with and without retrieved documents.
RETRIEVED = "{retrieval_block}"


def select_prompt(queries: DataFrame, templates: DataFrame, contexts: DataFrame, default: str) -> DataFrame:
    """queries(query_id, query_type), templates(query_type, with_context, without_context) -> query_id, prompt.

    contexts(query_id, context) fill {retrieval_block}. A query without a context, or with an empty
    one, takes the text for that of its type, or of the default type; unknown types count as the default.
    The templates are a small table that the caller writes; Spark checks its size.
    """
    named = templates.select(F.col("query_type").alias("_type"), "with_context", "without_context")
    usual = F.broadcast(templates.where(F.col("query_type") == default).agg(F.max("with_context").alias("_with"), F.max("without_context").alias("_without")))  # one row
    met = queries.select("query_id", "query_type").join(named, F.col("query_type") == F.col("_type"), "left").join(usual)
    met = met.join(contexts.select("query_id", F.nullif("context", F.lit("")).alias("context")), "query_id", "left")
    filled = F.replace(F.coalesce("with_context", "_with"), F.lit(RETRIEVED), F.col("context"))
    return met.select("query_id", F.coalesce(filled, "without_context", "_without").alias("prompt"))


def last_messages(messages: DataFrame, n: int = 5) -> DataFrame:
    """Per session of more than n + 1 messages: a digest of the older ones, cut by role, and the number kept."""
    own = Window.partitionBy("session_id")
    placed = messages.withColumns({"_n": F.row_number().over(own.orderBy(*newest_first())), "_all": F.count("*").over(own)})
    cut = F.when(F.col("role") == "user", F.substring("content", 1, 100)).otherwise(
        F.when(F.length("content") > 150, F.concat(F.substring("content", 1, 150), F.lit("…"))).otherwise(F.col("content"))
    )
    older = placed.where((F.col("_n") > n) & (F.col("_all") > n + 1) & (F.col("role") != "system"))
    parts = F.sort_array(F.collect_list(F.struct("created_at", "id", cut.alias("t"))))
    return older.groupBy("session_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("digest"), F.lit(n).alias("kept"))
