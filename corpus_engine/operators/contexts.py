"""Contexts for whole tables of sessions: prompt, history within its budget, question, as the rows of a talk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_engine.operators import context
from corpus_engine.shared import materialize, united


def build_contexts(
    messages: DataFrame, questions: DataFrame, results: DataFrame, templates: DataFrame, default: str, window: int = 30_000, reserved: int = 2_000, rounds: int = 2
) -> DataFrame:
    """The messages to send for each session: session_id, place, role, content, tokens, total_tokens, was_compressed.

    messages(session_id, id, role, content, created_at[, summary]) are the history, questions(session_id,
    question, query_type) what is asked now, one a session; results(session_id, rank, source, text) what was retrieved for it;
    templates as in context.select_prompt. The prompt is at place 0, the question comes last.

    What window, reserved tokens, prompt and question leave is the history's budget; below zero there
    is no history. A history above it is compressed: its last rounds stay, earlier messages but
    summaries become one summary, in front of earlier summaries, and of that list the longest end
    that fits is kept. Null contents count as empty; sessions without a question are left out.
    """
    asked = questions.select("session_id", F.coalesce("question", F.lit("")).alias("question"), "query_type")
    blocks = context.context_block(results.withColumnRenamed("session_id", "query_id"))
    prompts = context.select_prompt(asked.withColumnRenamed("session_id", "query_id"), templates, blocks, default)
    asked = materialize(asked.join(prompts.withColumnRenamed("query_id", "session_id"), "session_id").withColumn("prompt", F.coalesce("prompt", F.lit(""))), "asked")

    if "summary" not in messages.columns:
        messages = messages.withColumn("summary", F.lit(False))
    history = messages.select("session_id", "id", "role", F.coalesce("content", F.lit("")).alias("content"), "created_at", F.coalesce("summary", F.lit(False)).alias("summary"))
    size = lambda column: context.PER_MESSAGE + context.estimate_tokens(F.col(column))
    held = history.groupBy("session_id").agg(F.sum(context.message_tokens()).alias("_history"))
    budget = (F.lit(window - reserved) - size("prompt") - size("question")).cast("long")
    budgets = asked.select("session_id", budget.alias("_budget")).join(held, "session_id", "left").withColumn("_history", F.coalesce("_history", F.lit(0)))
    budgets = materialize(budgets.withColumn("was_compressed", (F.col("_budget") >= 0) & (F.col("_history") > F.col("_budget"))), "budgets")

    marked = context.split_protected(history, rounds).join(budgets, "session_id")
    old = F.col("was_compressed") & ~F.col("protected") & ~F.col("summary")
    kept = marked.where(~old).withColumn("_k", F.when(F.col("was_compressed") & ~F.col("protected"), 1).otherwise(2))
    gone = marked.where(old).select("session_id", "id", "role", "content", "created_at", "_budget")
    first = gone.groupBy("session_id").agg(F.min("id").alias("id"), F.max("created_at").alias("created_at"), F.first("_budget").alias("_budget"))
    made = first.join(context.fallback_summary(gone), "session_id", "left").select(
        "session_id", "id", F.lit("assistant").alias("role"), F.concat(F.lit(context.SUMMARY_MARK), F.coalesce("summary", F.lit(""))).alias("content"), "created_at", "_budget", F.lit(0).alias("_k")
    )
    talk = united(kept.select(*made.columns), made)
    newest = Window.partitionBy("session_id").orderBy(F.desc("_k"), *context.newest_first())
    fitting = talk.withColumn("_sum", F.sum(context.message_tokens()).over(newest.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") <= F.col("_budget"))

    none = F.lit(None)
    ends = lambda column, role, k: asked.select("session_id", none.cast(history.schema["id"].dataType).alias("id"), F.lit(role).alias("role"), F.col(column).alias("content"), none.cast("timestamp").alias("created_at"), F.lit(k).alias("_k"))
    rows = united(ends("prompt", "system", -1), fitting.select("session_id", "id", "role", "content", F.col("created_at").cast("timestamp").alias("created_at"), "_k"), ends("question", "user", 3))
    own = Window.partitionBy("session_id")
    placed = rows.withColumns({"place": F.row_number().over(own.orderBy("_k", "created_at", "id")) - 1, "tokens": context.message_tokens()})
    placed = placed.withColumn("total_tokens", F.sum("tokens").over(own)).join(budgets.select("session_id", "was_compressed"), "session_id")
    return placed.select("session_id", "place", "role", "content", "tokens", "total_tokens", "was_compressed")
