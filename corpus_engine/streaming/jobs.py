"""Incremental jobs: the same functions serve batch tables and streams where semantics allow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpus_engine.shared import folders

TERMINAL = ("COMPLETED", "FAILED")


def latest_task_stage(events: DataFrame) -> DataFrame:
    """events(task_id, ts, stage, progress, event_id) -> the last report of each task; ties: the larger event_id."""
    last = F.max_by(F.struct("stage", "progress"), F.struct("ts", "event_id"))
    found = events.groupBy("task_id").agg(last.alias("l"), F.count("*").alias("events"))
    return found.select("task_id", "l.stage", "l.progress", "events")


def stage_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events of each stage in tumbling or sliding windows; as a stream, later ones than `late` are passed over."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    found = timed.groupBy(span.alias("w"), "stage").agg(F.count("*").alias("events"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "stage", "events")


def session_activity(messages: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Messages of each run of activity in a session, parted by gaps."""
    timed = messages.withWatermark("created_at", late) if messages.isStreaming else messages
    found = timed.groupBy("session_id", F.session_window("created_at", gap).alias("w")).agg(F.count("*").alias("messages"))
    return found.select("session_id", F.col("w.start").alias("start"), "messages")


def corpus_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection").agg(F.count("*").alias("documents"))


def repeat_query_stream(messages: DataFrame, threshold: float = 0.6, hold: str = "1 day") -> DataFrame:
    """context.repeat_queries over a stream: session_id, id, likeness of messages like an earlier one of their session.

    messages: a stream of (session_id, id, role, content, created_at). Earlier means that it came before, or in
    the same batch at an earlier time. A session's state is the different sets of characters it has
    seen, and goes when the watermark passes `hold` after its last message.
    """
    import pandas as pd

    asked = messages.where("role = 'user'").select("session_id", "id", "content", "created_at").withWatermark("created_at", hold)
    key = messages.schema["session_id"].dataType.simpleString()
    name = messages.schema["id"].dataType.simpleString()

    def seen(session: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["created_at", "id"])
        known = [frozenset(s) for s in state.get[0]] if state.exists else []
        out = []
        for row in rows.itertuples(index=False):
            own = frozenset(row.content or "")
            like = max((round(len(own & k) / len(own | k), 6) for k in known), default=0.0) if own else 0.0
            if like > threshold:
                out.append((session[0], row.id, like))
            if own and own not in known:
                known.append(own)
        state.update((["".join(sorted(k)) for k in known],))
        state.setTimeoutTimestamp(int(max(rows.created_at.max().timestamp() * 1000, state.getCurrentWatermarkMs())) + 1 + int(pd.Timedelta(hold).total_seconds() * 1000))
        yield pd.DataFrame(out, columns=["session_id", "id", "likeness"])

    return asked.groupBy("session_id").applyInPandasWithState(
        seen, f"session_id {key}, id {name}, likeness double", "sets array<string>", "append", "EventTimeTimeout"
    )


def stream_ingest(
    spark: SparkSession, source: DataFrame, prepare: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, late: str = "1 day"
) -> StreamingQuery:
    """Files as they come: one of each hash within the watermark, prepared, appended, none that the sink holds.

    source: a stream with text and uploaded_at. Each batch is written once: a batch that is done
    again after a failure overwrites its own folder.
    """
    hashed = source.withColumn("file_hash", F.sha2("text", 256)).withWatermark("uploaded_at", late)
    fresh = hashed.dropDuplicatesWithinWatermark(["file_hash"])

    def append(batch: DataFrame, number: int) -> None:
        path = f"{sink}/batch={number}"
        if others := [p for p in folders(spark, sink) if p != f"batch={number}"]:
            held = spark.read.parquet(*[f"{sink}/{p}" for p in others]).select("file_hash")
            batch = batch.join(held, "file_hash", "left_anti")
        prepare(batch).write.mode("overwrite").parquet(path)

    return fresh.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
