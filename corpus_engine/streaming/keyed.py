"""Keyed state with a time to live: what a stream keeps of each key goes by itself, piece by piece."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpus_engine.shared import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RepeatedQueries(StatefulProcessor):
    """A session's state is a map of the different sets of characters that it has seen, each with a life of its own."""

    def __init__(self, threshold: float, ttl_ms: int | None):
        self.threshold, self.ttl_ms = threshold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sets = handle.getMapState("sets", "letters string", "seen long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["created_at", "id"])
        known = {letters: frozenset(letters) for (letters,) in self.sets.keys()}
        touched: dict[str, int] = {}
        out = []
        for row in asked.itertuples(index=False):
            own = frozenset(row.content or "")
            if not own:
                continue
            like = max((round(len(own & k) / len(own | k), 6) for k in known.values()), default=0.0)
            if like > self.threshold:
                out.append((key[0], row.id, like))
            letters = "".join(sorted(own))
            known[letters] = own
            touched[letters] = touched.get(letters, 0) + 1
        for letters, times in touched.items():  # an update begins the life of a set anew
            before = self.sets.getValue((letters,))
            self.sets.updateValue((letters,), ((before[0] if before else 0) + times,))
        yield pd.DataFrame(out, columns=["session_id", "id", "likeness"])

    def close(self) -> None:
        pass


def repeated_queries(messages: DataFrame, threshold: float = 0.6, ttl_ms: int | None = None) -> DataFrame:
    """context.repeat_queries over a stream: session_id, id, likeness of messages like an earlier one of their session.

    messages: a stream of (session_id, id, role, content, created_at). Earlier means that it came before, or in
    the same batch at an earlier time. A set of characters that does not come again is forgotten
    after ttl_ms of processing time, whatever else its session says; None: never. The session must
    use the RocksDB state store. With ttl_ms Spark goes on with empty batches to forget in, so a run by
    availableNow ends only with spark.sql.streaming.noDataMicroBatches.enabled off.
    """
    spark = messages.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        raise RuntimeError(f"set {PROVIDER} to {ROCKSDB}")
    ship(spark)
    asked = messages.where("role = 'user'").select("session_id", "id", "content", F.col("created_at").cast("timestamp").alias("created_at"))
    key, name = (messages.schema[c].dataType.simpleString() for c in ("session_id", "id"))
    return asked.groupBy("session_id").transformWithStateInPandas(
        RepeatedQueries(threshold, ttl_ms), f"session_id {key}, id {name}, likeness double", "Append", "None" if ttl_ms is None else "ProcessingTime"
    )
