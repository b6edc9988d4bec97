"""Streams with keyed state: equal to the batch job, forgotten piece by piece, carried over a restart."""

import time

import pytest
from pyspark.sql import functions as F

from corpus_engine.operators import context
from corpus_engine.streaming import keyed

SCHEMA = "session_id long, id long, role string, content string, created_at timestamp"


@pytest.fixture()
def rocksdb(spark):
    before = spark.conf.get(keyed.PROVIDER)
    spark.conf.set(keyed.PROVIDER, keyed.ROCKSDB)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else a run with a time to live has no end
    yield
    spark.conf.set(keyed.PROVIDER, before)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def run(spark, folder, ttl=None):
    """One run over what is new in folder/in; gives (all rows found so far, rows of state)."""
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    found = keyed.repeated_queries(stream, ttl_ms=ttl)
    query = found.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return sorted(map(tuple, spark.read.schema(found.schema).parquet(f"{folder}/out").collect())), state[-1] if state else None


def add(spark, folder, rows):
    spark.createDataFrame(rows, "session_id long, id long, role string, content string").withColumn("created_at", F.timestamp_seconds(F.col("id"))).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_keyed_repeats_are_those_of_a_table_over_restarts(spark, rocksdb, small, tmp_path):
    rows = spark.read.parquet(f"{small}/conversations.parquet").select(
        F.col("conv_id").alias("session_id"), (F.col("conv_id") * 60 + F.col("turn")).alias("id"), "role", F.col("text").alias("content"), F.timestamp_seconds(F.col("turn")).alias("created_at")
    )
    rows = rows.unionByName(spark.createDataFrame([(1, 9990, "user", None), (1, 9991, "user", "")], "session_id long, id long, role string, content string").withColumn("created_at", F.timestamp_seconds(F.lit(99))))
    for part in ("id % 60 < 2", "id % 60 between 2 and 4", "id % 60 > 4"):  # each run goes on from the state of the last
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found, _ = run(spark, tmp_path)
    want = sorted((r.session_id, r.id, r.likeness) for r in context.repeat_queries(rows).collect())
    assert found == want and want


def test_state_is_forgotten_piece_by_piece(spark, rocksdb, tmp_path):
    add(spark, tmp_path, [(1, 1, "user", "abcdef"), (1, 2, "user", "uvwxyz"), (2, 3, "user", "abcdef"), (2, 4, "assistant", "no")])
    found, held = run(spark, tmp_path, 4000)
    assert found == [] and held == 3
    time.sleep(5)
    add(spark, tmp_path, [(1, 5, "user", "uvwxyz!"), (3, 6, "user", "mno")])
    found, held = run(spark, tmp_path, 4000)
    assert found == [] and held == 2  # what came before is forgotten, though the session goes on


def test_other_state_stores_are_turned_away(spark, tmp_path):
    add(spark, tmp_path, [(1, 1, "user", "a")])
    with pytest.raises(RuntimeError, match="RocksDB"):
        keyed.repeated_queries(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
