"""Operator 5: sharding by fixed virtual slots.

Records hash into a fixed number of slots. Bytes are summed per slot, and a small versioned
table maps slots to shards: version 1 deals slots out in turn, each rebalancing appends a
version that moves as few slots as it needs. Records never move between slots.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.shared import materialize, new_path, range_buckets, running_total

SLOTS = 4096
SHARDS = 16

MAP_SCHEMA = "version int, virtual_slot int, shard int"


def virtual_slot(record: Column, slots: int = SLOTS) -> Column:
    return F.pmod(record, F.lit(slots)).cast("int")


def first_map(slots: int, shards: int) -> dict[int, int]:
    return {slot: slot % shards for slot in range(slots)}


def rebalanced(current: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """An edited copy of `current`: single slots move from the fullest to the emptiest shard.

    Each move takes the slot whose size comes nearest to half the gap, smallest slot number first
    among equals, and must lessen the larger of the two sums. It ends when no move does. Also
    serves for shards without slots (growth) and for slots on shards that no longer exist.
    """
    edited = dict(current)
    for slot, shard in edited.items():
        if shard >= shards:
            edited[slot] = slot % shards
    members: dict[int, set[int]] = defaultdict(set)
    load = dict.fromkeys(range(shards), 0)
    for slot, shard in edited.items():
        members[shard].add(slot)
        load[shard] += sizes.get(slot, 0)
    while True:
        full = max(load, key=lambda s: (load[s], -s))
        empty = min(load, key=lambda s: (load[s], s))
        gap = load[full] - load[empty]
        movable = [s for s in members[full] if 0 < sizes.get(s, 0) < gap]
        if not movable:
            return edited
        slot = min(movable, key=lambda s: (abs(gap - 2 * sizes[s]), s))
        members[full].remove(slot)
        members[empty].add(slot)
        edited[slot] = empty
        load[full] -= sizes[slot]
        load[empty] += sizes[slot]


class SlotMap:
    """A versioned slot-to-shard map: a Parquet table with one row per version and slot."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, version: int, mapping: dict[int, int]) -> None:
        rows = [(version, slot, shard) for slot, shard in sorted(mapping.items())]
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def read(self, version: int | None = None) -> DataFrame:
        """The map of one version, the latest by default: one row per slot, so its size is fixed."""
        versions = self.spark.read.schema(MAP_SCHEMA).parquet(self.path)
        if version is None:
            version = versions.agg(F.max("version")).first()[0]
        return versions.where(F.col("version") == version)

    def mapping(self, version: int | None = None) -> dict[int, int]:
        return {r.virtual_slot: r.shard for r in self.read(version).collect()}


def slot_bytes(records: DataFrame) -> DataFrame:
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))


def shard_records(records: DataFrame, slots: int = SLOTS, shards: int = SHARDS, path: str | None = None) -> DataFrame:
    """records(record long, size long, ...) -> the same with virtual_slot, shard, slot, map_version.

    `slot` numbers the records of a shard from 0 without gaps: slots in order, within a slot by
    record and size, then as they lie in the table. The order is dealt out by ranges, so a slot
    with very many records is the work of several tasks. Records with equal hashes share a slot and
    follow each other. Any other columns are kept. No records: no rows. One record (or many with one hash) larger than a
    shard's share stays whole, in one shard.
    """
    spark = records.sparkSession
    numbered = records.withColumns({"virtual_slot": virtual_slot(F.col("record"), slots), "_row": F.monotonically_increasing_id()})
    records = materialize(numbered, "slot-records")
    sums = {r.virtual_slot: (r.bytes, r.records) for r in slot_bytes(records).collect()}  # one row per slot at most
    sizes = {slot: size for slot, (size, _) in sums.items()}
    slot_map = SlotMap(spark, path or new_path(spark, "slot-map"))
    slot_map.append(1, first_map(slots, shards))
    slot_map.append(2, rebalanced(slot_map.mapping(1), sizes, shards))
    current = slot_map.mapping()
    mapped = slot_map.read().select(F.col("virtual_slot").alias("_mapped"), "shard", F.col("version").alias("map_version"))
    placed = records.join(F.broadcast(mapped), F.col("virtual_slot") == F.col("_mapped")).drop("_mapped")  # a row per slot: fixed size
    order = [F.col(c) for c in ("virtual_slot", "record", "size", "_row")]
    dealt = range_buckets(placed, [F.col("shard"), *order], "slot-order")
    return running_total(dealt, ["shard"], order, F.lit(1).cast("long"), "slot").drop("_bucket", "_row")


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `bytes`. Null text: size 1, crc32 of no bytes. Rows equal in doc_id and text are one
    record repeated and share a slot; equal texts under other ids are spread, and so are rows of null
    doc_id. A text of any length is one record and stays whole. Other columns are not read. No
    documents: no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    records = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64("doc_id", "text", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())).alias("record"),
    )
    return shard_records(records).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )


QUERIES = {"op5_virtual_slots": op5_virtual_slots}
ORACLE_SQL: dict[str, str] = {}
