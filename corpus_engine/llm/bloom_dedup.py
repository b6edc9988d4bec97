"""Operator 11: exact duplicates by two passes over Bloom filters.

Pass one sends only the 64-bit hash of each text, once a batch, to the bit array of its segment.
A hash that finds all of its bits set was there before, or looks as if it had been: it is a suspect.
The suspects, a few of all hashes, make a second filter, small enough to be broadcast. Pass two
tests every row where it lies: rows that are no suspects are alone with their text and pass
straight through; only the others shuffle, and are grouped by the whole digest of their text. So a
false alarm costs the shuffle of a row, never a wrong group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.shared import materialize, partitions, united

#: White space that does not tell texts apart.
SPACE = r"[\x20\x09-\x0D]+"
#: Bits a hash in the first filter, probes of a hash, hashes that a segment is made for.
BITS, PROBES, SEGMENT = 16, 5, 1 << 20
#: The broadcast filter: bits of a slot, suspects that a slot is made for, and most slots (2**17 of
#: 4096 bits are 64 MB). Beyond 2**17 * 256 suspects more rows are false alarms and shuffle too.
SLOT_BITS, SLOT_KEYS, SLOTS = 4096, 256, 1 << 17
SLOT_PROBES = 5
#: A group with over a thousandth of the suspected rows is joined by broadcast: there are not a thousand of them.
HOT = 1000


def digest(text: Column) -> Column:
    """SHA-256, in hex, of a text without its white space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, ""), 256)


def suspects(hashes: DataFrame, rows: int) -> DataFrame:
    """hashes(h long), `rows` of them -> h: each hash that is there twice or more, and a few others, once.

    The filter has BITS bits a hash, dealt into segments, each the work of one task. A task that
    sends hashes sends one at most twice a batch, so no hash is frequent where segments are made.
    A false alarm comes up for about one hash in a few hundred.
    """
    spark = hashes.sparkSession
    segments = max(partitions(spark), -(-rows // SEGMENT))
    size = 1 << max(10, int(BITS * rows / segments * 1.1)).bit_length()

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            found = np.concatenate((found, found[counts > 1]))
            yield pa.RecordBatch.from_arrays([pa.array(found)], names=["h"])

    def probes(h: np.ndarray) -> list[np.ndarray]:
        mixed = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        first, step = mixed >> np.uint64(32), mixed & np.uint64(0xFFFFFFFF) | np.uint64(1)
        return [(first + np.uint64(i) * step) & np.uint64(size - 1) for i in range(PROBES)]

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}  # a segment each; a task has about one
        for batch in batches:
            h, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            out = []
            for segment in np.unique(own).tolist():
                array = bits.setdefault(segment, np.zeros(size, np.bool_))
                found, counts = np.unique(h[own == segment], return_counts=True)
                at = probes(found)
                known = np.logical_and.reduce([array[p] for p in at]) | (counts > 1)
                for p in at:
                    array[p] = True
                out.append(found[known])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) if out else np.empty(0, np.int64))], names=["h"])

    light = hashes.select("h").mapInArrow(sent, "h long")
    dealt = light.select("h", F.pmod("h", F.lit(segments)).cast("int").alias("segment")).repartition(segments, "segment")
    return dealt.mapInArrow(tested, "h long").distinct()


def _probe(h: Column, i: int) -> Column:
    """The place of a hash's i-th bit in its slot."""
    return F.pmod(F.xxhash64(h, F.lit(i)), F.lit(SLOT_BITS)).cast("int")


def slot_filter(found: DataFrame) -> tuple[DataFrame, int]:
    """found(h), distinct -> (slot, words array<long>), and the number of slots: at most SLOTS rows of SLOT_BITS bits."""
    slots = min(SLOTS, max(1, -(-found.count() // SLOT_KEYS)))
    places = found.select(
        F.pmod(F.xxhash64("h"), F.lit(slots)).cast("int").alias("slot"), F.explode(F.array(*[_probe(F.col("h"), i) for i in range(SLOT_PROBES)])).alias("p")
    )
    words = places.groupBy("slot", F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, p & 63))").alias("bits"))
    held = words.groupBy("slot").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))  # 64 words at most
    filled = F.transform(F.sequence(F.lit(0), F.lit(SLOT_BITS // 64 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    return held.select("slot", filled.alias("words")), slots


def suspected(rows: DataFrame, found: DataFrame, h: str = "h") -> DataFrame:
    """rows with `maybe`: whether the second filter, made of found(h), holds the row's hash. Rows stay where they are."""
    words, slots = slot_filter(found)
    own = rows.withColumn("_slot", F.pmod(F.xxhash64(h), F.lit(slots)).cast("int"))
    met = own.join(F.broadcast(words.withColumnRenamed("slot", "_of")), F.col("_slot") == F.col("_of"), "left")  # SLOTS rows at most
    held = F.lit(True)
    for i in range(SLOT_PROBES):
        p = _probe(F.col(h), i)
        held &= F.getbit(F.get("words", F.shiftright(p, 6)), p.bitwiseAND(63)) == 1
    return met.withColumn("maybe", F.coalesce(held, F.lit(False))).drop("words", "_slot", "_of")


def _best() -> Column:
    """What decides which of equal texts stays: the least of these."""
    return F.struct((-F.col("n")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("c"), F.col("row").alias("d"))


def grouped(maybe: DataFrame) -> DataFrame:
    """maybe(sha, n, id, row) -> the same with keep_id, keep_row, group_size; any number of rows may be equal.

    Groups are summed before they shuffle. The largest come to their rows by broadcast; no other
    group holds over a thousandth of the rows.
    """
    groups = materialize(maybe.groupBy("sha").agg(F.min(_best()).alias("best"), F.count("*").alias("group_size")), "text-groups")
    groups = groups.select(F.col("sha").alias("_sha"), F.col("best.c").alias("keep_id"), F.col("best.d").alias("keep_row"), "group_size")
    least = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = F.col("group_size") * HOT > least
    met = maybe.join(F.broadcast(groups.where(hot)), F.col("sha") == F.col("_sha"), "left")  # HOT rows at most
    placed = met.where(F.col("_sha").isNotNull()).drop("_sha")
    others = met.where(F.col("_sha").isNull()).select(*maybe.columns).join(groups.where(~hot), F.col("sha") == F.col("_sha")).drop("_sha")
    return united(placed, others)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs -> doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs.

    Equal texts are those that are equal without white space. Of a group the row with the most code
    points stays, then the smallest doc_id (null last), then any one. Texts are read once; what
    is written and shuffled are ids, lengths and digests.
    """
    light = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.length(text), F.lit(0)).alias("n"), digest(F.col(text)).alias("sha"))
    light = materialize(light.withColumns({"h": F.xxhash64("sha"), "row": F.monotonically_increasing_id()}), "text-digests")
    found = materialize(suspects(light, light.count()), "suspects")
    tested = materialize(suspected(light, found), "tested")
    alone = tested.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    met = grouped(tested.where("maybe").select("sha", "n", "id", "row"))
    met = met.select("id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "sha")
    return united(alone, met).select(F.col("id").alias(doc_id), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: see exact_duplicates.

    Rows whose text is there once never leave their task; the others are written once, then go by row number.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {name: f"c{docs.columns.index(name)}" for name in (doc_id, text)}
    numbered = docs.toDF(*names)
    keyed = numbered.withColumn("sha", digest(F.col(at[text]))).withColumn("h", F.xxhash64("sha"))
    hashes = materialize(keyed.select("h"), "text-hashes")
    found = materialize(suspects(hashes, hashes.count()), "suspects")
    tested = suspected(keyed, found)
    maybe = materialize(tested.where("maybe").withColumn("row", F.monotonically_increasing_id()), "suspected-documents")
    light = maybe.select("sha", F.coalesce(F.length(at[text]), F.lit(0)).alias("n"), F.col(at[doc_id]).alias("id"), "row")
    best = light.groupBy("sha").agg(F.min(_best()).alias("best")).select(F.col("best.d").alias("_kept"))
    kept = maybe.join(best, F.col("row") == F.col("_kept"), "left_semi")
    out = united(tested.where(~F.col("maybe")).select(*names), kept.select(*names))
    return out.toDF(*docs.columns)


def op11_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents. Null, empty and blank texts are one group of empty texts. Rows of null
    doc_id are rows like others, last among equals; if all of a group are such, keep_id is null. Of
    rows equal in length and doc_id exactly one is kept. Texts of any length are read whole; other
    columns are not read. No documents: no rows."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_bloom_dedup": op11_bloom_dedup}
ORACLE_SQL: dict[str, str] = {
    "op11_bloom_dedup": r"""
WITH t AS (
    SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id, first_value(doc_id) OVER own AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER own = 1 AS kept, text_sha256
FROM t WINDOW own AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""
}
