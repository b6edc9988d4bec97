"""Operator 2: document fingerprints as quartile bucket digests.

The byte triplets of a text are hashed into buckets and counted. The digest holds, for each
bucket, the quartile of its count among all buckets (two bits), after the length on a
logarithmic scale. Two digests compare by a difference score between 0 and 1.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.shared import materialize, partitions, ship

BUCKETS = 256
#: Steps of the length scale per doubling; weight of a length step, and most steps that count.
LENGTH_STEPS, LENGTH_WEIGHT, LENGTH_MOST = 8, 6.0, 24
SEED = 20_240_601

_TABLES: list[np.ndarray] = []


def _tables() -> np.ndarray:
    """Three tables of random bytes: the hash of a triplet is the exclusive-or of its bytes' entries."""
    if not _TABLES:
        state, values = SEED, []
        for _ in range(3 * 256):
            state = (state * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
            values.append(state >> 56)
        _TABLES.append(np.array(values, np.uint8).reshape(3, 256))
    return _TABLES[0]


def codes(data: bytes) -> np.ndarray:
    """Length step, then the quartile 0 to 3 of each bucket. No bytes: all zero. Texts of one or
    two bytes are filled up with zero bytes to one triplet."""
    found = np.zeros(BUCKETS + 1, np.uint8)
    if not data:
        return found
    found[0] = min(255, 1 + round(LENGTH_STEPS * math.log2(len(data))))
    b = np.frombuffer(data.ljust(3, b"\0"), np.uint8)
    first, second, third = _tables()
    counts = np.bincount(first[b[:-2]] ^ second[b[1:-1]] ^ third[b[2:]], minlength=BUCKETS)
    ranked = np.sort(counts)
    for quarter in (1, 2, 3):
        found[1:] += counts > ranked[quarter * BUCKETS // 4 - 1]
    return found


def digest(found: np.ndarray) -> str:
    """Hexadecimal: one byte of length, then four buckets a byte."""
    body = found[1:].reshape(-1, 4)
    packed = body[:, 0] | body[:, 1] << 2 | body[:, 2] << 4 | body[:, 3] << 6
    return bytes([int(found[0])]).hex() + packed.astype(np.uint8).tobytes().hex()


def undigest(fingerprint: str) -> np.ndarray:
    data = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    body = np.stack([data[1:] >> shift & 3 for shift in (0, 2, 4, 6)], axis=1).ravel()
    return np.append(data[:1], body)


def difference(a: np.ndarray, b: np.ndarray) -> float:
    """0 for equal digests to 1: what the quartiles and lengths do not share, of what they hold."""
    x, y = a[1:].astype(np.int64), b[1:].astype(np.int64)
    apart = np.abs(x - y)
    steps = LENGTH_WEIGHT * min(abs(int(a[0]) - int(b[0])), LENGTH_MOST)
    held = float(np.maximum(x, y).sum()) + steps
    return (float(apart.sum()) + steps) / held if held else 0.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1.0 - difference(a, b)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many, or all, of the first of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


MADE = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _made(pairs: list[tuple[str, np.ndarray, str, np.ndarray]]) -> list[pa.Array]:
    rows = []
    for text, own, following, other in pairs:
        new = edited(text, following).encode()
        changed = codes(new)
        rows.append(
            (len(text), hashlib.sha256(new).hexdigest(), digest(own), digest(changed), likeness(own, changed), likeness(own, other))
        )
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return [pa.array(values, kind) for values, kind in zip(zip(*rows) if rows else [()] * 6, kinds)]


_NAMES = [part.split()[0] for part in MADE.split(", ")]


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id and the columns of MADE; the next text is that of the next lower doc_id.

    The order: doc_id descending, nulls last, rows of one doc_id by the hash of their text; after
    the last row comes the first, and a single row follows itself. Null text counts as empty. One
    row per row. The texts are dealt out by ranges once; of each range only its first and last
    text are kept for the seams, so seams need two texts a range.
    """
    spark = docs.sparkSession
    ship(spark)
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last = kind = None

        def batch_of(ids: list, pairs: list, edge: int | None, texts: list) -> pa.RecordBatch:
            n = len(ids)
            made = _made(pairs) if pairs else [pa.nulls(n, k) for k in (pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2)]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), *made, pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.int32()), pa.array(texts, pa.string())],
                names=["doc_id", *_NAMES, "part", "edge", "text"],
            )

        for batch in batches:
            ids, pairs, kind = [], [], batch.schema.field(0).type
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                own = codes(text.encode())
                if last is None:
                    yield batch_of([doc_id], [], 0, [text])
                else:
                    ids.append(last[0])
                    pairs.append((last[1], last[2], text, own))
                last = (doc_id, text, own)
                if len(ids) >= 512:
                    yield batch_of(ids, pairs, None, [None] * len(ids))
                    ids, pairs = [], []
            if ids:
                yield batch_of(ids, pairs, None, [None] * len(ids))
        if last is not None:
            yield batch_of([last[0]], [], 1, [last[1]])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, {MADE}, part int, edge int, text string"
    table = materialize(ranged.mapInArrow(run, schema), "digest-rows")
    inner = table.where(F.col("edge").isNull()).select("doc_id", *_NAMES)
    heads = table.where("edge = 0").select(F.col("part").alias("head"), F.col("text").alias("following"))
    tails = table.where("edge = 1").select("doc_id", "text", "part")
    ranges = sorted(r.part for r in tails.select("part").collect())  # one number a range
    after = spark.createDataFrame(list(zip(ranges, ranges[1:] + ranges[:1])), "_part int, _head int")
    seams = tails.join(after, F.col("part") == F.col("_part")).join(heads, F.col("_head") == F.col("head"))

    def seam(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, following = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                made = _made([(text, codes(text.encode()), following, codes(following.encode()))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *made], names=["doc_id", *_NAMES])

    return inner.unionByName(seams.select("doc_id", "text", "following").mapInArrow(seam, f"doc_id {id_type}, {MADE}"))


def op2_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text; one row per row.

    Null texts count as empty; an empty text has the all-zero fingerprint. Null doc_ids come last in
    the order, rows of one doc_id by the hash of their text, a single row follows itself. Texts of any
    length are read whole. Other columns are not read. No documents: no rows.
    """
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op2_quartile_digest": op2_quartile_digest}
ORACLE_SQL: dict[str, str] = {}
