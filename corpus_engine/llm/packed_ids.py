"""Operator 10: token ids in fixed-width bit-packed files.

A file holds the ids of a range of documents in ascending doc_id order, each id in the fewest
bits that hold every id of the vocabulary. Its layout, integers little-endian:

    header    8 bytes magic, uint32 version, uint32 bits, uint64 vocabulary, uint32 ids in a block
    ids       the blocks; id k of a block has bits k * bits and on, lowest first
    blocks    n_blocks uint64: the offset of each block in the file
    starts    n_docs + 1 uint64: the first id of each document in the file, and n_ids
    doc_ids   n_docs int64, then n_docs bytes: 1 where the doc_id is null
    footer    uint64 offset of `blocks`, uint64 n_ids, uint64 n_docs, uint64 n_blocks, 8 bytes magic

so a file is written as its ids come, one block held at a time, and any run of ids is read by the
offsets of its blocks and unpacked by numpy at once.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.llm import word_table
from corpus_engine.llm.batches import parts
from corpus_engine.shared import new_path, partitions, ship

VOCABULARY = "byte_bpe_50k.json"
MAGIC, VERSION = b"BITPACK2", 2
HEADER, FOOTER = struct.Struct("<8sIIQI"), struct.Struct("<QQQQ8s")
#: Ids of a block: a multiple of 8, so that blocks end on whole bytes.
BLOCK = 65_536
END = 0
#: Ids that a reader holds at once.
READ = 1 << 20


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, lowest first, filled up to whole bytes."""
    if bits % 8 == 0:
        return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : bits // 8]).tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32) & 1).astype(np.uint8)
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int, first: int = 0) -> np.ndarray:
    """n ids from the first-th on."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n, first * bits // 8).astype("<u4")
    raw = np.frombuffer(data, np.uint8)
    at = np.arange(first, first + n, dtype=np.int64) * bits
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    byte, out = at >> 3, np.zeros(n, np.uint64)
    for k in range((bits + 7) // 8 + 1):
        out |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((out >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


class PackedWriter:
    """Writes a file document by document; holds one block of ids and 17 bytes a document."""

    def __init__(self, sink, vocabulary: int):
        self.sink, self.bits = sink, width(vocabulary)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.at = HEADER.size
        self.offsets, self.starts, self.doc_ids, self.null = array("Q"), array("Q"), array("q"), bytearray()
        sink.write(HEADER.pack(MAGIC, VERSION, self.bits, vocabulary, BLOCK))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.starts.append(self.n_ids)
        self.doc_ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            ids = np.concatenate(self.held)
            whole = len(ids) // BLOCK * BLOCK
            for at in range(0, whole, BLOCK):
                self._block(ids[at : at + BLOCK])
            self.held, self.n_held = [ids[whole:].copy()], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.at += len(data)
        self.sink.write(data)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        self.starts.append(self.n_ids)
        for part in (np.array(self.offsets, "<u8"), np.array(self.starts, "<u8"), np.array(self.doc_ids, "<i8")):
            self.sink.write(part.tobytes())
        self.sink.write(bytes(self.null))
        self.sink.write(FOOTER.pack(self.at, self.n_ids, len(self.doc_ids), len(self.offsets), MAGIC))


class PackedFile:
    """Random access to a file: only its index is held, blocks are read when asked for."""

    def __init__(self, source: pa.NativeFile):
        self.source = source
        magic, version, self.bits, self.vocabulary, self.block = HEADER.unpack(source.read_at(HEADER.size, 0))
        at, self.n_ids, self.n_docs, n_blocks, last = FOOTER.unpack(source.read_at(FOOTER.size, source.size() - FOOTER.size))
        if magic != MAGIC or version != VERSION or last != MAGIC:
            raise ValueError("not a file of packed ids")
        self.end = at
        self.offsets = np.frombuffer(source.read_at(8 * n_blocks, at), "<u8")
        at += 8 * n_blocks
        self.starts = np.frombuffer(source.read_at(8 * (self.n_docs + 1), at), "<u8").astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.doc_ids = np.frombuffer(source.read_at(8 * self.n_docs, at), "<i8")
        self.null = np.frombuffer(source.read_at(self.n_docs, at + 8 * self.n_docs), np.uint8).astype(bool)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first to last, the latter not included."""
        if last <= first:
            return np.empty(0, "<u4")
        low, high = first // self.block, (last - 1) // self.block
        begin = int(self.offsets[low])
        end = min(begin + (high - low + 1) * self.block * self.bits // 8, self.end)
        return unpack(self.source.read_at(end - begin, begin), self.bits, last - first, first - low * self.block)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def checksum(self, k: int) -> int:
        """crc32 of a document's ids as unsigned 32-bit integers; long ones are read by pieces."""
        crc, last = 0, int(self.starts[k + 1])
        for at in range(int(self.starts[k]), last, READ):
            crc = zlib.crc32(self.ids(at, min(at + READ, last)), crc)
        return crc


def located(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark gives it, so that driver and executors mean the same place."""
    jvm, configuration = spark._jvm, spark._jsc.hadoopConfiguration()
    found = jvm.org.apache.hadoop.fs.Path(path)
    uri = found.getFileSystem(configuration).makeQualified(found).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


class Encoder:
    """Encodes texts as the tokenizers library does.

    Where the definition splits texts by its byte-level pattern and no more, each different piece
    of a batch is given to the library's own model once; texts that hold a special token, and all
    texts under other definitions, go to the library whole.
    """

    def __init__(self, definition: str):
        import json

        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        parts = json.loads(definition)
        split = parts["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        self.by_word = plain and parts["normalizer"] is None and parts["post_processor"] is None and parts["truncation"] is None
        self.special = [t["content"] for t in parts["added_tokens"]]
        vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes = 2 if width(vocabulary) <= 16 else 4
        self.packed = [i.to_bytes(self.bytes, "little") for i in range(vocabulary)]
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(_byte_letters()))
        self.words = word_table.WordEncoder(PATTERN, self._piece, f"<u{self.bytes}")

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            spelled = piece.replace(" ", self.letters[32])
        else:
            spelled = piece.encode().decode("latin-1").translate(self.letters)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(spelled)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens added."""
        whole = [not self.by_word or any(s in t for s in self.special) for t in texts]
        ids, begins = self.words.batch([t for t, odd in zip(texts, whole) if not odd])
        cut = iter(zip(begins.tolist(), begins[1:].tolist()))
        return [
            np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.words.dtype) if odd else ids[slice(*next(cut))]
            for t, odd in zip(texts, whole)
        ]


class _Worker:
    """The encoder of this Python process."""

    held: dict[int, Encoder] = {}

    @classmethod
    def get(cls, definition: str) -> Encoder:
        key = zlib.crc32(definition.encode())
        if key not in cls.held:
            cls.held.clear()
            cls.held[key] = Encoder(definition)
        return cls.held[key]


#: The order of documents in files: by doc_id, nulls first, then by the hash of the text; what is equal in both, by its place in the table.
ORDER = ("known", "doc_id", "h", "row")


def keyed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> the columns of ORDER and text; doc_id is cast to a 64-bit integer."""
    text, doc_id = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("long")
    return docs.select(
        doc_id.isNotNull().cast("int").alias("known"), F.coalesce(doc_id, F.lit(0)).alias("doc_id"), F.xxhash64(text).alias("h"),
        F.monotonically_increasing_id().alias("row"), text.alias("text"),
    )


def range_starts(rows: DataFrame) -> list[tuple]:
    """Where ranges of about equal numbers of rows begin in the order of ORDER: a tuple for each range."""
    light = rows.select(*ORDER)
    ranged = light.repartitionByRange(partitions(rows.sparkSession), *ORDER)
    first = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*ORDER)).alias("first"))
    return sorted(tuple(r.first) for r in first.collect())  # a row a range


def encoded(rows: DataFrame, tokenizer_path: str, starts: list[tuple]) -> DataFrame:
    """keyed() rows -> the columns of ORDER, part (its range) and ids binary: ids in whole bytes, END after them.

    Needs no shuffle; texts are worked on in batches of bounded size.
    """
    from tokenizers import Tokenizer

    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((Tokenizer.from_file(tokenizer_path).to_str(), starts))  # fixed size, a tuple a range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definition, starts = shared.value
        encoder = _Worker.get(definition)
        end = END.to_bytes(encoder.bytes, "little")
        for batch in batches:
            for start, texts in parts(batch.column(len(ORDER))):
                ids = [i.tobytes() + end for i in encoder.encode(texts)]
                kept = [batch.column(i).slice(start, len(texts)) for i in range(len(ORDER))]
                part = [max(0, bisect_right(starts, key) - 1) for key in zip(*[k.to_pylist() for k in kept])]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(part, pa.int32()), pa.array(ids, pa.binary())], names=[*ORDER, "part", "ids"])
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, "known int, doc_id bigint, h bigint, row bigint, part int, ids binary")


def write_packed(docs: DataFrame, tokenizer_path: str, path: str) -> DataFrame:
    """Encode docs(doc_id, text), end each with id 0, write files under `path`; one row per file.

    Returns (file_no, file, n_docs, n_ids), files in ascending doc_id order, nulls first, rows of
    one doc_id by the hash of their text. Null text counts as empty: the end id only. Ranges are
    found from ids and hashes; texts are encoded where they lie, and only their ids are shuffled,
    once, to the range of the document, and sorted there. A task writes its file as ids come, under a name of its own,
    and lists it in its result, so a task that runs again after a lost executor leaves a file that
    nothing names.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)
    carried = "<u2" if width(vocabulary) <= 16 else "<u4"
    rows = keyed(docs)
    starts = range_starts(rows)
    if not starts:
        return spark.createDataFrame([], "file_no int, file string, n_docs bigint, n_ids bigint")
    dealt = encoded(rows, tokenizer_path, starts).repartitionById(len(starts), F.col("part"))
    ranged = dealt.sortWithinPartitions(*ORDER).select("known", "doc_id", "ids")
    uri = located(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        number = TaskContext.get().partitionId()
        system, folder = pa.fs.FileSystem.from_uri(uri)
        system.create_dir(folder, recursive=True)
        name = f"ids-{number:05d}-{uuid.uuid4().hex}.bin"
        with system.open_output_stream(f"{folder}/{name}") as out:
            writer = PackedWriter(out, vocabulary)
            for batch in chain([first], batches):
                for known, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    writer.add(doc_id if known else None, np.frombuffer(ids.as_buffer(), carried))
            writer.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int32()), pa.array([name]), pa.array([len(writer.doc_ids)], pa.int64()), pa.array([writer.n_ids], pa.int64())],
            names=["file_no", "file", "n_docs", "n_ids"],
        )

    return ranged.mapInArrow(run, "file_no int, file string, n_docs bigint, n_ids bigint")


def read_packed(spark: SparkSession, files: list[tuple[str, int]], path: str) -> DataFrame:
    """files [(name, ids before it)] -> doc_id, start, n_tokens, ids_crc32, read from the files.

    One row per document; `start` counts the ids of all documents before it. About READ ids are
    held at once, also of longer documents.
    """
    ship(spark)
    listed = spark.createDataFrame(files, "file string, base long").repartition(max(1, len(files)), "file")
    uri = located(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = pa.fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_file(f"{folder}/{name}") as source:
                    packed = PackedFile(source)
                    at = 0
                    while at < packed.n_docs:
                        last = int(np.searchsorted(packed.starts, packed.starts[at] + READ, "right")) - 1
                        last = min(max(last, at + 1), at + 65_536, packed.n_docs)
                        starts = packed.starts[at : last + 1]
                        if last == at + 1:
                            crc = [packed.checksum(at)]
                        else:
                            ids = packed.ids(int(starts[0]), int(starts[-1]))
                            cuts = (starts - starts[0]).tolist()
                            crc = [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:])]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(packed.doc_ids[at:last], pa.int64(), mask=packed.null[at:last]), pa.array(starts[:-1] + base),
                                pa.array(np.diff(starts)), pa.array(crc, pa.int64()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        at = last

    return listed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def packed_documents(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write docs(doc_id, text) as packed files and read them back. No rows: no files and no rows."""
    spark = docs.sparkSession
    path = path or new_path(spark, "packed-ids")
    written = sorted(write_packed(docs, tokenizer_path, path).collect())  # a row a file
    bases = np.concatenate([[0], np.cumsum([f.n_ids for f in written])]).tolist()
    return read_packed(spark, [(f.file, int(base)) for f, base in zip(written, bases)], path)


def op10_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, written as packed files and read back; one row per row.

    Null and empty texts: the end id only. Null doc_ids come first and stay null; repeated rows and
    rows that share a doc_id are kept one by one, by the hash of their text. Texts of any length
    are encoded whole. Other columns are not read. No documents: no rows.
    """
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed_documents(docs, public_tokenizers.path(VOCABULARY))


QUERIES = {"op10_packed_ids": op10_packed_ids}
ORACLE_SQL: dict[str, str] = {}
