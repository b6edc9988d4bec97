"""A BM25 index that is kept by deltas: segments of postings that are never changed.

Each append writes one segment: its postings, and how many of its chunks hold each term. A delete
writes tombstones, and the same statistics of the chunks that went as negative numbers. So document
frequencies, the number of chunks and their mean length are sums over segments, and an index is
never rebuilt. Tombstones hold for segments before them, so an id may come back. `merge` makes one
segment of the small ones, and leaves out what is dead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.functions.text import tokenize
from corpus_engine.operators import search
from corpus_engine.shared import deal, materialize
from corpus_engine.sources.manifest import Manifest

#: kind: postings or tombstones; seq: order in which they came; n, tokens: what they add to the totals (negative for
#: tombstones); rows: rows of the folder.
ENTRY = "kind string, folder string, seq long, n long, tokens long, rows long"
#: Segments of fewer postings than this are merged.
SMALL = 5_000_000


class PostingSegments:
    """The index at `path` of chunks(chunk_id, text). The tokenizer must be the same in all calls."""

    def __init__(self, spark: SparkSession, path: str, tokenizer: Callable[[Column], Column] = tokenize, id_type: str = "long"):
        self.spark, self.tokenizer = spark, tokenizer
        self.manifest = Manifest(spark, path, ENTRY)
        self.postings_schema = f"chunk_id {id_type}, dl int, term string, tf long"
        self.chunk_schema = f"chunk_id {id_type}, dl int"

    def _entries(self, kind: str, version: int | None = None) -> list:
        return sorted((r for r in self.manifest.entries(version) if r.kind == kind), key=lambda r: r.seq)

    def _folder(self, name: str, part: str) -> str:
        return f"{self.manifest.path}/{name}/{part}"

    def _alive(self, rows: list, stones: list, part: str, schema: str) -> DataFrame:
        """What the segments hold of `part`, without what later tombstones name."""
        out = None
        for row in rows:
            found = self.manifest.read([f"{row.folder}/{part}"], schema).withColumn("_seq", F.lit(row.seq))
            out = found if out is None else out.unionByName(found)
        if out is None:
            return self.spark.createDataFrame([], schema)
        dead = None
        for stone in stones:
            found = self.manifest.read([f"{stone.folder}/chunks"], self.chunk_schema).select(F.col("chunk_id").alias("_dead"), F.lit(stone.seq).alias("_until"))
            dead = found if dead is None else dead.unionByName(found)
        if dead is not None:
            dead = dead.groupBy("_dead").agg(F.max("_until").alias("_until"))
            out = out.join(dead, (F.col("chunk_id") == F.col("_dead")) & (F.col("_seq") < F.col("_until")), "left_anti")
        return out.drop("_seq")

    def _write_segment(self, postings: DataFrame, chunks: DataFrame, seq: int) -> tuple:
        """Write postings and chunks(chunk_id, dl), the statistics from what was written; gives the entry."""
        name = self.manifest.new_folder("segment")
        postings.write.parquet(self._folder(name, "postings"))
        written = self.manifest.read([f"{name}/postings"], self.postings_schema)
        written.groupBy("term").agg(F.count("*").alias("df")).write.parquet(self._folder(name, "terms"))
        chunks.write.parquet(self._folder(name, "chunks"))
        total = self.manifest.read([f"{name}/chunks"], self.chunk_schema).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
        return ("postings", name, seq, total.n, total.tokens, written.count())

    def _next(self, rows: list) -> int:
        return max((r.seq for r in rows), default=0) + 1

    def append(self, chunks: DataFrame) -> int:
        """Add chunks(chunk_id, text) as one segment; gives the version. Ids that are there must have been deleted before."""
        base = self.manifest.latest()
        rows = self.manifest.entries(base)
        tokens = materialize(chunks.select("chunk_id", self.tokenizer(F.col("text")).alias("tokens")).select("chunk_id", "tokens", F.size("tokens").alias("dl")), "tokens")
        total = tokens.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first().tokens
        dealt = deal(tokens, total, search.TASK_TOKENS, "chunk_id")
        postings = dealt.select("chunk_id", "dl", F.explode("tokens").alias("term")).groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
        entry = self._write_segment(postings, tokens.select("chunk_id", "dl"), self._next(rows))
        return self.manifest.commit([*rows, entry], base)

    def delete(self, ids: DataFrame) -> int:
        """Take ids(chunk_id) out; gives the version. Ids that are not there do nothing."""
        base = self.manifest.latest()
        rows = self.manifest.entries(base)
        segments, stones = self._entries("postings", base), self._entries("tombstones", base)
        gone = ids.select("chunk_id").where(F.col("chunk_id").isNotNull()).distinct()
        name = self.manifest.new_folder("tombstones")
        self._alive(segments, stones, "chunks", self.chunk_schema).join(gone, "chunk_id", "left_semi").write.parquet(self._folder(name, "chunks"))
        dead = self.manifest.read([f"{name}/chunks"], self.chunk_schema)
        lost = self._alive(segments, stones, "postings", self.postings_schema).join(dead.select("chunk_id"), "chunk_id", "left_semi")
        lost.groupBy("term").agg((-F.count("*")).alias("df")).write.parquet(self._folder(name, "terms"))
        total = dead.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
        if not total.n:
            return base
        return self.manifest.commit([*rows, ("tombstones", name, self._next(rows), -total.n, -total.tokens, total.n)], base)

    def merge(self, small: int = SMALL) -> int:
        """Make one segment of those with fewer postings than `small`; gives the version.

        Tombstones that no older segment is left for go too; the others keep their place, with the
        statistics that are still theirs. Fewer than two small segments: nothing changes.
        """
        base = self.manifest.latest()
        segments, stones = self._entries("postings", base), self._entries("tombstones", base)
        merged = [r for r in segments if r.rows < small]
        if len(merged) < 2:
            return base
        left = [r for r in segments if r.rows >= small]
        alive = lambda part, schema: self._alive(merged, stones, part, schema)
        last = max(r.seq for r in (*segments, *stones))
        entry = self._write_segment(alive("postings", self.postings_schema), alive("chunks", self.chunk_schema), last + 1)
        kept = []
        for stone in stones:
            older = [r for r in left if r.seq < stone.seq]
            if older:
                kept.append(self._narrowed(stone, older, stones))
        return self.manifest.commit([*left, *kept, entry], base)

    def _narrowed(self, stone, older: list, stones: list) -> tuple:
        """The tombstones of chunks in `older` segments only, with their statistics."""
        before = [s for s in stones if s.seq < stone.seq]
        chunks = self.manifest.read([f"{stone.folder}/chunks"], self.chunk_schema).select("chunk_id")
        name = self.manifest.new_folder("tombstones")
        self._alive(older, before, "chunks", self.chunk_schema).join(chunks, "chunk_id", "left_semi").write.parquet(self._folder(name, "chunks"))
        dead = self.manifest.read([f"{name}/chunks"], self.chunk_schema)
        lost = self._alive(older, before, "postings", self.postings_schema).join(dead.select("chunk_id"), "chunk_id", "left_semi")
        lost.groupBy("term").agg((-F.count("*")).alias("df")).write.parquet(self._folder(name, "terms"))
        total = dead.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
        return ("tombstones", name, stone.seq, -total.n, -total.tokens, total.n)

    def index(self, version: int | None = None, eps: float = search.EPS) -> search.Index:
        """What search.bm25_index gives for the chunks that are there in a version, by default the latest."""
        version = self.manifest.latest() if version is None else version
        segments, stones = self._entries("postings", version), self._entries("tombstones", version)
        postings = self._alive(segments, stones, "postings", self.postings_schema)
        both = [*segments, *stones]
        n, tokens = sum(r.n for r in both), sum(r.tokens for r in both)
        totals = self.spark.createDataFrame([(n, tokens / n if n else None)], "n long, avgdl double")
        df = self.manifest.read([f"{r.folder}/terms" for r in both], "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return search.Index(postings, search.term_weights(df, totals, eps), totals)
