"""Collections that are edited in place: a manifest of versions over partition folders.

Chunks lie in folders by collection and hash of chunk_id. An edit writes new folders for the partitions that
it touches and commits a version; all others keep their files. A reader holds on to its version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from corpus_engine.operators import store
from corpus_engine.sources.manifest import Manifest

ENTRY = "collection string, part int, folder string, rows long"


class Collections:
    """The store at `path`: rows of `schema`, which has chunk_id, in `parts` partitions a collection."""

    def __init__(self, spark: SparkSession, path: str, schema: str, parts: int = 64):
        self.spark, self.parts = spark, parts
        self.schema = f"{schema}, collection string"
        self.manifest = Manifest(spark, path, ENTRY)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("chunk_id"), F.lit(self.parts)).cast("int")

    def _write(self, rows: DataFrame) -> list[tuple]:
        """Write rows(schema, collection) into new folders; gives their entries."""
        name = self.manifest.new_folder("data")
        key = F.concat_ws("_", F.md5("collection"), self._part().cast("string"))
        placed = rows.withColumn("_key", key).repartition("_key")
        placed.write.partitionBy("_key").parquet(f"{self.manifest.path}/{name}")
        written = self.spark.read.schema(f"{self.schema}, _key string").parquet(f"{self.manifest.path}/{name}")
        counts = written.groupBy("collection", self._part().alias("part"), "_key").agg(F.count("*").alias("n")).collect()  # a row a folder
        return [(r.collection, r.part, f"{name}/_key={r._key}", r.n) for r in counts]

    def read(self, version: int | None = None, collection: str | None = None) -> DataFrame:
        """The rows of a version, by default the latest; of one collection only its folders are read."""
        entries = [r for r in self.manifest.entries(version) if collection is None or r.collection == collection]
        return self._rows(entries)

    def _rows(self, entries: list[Row]) -> DataFrame:
        return self.manifest.read([r.folder for r in entries], self.schema)

    def append(self, rows: DataFrame, collection: str) -> int:
        """Add rows to a collection, which need not be there yet; gives the version. No rows: nothing changes."""
        base = self.manifest.latest()
        added = self._write(rows.withColumn("collection", F.lit(collection)).select(*self._columns()))
        return self.manifest.commit([*self.manifest.entries(base), *added], base) if added else base

    def drop(self, collection: str) -> int:
        """Take a collection out: no data is read or written. One that is not there changes nothing."""
        base = self.manifest.latest()
        rows = self.manifest.entries(base)
        kept = [r for r in rows if r.collection != collection]
        return base if len(kept) == len(rows) else self.manifest.commit(kept, base)

    def delete(self, ids: DataFrame) -> int:
        """Take the rows of ids(chunk_id) out of every collection; gives the version."""
        return self._edit(ids, lambda rows: store.delete_by_ids(rows, ids)[0])

    def update(self, updates: DataFrame) -> int:
        """New texts of updates(chunk_id, text), as store.update_by_id takes them; gives the version."""
        return self._edit(updates.where(F.col("text").isNotNull()), lambda rows: store.update_by_id(rows, updates).drop("re_embed"))

    def _edit(self, ids: DataFrame, change) -> int:
        """Write anew the partitions that hold any of these ids, all others stay as they are."""
        base = self.manifest.latest()
        entries = self.manifest.entries(base)
        parts = {r.part for r in ids.select(self._part().alias("part")).distinct().collect()}  # `parts` at most
        near = [r for r in entries if r.part in parts]
        held = store.get_by_ids(self._rows(near), ids).select("collection", self._part().alias("part")).distinct().collect()  # a row a partition at most
        touched = {(r.collection, r.part) for r in held}
        old = [r for r in entries if (r.collection, r.part) in touched]
        if not old:
            return base
        kept = [r for r in entries if (r.collection, r.part) not in touched]
        return self.manifest.commit([*kept, *self._write(change(self._rows(old)).select(*self._columns()))], base)

    def _columns(self) -> list[str]:
        return self._rows([]).columns

    def counts(self, version: int | None = None) -> dict[str, int]:
        """Rows of each collection, from the manifest alone."""
        out: dict[str, int] = {}
        for r in self.manifest.entries(version):
            out[r.collection] = out.get(r.collection, 0) + r.rows
        return out
