"""Versions of a stored table: a small list of its folders for each version, under `_versions`.

Folders are written once and never changed; an edit writes new ones, then commits a list. Readers
hold on to a version, so an edit that fails, or that comes later, changes nothing for them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from corpus_engine.shared import folders


class VersionConflict(RuntimeError):
    """Someone else has committed since the version that an edit began from."""


class Manifest:
    """The lists of a table at `path`. `entry` is the schema of a row, which stands for a folder."""

    def __init__(self, spark: SparkSession, path: str, entry: str):
        self.spark, self.path, self.entry = spark, path.rstrip("/"), entry

    def _at(self, version: int) -> str:
        return f"{self.path}/_versions/v={version:08d}"

    def latest(self) -> int:
        """The last version that was committed whole; 0 if there is none."""
        names = [n for n in folders(self.spark, f"{self.path}/_versions") if n.startswith("v=")]
        for name in sorted(names, reverse=True):
            if "_SUCCESS" in folders(self.spark, f"{self.path}/_versions/{name}"):
                return int(name[2:])
        return 0

    def entries(self, version: int | None = None) -> list[Row]:
        """The rows of a version, by default the latest: as many as the table has folders."""
        version = self.latest() if version is None else version
        return self.spark.read.schema(self.entry).parquet(self._at(version)).collect() if version else []

    def commit(self, rows: list, base: int) -> int:
        """Make `rows` the version after `base`; raises VersionConflict if there is one already."""
        if self.latest() != base:
            raise VersionConflict(f"{self.path} is at version {self.latest()}, the edit began at {base}")
        found = self.spark.createDataFrame([tuple(r) for r in rows], self.entry)
        # an attempt that broke off before its list was whole is written over
        found.coalesce(1).write.mode("overwrite").parquet(self._at(base + 1))
        return base + 1

    def new_folder(self, name: str) -> str:
        """A name for a folder that no version has."""
        return f"{name}-{uuid.uuid4().hex}"

    def read(self, names: list[str], schema: str) -> DataFrame:
        """The rows of these folders, one after the other."""
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])


def rewritten(before: list[Row], after: list[Row], key: str = "folder") -> tuple[set, set]:
    """(folders that went, folders that came) from one version to another."""
    old, new = {r[key] for r in before}, {r[key] for r in after}
    return old - new, new - old


def counted(df: DataFrame, *columns: str) -> list[Row]:
    """Rows of each combination of columns: as many as there are combinations."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).collect()
