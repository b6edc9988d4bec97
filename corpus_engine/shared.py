"""Intermediate tables in the cluster's shared folder, and orders over whole tables.

Every helper takes and returns DataFrames. Nothing here gathers rows of a table in one
task: orders are dealt out by ranges, and only sums per range meet in one place.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FALLBACK_DIR = "/tmp/checkpoints"
#: Bytes of text that one task holds, about: more input makes more tasks, not larger ones.
TASK_BYTES = 8_000_000
#: Bytes of files that one task reads at most before it deals their rows out.
SCAN_BYTES = 32_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine, if unset, one in /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = FALLBACK_DIR
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def united(*parts: DataFrame) -> DataFrame:
    """All rows of the parts, columns that one lacks as nulls, safe for windows and groups above.

    Spark 4.1 takes a union for partitioned as its parts are, also where rows of a key do not meet, and leaves
    out the shuffle above it, even one that is asked for by repartition(). The setting that does so is
    turned off for the session.
    """
    parts[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks(spark: SparkSession, amount: int, each: int) -> int:
    """How many tasks an amount is dealt out to: `each` for one; of less, as many as run at once, unless that is too little for them."""
    return max(1, -(-amount // each), min(spark.sparkContext.defaultParallelism, amount * 8 // each))


def deal(df: DataFrame, amount: int, each: int, *by: str) -> DataFrame:
    """df dealt out by columns to tasks(amount, each).

    A task that deals rows out to more than 200 others (spark.shuffle.sort.bypassMergeThreshold) holds all that it
    read, unpacked, so it reads SCAN_BYTES of files at most. The setting is lowered for the session, never raised.
    """
    spark, name = df.sparkSession, "spark.sql.files.maxPartitionBytes"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > SCAN_BYTES:
        spark.conf.set(name, str(SCAN_BYTES))
    return df.repartition(tasks(spark, amount, each), *by)


def range_buckets(df: DataFrame, order: list[Column], name: str, bucket: str = "_bucket") -> DataFrame:
    """df as a written table with `bucket`: rows of a lower bucket come first in `order`.

    `order` should end in columns that tell rows apart, so that one frequent first key is
    spread over several buckets.
    """
    ranged = df.repartitionByRange(partitions(df.sparkSession), *order)
    return materialize(ranged.withColumn(bucket, F.spark_partition_id()), name)


def running_total(
    df: DataFrame, groups: list[str], order: list[Column], value: Column, out: str, bucket: str = "_bucket"
) -> DataFrame:
    """Add `out`, the sum of `value` over the rows before this one in its group.

    df comes from range_buckets over (groups, order). A group may span many buckets: sums per
    (group, bucket) are carried over, and only rows of one bucket are sorted together.
    """
    sums = df.groupBy(*groups, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col(bucket).alias("_b"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"),
    )
    same = F.col(bucket) == F.col("_b")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(bucket, *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(start, same)
        .withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_start", "_b", *[f"_g{i}" for i in range(len(groups))])
    )


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder of any file system that Spark reads; none if it is not there."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(found)) if system.exists(found) else []


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, where neither PYTHONPATH nor the folder they start in does."""
    root = Path(__file__).resolve().parent.parent
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if getattr(context, "_corpus_engine_shipped", False) or any(Path(p, "corpus_engine").is_dir() for p in paths if p):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/corpus_engine", "zip", root, "corpus_engine")
    context.addPyFile(archive)
    context._corpus_engine_shipped = True
