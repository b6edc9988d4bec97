"""Pages by position: a written order of a table, in ranges whose sizes are known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.shared import new_path, partitions, range_buckets


class PageIndex:
    """Rows of `df` by ascending keys (null first), in ranges of about `rows` rows; a page reads the ranges that it lies in.

    The last key should tell rows apart: a key that very many rows share is spread over ranges only then.
    """

    def __init__(self, df: DataFrame, keys: list[str], path: str | None = None):
        self.spark: SparkSession = df.sparkSession
        self.keys, self.schema = keys, df.schema
        self.path = path or new_path(self.spark, "pages")
        dealt = range_buckets(df, [F.col(k) for k in keys], "page-order", "_range")
        dealt.repartition(partitions(self.spark), "_range").sortWithinPartitions("_range", *keys).write.partitionBy("_range").parquet(self.path)
        counts = dealt.groupBy("_range").agg(F.count("*").alias("n")).collect()  # a row a range
        self.ranges = [(r._range, r.n) for r in sorted(counts, key=lambda r: r._range)]
        self.total = sum(n for _, n in self.ranges)

    def parts(self, offset: int, limit: int) -> tuple[list[int], int]:
        """(the ranges that rows offset .. offset + limit lie in, how many rows come before them)."""
        begun, before, found = 0, 0, []
        for number, n in self.ranges:
            if begun + n <= offset:
                before = begun + n
            elif begun < offset + limit:
                found.append(number)
            begun += n
        return found, before

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows offset .. offset + limit in order, and the total on each row; behind the end: no rows."""
        found, before = self.parts(offset, limit)
        if not found or limit <= 0:
            return self.spark.createDataFrame([], self.schema).withColumn("total", F.lit(self.total).cast("long"))
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/_range={n}" for n in found])
        return rows.orderBy(*self.keys).offset(offset - before).limit(limit).withColumn("total", F.lit(self.total).cast("long"))
