"""Collections of documents as tables: filters, pages, counts, edits; each edit returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.shared import united


def metadata_predicate(filters: dict) -> Column:
    """Scalars: equality; lists: any of their scalars; year_range {start, end}; all together.

    Empty lists, other dicts and nested values are passed over; nothing usable keeps all rows.
    """
    out = F.lit(True)
    scalar = (str, int, float, bool)
    for key, value in filters.items():
        if key == "year_range" and isinstance(value, dict):
            if value.get("start") is not None:
                out &= F.col("year") >= value["start"]
            if value.get("end") is not None:
                out &= F.col("year") <= value["end"]
        elif isinstance(value, scalar):
            out &= F.col(key) == value
        elif isinstance(value, (list, tuple)) and (usable := [v for v in value if isinstance(v, scalar)]):
            out &= F.col(key).isin(usable)
    return out


def keyword_filter(df: DataFrame, keyword: str) -> DataFrame:
    return df.where(F.col("text").contains(keyword))


def get_by_ids(df: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def delete_by_ids(df: DataFrame, ids: DataFrame, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row with the number of rows that went)."""
    gone = df.join(ids.select(key), key, "left_semi").agg(F.count("*").alias("deleted"))
    return df.join(ids.select(key), key, "left_anti"), gone


def update_by_id(df: DataFrame, updates: DataFrame, key: str = "chunk_id") -> DataFrame:
    """updates(key, text) replace texts; re_embed marks rows whose text is new. Unknown ids and null
    texts do nothing; of several texts for an id the greatest counts."""
    new = updates.groupBy(key).agg(F.max("text").alias("_new"))
    met = df.join(new, key, "left")
    return met.withColumns({"text": F.coalesce("_new", "text"), "re_embed": F.col("_new").isNotNull()}).drop("_new")


def paginate(df: DataFrame, offset: int, limit: int, key: str = "chunk_id") -> DataFrame:
    """One page in the order of the key, and the total on each row."""
    total = F.broadcast(df.agg(F.count("*").alias("total")))  # one row
    return df.orderBy(key).offset(offset).limit(limit).join(total)


def collection_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("collection").agg(F.count("*").alias("documents"))


def collection_info(df: DataFrame, name: str) -> DataFrame:
    """One row: the number of documents and whether there are any."""
    own = df.where(F.col("collection") == name).agg(F.count("*").alias("documents"))
    return own.select(F.lit(name).alias("collection"), "documents", (F.col("documents") > 0).alias("initialised"))


def append_to_collection(df: DataFrame, path: str, name: str) -> None:
    """Create or append; an empty table changes nothing. Chunks lie in a folder for each collection."""
    df.withColumn("collection", F.lit(name)).write.mode("append").partitionBy("collection").parquet(path)


def drop_collection(spark: SparkSession, path: str, name: str, target: str) -> DataFrame:
    """The store without a collection, written to `target`; a name that is not there changes nothing."""
    kept = spark.read.parquet(path).where(F.col("collection") != name)
    kept.write.mode("overwrite").partitionBy("collection").parquet(target)
    return spark.read.parquet(target)


def dedup_ingest(df: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of new content: one of each hash, none whose hash is known.

    Of rows of one hash that of the smallest doc_id stays (null first; if several have it, the one
    whose columns hash smallest). A null text has no content to compare: such rows all stay, their
    file_hash is null.
    """
    hashed = df.withColumns({"file_hash": F.sha2("text", 256), "_row": F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])})
    fresh = hashed.join(known.select("file_hash"), "file_hash", "left_anti")
    first = fresh.where("file_hash is not null").groupBy("file_hash").agg(F.min(F.struct("doc_id", "_row")).alias("_f"))
    first = first.select(F.col("file_hash").alias("_hash"), F.col("_f.doc_id").alias("_id"), F.col("_f._row").alias("_of"))
    same = (F.col("file_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_of"))
    kept = fresh.join(first, same, "left_semi").dropDuplicates(["file_hash"])  # rows that are left of a hash are equal
    return united(kept, fresh.where("file_hash is null")).select("file_hash", *[F.col(f"`{c}`") for c in df.columns])


def compare_ids(asked: DataFrame, df: DataFrame, key: str = "chunk_id") -> DataFrame:
    """asked ids and whether they exist."""
    have = df.select(key).distinct().withColumn("found", F.lit(True))
    return asked.select(key).distinct().join(have, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
