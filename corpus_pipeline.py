"""A training-data pipeline over `documents`: five stages, each written and read again.

Every stage but the last returns the columns of its documents, so any further columns travel
along. Working columns carry names that no input column has.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.llm import byte_bpe, language_mixture, mix_sources, secret_layers, simhash_tiles
from corpus_engine.shared import materialize

#: A document goes if less than this share of it fits the learned languages, all of them together.
LEAST_SHARE = 0.25


def numbered(docs: DataFrame) -> DataFrame:
    """docs under the names c0, c1, ... of their positions, so that no name clashes."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def column(docs: DataFrame, name: str) -> Column:
    """A column of docs in numbered(docs)."""
    return F.col(f"c{docs.columns.index(name)}")


def named(frame: DataFrame, docs: DataFrame, **made: Column) -> DataFrame:
    """The columns of docs again, some of them made anew."""
    return frame.select(*[made.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def with_rows(docs: DataFrame, name: str) -> DataFrame:
    """numbered(docs) with a number for each `row`, written, so that the numbers stay."""
    return materialize(numbered(docs).withColumn("row", F.monotonically_increasing_id()), name)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents without a letter, or of which too little fits the learned languages, go.

    So text of other languages, code and gibberish go; documents of several learned languages stay.
    Null texts have no letter, so they go. If nothing is labelled, no language can be known: then
    every document with a letter stays.
    """
    model = language_mixture.learned(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    predicted = language_mixture.predict(docs, model, docs.columns)
    names = [f"c{i}" for i in range(len(docs.columns))]
    return named(predicted.toDF(*names, "lang_pred", "score", "languages", "fit").where(F.col("fit") >= LEAST_SHARE), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of linked fingerprints the document of smallest doc_id stays.

    If several rows have that doc_id, any one of them stays. Documents of null doc_id stay only
    where their group has no other, one of each.
    """
    rows = with_rows(docs, "pipeline-rows")
    light = rows.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").alias("text"), "row")
    grouped = simhash_tiles.near_duplicates(light, ["doc_id", "row"])
    first = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row").alias("c"))
    nameless = F.when(F.col("component_id").isNull(), F.col("fp"))  # a group without any doc_id
    kept = grouped.withColumn("nameless", nameless).groupBy("component_id", "nameless").agg(F.min(first).alias("first"))
    kept = kept.select(F.col("first.c").alias("kept"))
    return named(rows.join(kept, F.col("row") == F.col("kept"), "left_semi"), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: every secret, also under encodings, is masked; n_chars follows. All documents stay."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    masked = secret_layers.mask_secrets(docs, docs.columns).toDF(*names, "masked")
    made = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        length = F.length("masked").cast(docs.schema["n_chars"].dataType)
        same = F.col("masked").eqNullSafe(column(docs, "text"))
        made["n_chars"] = F.when(same, column(docs, "n_chars")).otherwise(length)
    return named(masked, docs, **made)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: each document is there as often as the mix takes it: not at all, once or twice."""
    rows = with_rows(docs, "pipeline-rows")
    light = rows.select(*[column(docs, c).alias(c) for c in ("doc_id", "text", "source")], "row")
    mixed = mix_sources.mixed_documents(light, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    taken = mixed.where("copies > 0").select(F.col("row").alias("taken"), "copies")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return named(rows.join(taken, F.col("row") == F.col("taken")).withColumn("copy", copies), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: token ids of each document, with the hashes of ids and decoded bytes."""
    return byte_bpe.encode_texts(
        docs.select("doc_id", "source", "text"),
        public_tokenizers.path(byte_bpe.VOCABULARY),
        public_tokenizers.PATTERN,
        keep=("doc_id", "source"),
        ids=True,
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mix", mix),
    ("encode", encode),
]

#: Language ID, BPE and decoding have no SQL: the tests compare run() with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
