"""Registered queries of what is kept by deltas: posting segments, versioned collections, inverted files, pages, table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.functions import rule_tables, tables
from corpus_engine.operators import search
from corpus_engine.operators.collections import Collections
from corpus_engine.operators.inverted_file import InvertedFile, recall
from corpus_engine.operators.pages import PageIndex
from corpus_engine.operators.posting_segments import PostingSegments
from corpus_engine.plans import search_queries, store_queries, text_queries
from corpus_engine.plans.search_queries import passages, table, whole
from corpus_engine.shared import new_path
from corpus_engine.streaming import keyed


def _segments(spark: SparkSession, sf_dir: str) -> PostingSegments:
    """All documents in three appends, then every seventh deleted; every fourteenth comes back with a text of its own."""
    docs = whole(spark, sf_dir)
    kept = PostingSegments(spark, new_path(spark, "segments"))
    for part in range(3):
        kept.append(docs.where(F.pmod("chunk_id", F.lit(3)) == part))
    kept.delete(docs.where("chunk_id % 7 = 0").select("chunk_id"))
    kept.append(docs.where("chunk_id % 14 = 0").withColumn("text", F.concat(F.lit("returned "), F.coalesce("text", F.lit("")))))
    return kept


def bm25_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents by an index of segments and tombstones."""
    return search.bm25_search(passages(spark, sf_dir), _segments(spark, sf_dir).index(), 5)


def bm25_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency and weight of every term after the segments have been merged."""
    kept = _segments(spark, sf_dir)
    kept.merge()
    return kept.index().terms.select("term", "df", F.round("idf", 6).alias("idf"))


def collection_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language, edited; each version is read again at the end."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang")
    kept = Collections(spark, new_path(spark, "collections"), "chunk_id long, text string", parts=8)
    for (name,) in docs.select("lang").distinct().where("lang is not null").orderBy("lang").collect():  # a row a language
        kept.append(docs.where(F.col("lang") == name).select("chunk_id", "text"), name)
    first = kept.manifest.latest()
    second = kept.delete(docs.where("chunk_id % 5 = 0").select("chunk_id"))
    third = kept.update(docs.where("chunk_id % 9 = 0").select("chunk_id", F.concat("text", F.lit(" again")).alias("text")))
    fourth = kept.drop("fr")
    out = None
    for number, version in enumerate((first, second, third, fourth), 1):
        rows = kept.read(version).select(F.lit(number).alias("version"), "collection", "chunk_id", F.md5("text").alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


def knn_inverted_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the inverted file with half its radius against exact search, and the share of pairs that it compared."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    asked = rows.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    found, compared = InvertedFile(rows).search(asked, 10, reach=0.5)
    return recall(found, search.knn_search(asked, rows, 10), compared, asked.count() * rows.count())


def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a page from the middle of all documents by source and id, from the ranges it lies in."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    index = PageIndex(docs, ["source", "doc_id"])
    return index.page(index.total // 2, 50)


def finding_places_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function, called by LATERAL in SQL, for three rules."""
    tables.register(spark)
    rows = text_queries.personal(spark, sf_dir)
    return spark.sql(
        "SELECT doc_id, p.rule, p.position, p.length FROM {rows}, LATERAL finding_places(text, 'spaces,newlines,controls') AS p", rows=rows
    )


def classified_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6, H9: documents by a rule set from Parquet: the longer words of the passages, for the label of their passage, and a pattern."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0))).alias("pattern")).distinct()
    label = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.pmod("item_id", F.lit(3)) + 1).cast("int"))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("cap", "int"), ("density", "double"), ("bonus", "double"))]
    literals = words.select(label.alias("label"), F.lit("word").alias("name"), F.lit("word").alias("kind"), "pattern", F.lit(1.0).alias("weight"), F.lit("text").alias("field"), *none)
    pattern = spark.createDataFrame([("b", "digits", "regex", "[0-9]{2,}", 2.0, "text", 10, 0.01, 5.0)], "label string, name string, kind string, pattern string, weight double, field string, cap int, density double, bonus double")
    path = new_path(spark, "rules")
    literals.unionByName(pattern).write.parquet(path)
    files = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = rule_tables.classify_by_table(files, spark.read.schema(rule_tables.RULES).parquet(path), "none")
    return found.select("doc_id", "a_score", "b_score", "c_score", "doc_type", "confidence")


def session_repeats_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages as a stream of two batches, keyed state in between."""
    rows, path = store_queries.messages(spark, sf_dir), new_path(spark, "messages")
    for part in (0, 1):  # the first turns, then the others
        rows.where((F.col("id") % 60 >= 3) == bool(part)).write.parquet(f"{path}/in/part={part}")
    before = spark.conf.get(keyed.PROVIDER)
    spark.conf.set(keyed.PROVIDER, keyed.ROCKSDB)
    try:
        for part in (0, 1):
            stream = spark.readStream.schema(rows.schema).option("basePath", f"{path}/in").parquet(f"{path}/in/part={{{','.join(map(str, range(part + 1)))}}}")
            found = keyed.repeated_queries(stream)
            sink = found.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
            sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(keyed.PROVIDER, before)
    return spark.read.schema(found.schema).parquet(f"{path}/out")


QUERIES = {
    f.__name__: f
    for f in (bm25_incremental, bm25_merged, collection_versions, knn_inverted_report, deep_page, finding_places_lateral, classified_by_table, session_repeats_stream)
}

_DOCS = """(SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 0 UNION ALL
            SELECT doc_id, 'returned ' || coalesce(text, '') FROM documents WHERE doc_id % 14 = 0)"""
_BM25 = search_queries.BM25.replace("FROM documents)", f"FROM {_DOCS})")


def _places(rule: str, pattern: str) -> str:
    """Every match of a pattern: what comes before it ends the pieces between matches."""
    return f"""SELECT doc_id, '{rule}' AS rule, (list_sum(list_transform(before[:i], lambda x: len(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: len(x))), 0))::INT AS position,
        len(found[i])::INT AS length FROM (SELECT doc_id, found, string_split_regex(text, '{pattern}') AS before, unnest(range(1, len(found) + 1)) AS i
        FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS found FROM ({text_queries._PERSONAL})))"""


ORACLE_SQL = {
    "bm25_incremental": f"WITH {_BM25} SELECT query_id, chunk_id, rank, score FROM ranked WHERE rank <= 5",
    "bm25_merged": f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "collection_versions": """SELECT version, lang AS collection, doc_id AS chunk_id,
        md5(CASE WHEN version >= 3 AND doc_id % 9 = 0 AND text IS NOT NULL THEN text || ' again' ELSE text END) AS text
        FROM documents, (SELECT unnest([1, 2, 3, 4]) AS version)
        WHERE lang IS NOT NULL AND (version = 1 OR doc_id % 5 <> 0) AND (version < 4 OR lang <> 'fr')""",
    "deep_page": "SELECT source, doc_id, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY source NULLS FIRST, doc_id LIMIT 50 OFFSET (SELECT count(*) // 2 FROM documents)",
    "classified_by_table": """WITH w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[A-Za-z]{7,}')) AS p FROM benchmark),
        r AS (SELECT p, count(*) FILTER (item_id % 3 = 0) AS a, count(*) FILTER (item_id % 3 = 1) AS b, count(*) FILTER (item_id % 3 = 2) AS c FROM w GROUP BY p),
        m AS (SELECT doc_id, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM documents JOIN r ON contains(text, p) GROUP BY doc_id),
        d AS (SELECT doc_id, len(text) AS n, len(regexp_extract_all(text, '[0-9]{2,}')) AS k FROM documents),
        s AS (SELECT d.doc_id, coalesce(a, 0)::DOUBLE AS a_score, coalesce(b, 0) + coalesce(least(k, 10) * 2.0 + CASE WHEN n > 0 AND k / n >= 0.01 THEN 5 ELSE 0 END, 0)::DOUBLE AS b_score, coalesce(c, 0)::DOUBLE AS c_score
              FROM d LEFT JOIN m ON m.doc_id = d.doc_id)
        SELECT *, CASE WHEN a_score > b_score AND a_score > c_score THEN 'a' WHEN b_score > a_score AND b_score > c_score THEN 'b' WHEN c_score > a_score AND c_score > b_score THEN 'c' ELSE 'none' END AS doc_type,
        CASE WHEN a_score + b_score + c_score > 0 THEN round(greatest(a_score, b_score, c_score) / (a_score + b_score + c_score), 6) ELSE 0 END AS confidence FROM s""",
    "session_repeats_stream": store_queries.ORACLE_SQL["session_repeats"],
    "finding_places_lateral": " UNION ALL ".join(
        _places(rule, pattern) for rule, pattern in (("spaces", " {3,}"), ("newlines", "\\n{3,}"), ("controls", "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]"))
    ),
}
