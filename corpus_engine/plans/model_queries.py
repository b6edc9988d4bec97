"""Registered queries on what models return, made of the tables' rows, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.functions import parsing
from corpus_engine.operators import assemble
from corpus_engine.plans import search_queries, text_queries
from corpus_engine.plans.search_queries import bm25, table, whole


def model_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of four kinds: good, fenced, of an unknown type, broken."""
    asked = text_queries.questions(spark, sf_dir)
    kind = F.when(F.col("query_id") % 4 == 2, "poetry").otherwise("case_analysis")
    body = F.concat(F.lit('{"query_type": "'), kind, F.lit('", "confidence": '), ((F.col("query_id") % 20) / 10).cast("string"), F.lit(', "complexity": "'), F.when(F.col("query_id") % 3 == 0, "huge").otherwise("medium"), F.lit('"}'))
    raw = F.when(F.col("query_id") % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("query_id") % 4 == 3, F.lit("{not json")).otherwise(body)
    return parsing.parsed_classification(asked.withColumn("raw", raw)).select("query_id", "query_type", "confidence", "complexity", "origin")


def model_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in answers with words around the JSON; odd ones are broken."""
    docs = table(spark, sf_dir, "documents")
    body = F.concat(F.lit('Here: {"errors": [{"type": "'), "lang", F.lit('", "description": "'), "source", F.lit('"}, {"type": "case", "description": "d", "severity": "high"}]} done'))
    return parsing.parsed_findings(docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, body).otherwise(F.lit("{")).alias("raw")))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of every passage as a text, and read from it again."""
    ranked = assemble.with_texts(bm25(spark, sf_dir, 8), whole(spark, sf_dir))
    ranked = ranked.withColumns({"source": F.concat(F.lit("doc "), F.col("chunk_id").cast("string")), "doc_type": F.when(F.col("chunk_id") % 3 == 0, "law")})
    return parsing.parsed_observation(parsing.observation_block(ranked)).withColumn("text", F.md5("text"))


def _classified_sql() -> str:
    sql = text_queries.ORACLE_SQL["prepared_queries"]
    return sql.replace(f"({text_queries._correct_sql()})", "asked")


QUERIES = {f.__name__: f for f in (model_classification, model_findings, observations)}
ORACLE_SQL = {
    "model_classification": f"""SELECT query_id, CASE WHEN query_id % 4 < 2 THEN 'case_analysis' ELSE r.query_type END AS query_type,
        CASE WHEN query_id % 4 < 2 THEN least((query_id % 20) / 10, 1.0) ELSE r.confidence END::DOUBLE AS confidence,
        CASE WHEN query_id % 4 = 3 OR query_id % 3 = 0 THEN 'simple' ELSE 'medium' END AS complexity, CASE WHEN query_id % 4 < 2 THEN 'model' ELSE 'rule' END AS origin FROM ({_classified_sql()}) r""",
    "model_findings": """SELECT doc_id, lang AS error_type, source AS description, 'medium' AS severity FROM documents WHERE doc_id % 2 = 0
        UNION ALL SELECT doc_id, 'case', 'd', 'high' FROM documents WHERE doc_id % 2 = 0""",
    "observations": f"""WITH {search_queries.BM25} SELECT query_id, rank::INT AS rank, 'doc ' || chunk_id AS source, CASE WHEN chunk_id % 3 = 0 THEN 'law' ELSE '' END AS doc_type, round(score, 3) AS score,
        md5(trim(string_split(CASE WHEN len(text) > 800 THEN substr(text, 1, 800) || '……' ELSE text END, chr(10) || chr(10) || '---')[1])) AS text FROM ranked JOIN documents ON doc_id = chunk_id WHERE rank <= 5""",
}
