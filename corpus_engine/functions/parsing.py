"""Parsing what language models and tools returned, as tables of raw texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_engine.functions.rules import QUERY_TYPES, classify_query
from corpus_engine.functions.text import strip

CLASSIFICATION = "struct<query_type:string,confidence:double,complexity:string>"
FINDINGS = "struct<errors:array<struct<type:string,description:string,severity:string>>>"
COMPLEXITIES = ("simple", "medium", "complex")
MIXED = "mixed_law_case"


def without_fences(raw: Column) -> Column:
    return strip(F.regexp_replace(raw, r"```(?:json)?", ""))


def outermost_braces(raw: Column) -> Column:
    """What stands between the first { and the last }, else the trimmed text."""
    return F.coalesce(F.nullif(F.regexp_extract(raw, r"(?s)\{(.*)\}", 0), F.lit("")), strip(raw))


def parsed_classification(df: DataFrame, query: str = "query", raw: str = "raw") -> DataFrame:
    """query_type, confidence (0 to 1), complexity and where they come from: the model, if it named a known type, or the rules."""
    told = F.from_json(without_fences(F.col(raw)), CLASSIFICATION)
    kinds = [*(name for name, _, _ in QUERY_TYPES), MIXED]
    good = F.coalesce(told["query_type"].isin(*kinds), F.lit(False))
    kind, sure = classify_query(F.col(query))
    clamped = F.least(F.greatest(F.coalesce(told["confidence"], F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    return df.withColumns({
        "query_type": F.when(good, told["query_type"]).otherwise(kind),
        "confidence": F.round(F.when(good, clamped).otherwise(sure), 4),
        "complexity": F.when(told["complexity"].isin(*COMPLEXITIES), told["complexity"]).otherwise("simple"),
        "origin": F.when(good, "model").otherwise("rule"),
    })


def parsed_findings(df: DataFrame, raw: str = "raw") -> DataFrame:
    """One row for each finding in a model's JSON; severity medium by default, bad JSON gives none."""
    errors = F.from_json(outermost_braces(without_fences(F.col(raw))), FINDINGS)["errors"]
    found = df.select("doc_id", F.explode(errors).alias("e"))
    return found.select("doc_id", F.col("e.type").alias("error_type"), F.col("e.description").alias("description"), F.coalesce("e.severity", F.lit("medium")).alias("severity"))


# How search results are written for a model, and read again.
NOTHING = "未找到相关结果。建议尝试不同的关键词重新检索。"
BETWEEN = "\n\n---\n\n"
RESULT = r"(?sdU)\[结果(\d+)\]\s*来源:\s*(.+?)\s*\|\s*类型:\s*(\S*)\s*\|\s*相关度:\s*(\S+)\n(.*?)(?=\n\n---|$)"


def observation_block(
    results: DataFrame, tool: str = "search", queries: DataFrame | None = None, times: DataFrame | None = None, most: int = 5, size: int = 800
) -> DataFrame:
    """results(query_id, rank, source, doc_type, score, text) -> query_id, observation: the first results as a text.

    Null sources are 未知来源, null types empty, scores that are null or 0 N/A, null texts empty. Results of
    one rank follow by text. queries(query_id): those without results get a line that says so.
    times(query_id, ms): how long each search took, else 0.
    """
    cut = F.when(F.length("text") > size, F.concat(F.substring("text", 1, size), F.lit("……"))).otherwise(F.coalesce("text", F.lit("")))
    shown = F.when(F.coalesce("score", F.lit(0.0)) == 0, "N/A").otherwise(F.format_string("%.3f", F.col("score").cast("double")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "text"))
    part = F.concat(
        F.lit("[结果"), F.col("_n").cast("string"), F.lit("] 来源: "), F.coalesce("source", F.lit("未知来源")), F.lit(" | 类型: "), F.coalesce("doc_type", F.lit("")),
        F.lit(" | 相关度: "), shown, F.lit("\n"), cut,
    )
    parts = F.sort_array(F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", part.alias("t")))))
    found = results.withColumn("_n", place).groupBy("query_id").agg(
        F.count("*").alias("_all"), F.array_join(F.transform(parts, lambda p: p["t"]), BETWEEN).alias("_parts")
    )
    if queries is not None:
        found = queries.select("query_id").distinct().join(found, "query_id", "left")
    took = times.groupBy("query_id").agg(F.max("ms").alias("_ms")) if times is not None else None
    found = found.join(took, "query_id", "left") if took is not None else found.withColumn("_ms", F.lit(0.0))
    head = F.concat(
        F.lit(f"[{tool}] 共找到 "), F.col("_all").cast("string"), F.lit(" 条结果（返回前 "), F.least("_all", F.lit(most)).cast("string"), F.lit(" 条，耗时 "),
        F.format_string("%.0f", F.coalesce("_ms", F.lit(0.0)).cast("double")), F.lit("ms）:\n\n"), "_parts",
    )
    return found.select("query_id", F.coalesce(head, F.lit(f"[{tool}] {NOTHING}")).alias("observation"))


def parsed_observation(df: DataFrame) -> DataFrame:
    """df(query_id, observation) -> query_id, rank, source, doc_type, score, text: the results in it again.

    A text runs to the next blank line and rule, as it was written or not; a score that is no number is 0.
    """
    parts = [F.regexp_extract_all("observation", F.lit(RESULT), F.lit(i)) for i in range(1, 6)]
    rows = df.select("query_id", F.explode(F.arrays_zip(*[p.alias(f"p{i}") for i, p in enumerate(parts)])).alias("r"))
    number = F.expr("try_cast(r.p3 as double)")
    return rows.select(
        "query_id", F.expr("try_cast(r.p0 as int)").alias("rank"), strip(F.col("r.p1")).alias("source"), strip(F.col("r.p2")).alias("doc_type"),
        F.coalesce(number, F.lit(0.0)).alias("score"), strip(F.col("r.p4")).alias("text"),
    )
