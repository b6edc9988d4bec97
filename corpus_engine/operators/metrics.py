"""Evaluation: relevance of ranked lists, metrics per stage and cut, answers, stage gains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_engine.functions.text import jaccard, rouge_l, strip, tokenize

KS = (1, 3, 5, 10)
#: Order of the stages of a retrieval run.
STAGES = ("vector", "bm25", "fusion", "assembly", "rerank", "dedup")


def is_relevant(retrieved: Column, truth: Column, least: float = 0.3) -> Column:
    """Either text contains the other, or the share of the truth's tokens that were retrieved is enough."""
    r, t = F.lower(strip(retrieved)), F.lower(strip(truth))
    own, wanted = F.array_distinct(tokenize(r)), F.array_distinct(tokenize(t))
    share = F.size(F.array_intersect(own, wanted)) / F.size(wanted)
    return r.contains(t) | t.contains(r) | F.coalesce((F.size(wanted) > 0) & (share >= least), F.lit(False))


def relevance(
    retrieved: DataFrame, truth: DataFrame, match: Callable[[Column, Column], Column] = is_relevant
) -> DataFrame:
    """retrieved(stage, query_id, rank, text), truth(query_id, truth) -> stage, query_id, rank, rel, total.

    rel: 1 if any truth of the query matches; total: the query's truths. Empty texts match nothing.
    """
    wanted = truth.withColumn("total", F.count("*").over(Window.partitionBy("query_id")))
    met = retrieved.join(wanted, "query_id", "left")
    hit = F.coalesce((F.col("text") != "") & match(F.col("text"), F.col("truth")), F.lit(False)).cast("int")
    return met.groupBy("stage", "query_id", "rank").agg(F.max(hit).alias("rel"), F.coalesce(F.max("total"), F.lit(0)).alias("total"))


def metrics_at_k(rel: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """stage, query_id, k, recall, precision, ndcg, hit, rr. The ideal order is that of what was retrieved."""
    cut = rel.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    inside = F.when(F.col("rank") <= F.col("k"), F.col("rel")).otherwise(0)
    log2 = F.log2(F.col("rank") + 1)
    per = cut.groupBy("stage", "query_id", "k").agg(
        F.sum(inside).alias("hits"),
        F.sum(inside / log2).alias("dcg"),
        F.max("total").alias("total"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
    )
    ideal = F.aggregate(
        F.filter(F.sequence(F.lit(0), F.col("hits").cast("int")), lambda i: i > 0), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)
    )
    return per.select(
        "stage", "query_id", "k",
        F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(0.0).alias("recall"),
        (F.col("hits") / F.col("k")).alias("precision"),
        F.when(F.col("hits") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
        (F.col("hits") > 0).cast("int").alias("hit"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
    )


def stage_metrics(per_query: DataFrame, samples: DataFrame, digits: int = 4) -> DataFrame:
    """Means over all samples(query_id) of a stage and cut, samples without results counting as 0.

    F1 comes from the mean precision and recall.
    """
    n = F.broadcast(samples.agg(F.count("*").alias("n")))  # one row
    sums = per_query.groupBy("stage", "k").agg(*[F.sum(c).alias(c) for c in ("recall", "precision", "ndcg", "hit", "rr")])
    mean = {c: F.col(c) / F.col("n") for c in ("recall", "precision", "ndcg", "hit", "rr")}
    f1 = F.when(mean["precision"] + mean["recall"] > 0, 2 * mean["precision"] * mean["recall"] / (mean["precision"] + mean["recall"]))
    return sums.join(n).select(
        "stage", "k", *[F.round(mean[c], digits).alias({"rr": "mrr"}.get(c, c)) for c in mean],
        F.round(F.coalesce(f1, F.lit(0.0)), digits).alias("f1"), "n",
    )


def stage_deltas(metrics: DataFrame, names: tuple[str, ...] = ("recall", "precision", "ndcg", "hit", "mrr")) -> DataFrame:
    """Each metric's change from the stage before, in the fixed order of stages."""
    order = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    own = Window.partitionBy("k").orderBy("stage_no")
    placed = metrics.withColumn("stage_no", order)
    return placed.select("stage", "k", *[F.round(F.col(n) - F.lag(n).over(own), 4).alias(f"{n}_gain") for n in names])


def stage_latency(latencies: DataFrame) -> DataFrame:
    """latencies(query_id, stage_no, stage, ms) -> stage, mean of the time up to and with the stage."""
    upto = Window.partitionBy("query_id").orderBy("stage_no").rowsBetween(Window.unboundedPreceding, 0)
    return latencies.withColumn("upto", F.sum("ms").over(upto)).groupBy("stage").agg(F.round(F.avg("upto"), 4).alias("avg_latency_ms"))


def citation_accuracy(answer: Column, refs: Column) -> Column:
    """Share of references found in the answer as they stand, or by their article."""
    article = r"(第[零一二三四五六七八九十百千万\d]+条)"
    found = F.filter(refs, lambda r: answer.contains(r) | ((F.regexp_extract(r, article, 1) != "") & answer.contains(F.regexp_extract(r, article, 1))))
    return F.when(F.size(refs) > 0, F.size(found) / F.size(refs)).otherwise(0.0)


def generation_metrics(answers: DataFrame) -> DataFrame:
    """answers(answer, reference, refs) -> mean token Jaccard, ROUGE-L, citation accuracy and n.

    Without a reference Jaccard and ROUGE count as 0.
    """
    token = jaccard(F.array_distinct(tokenize(F.col("answer"))), F.array_distinct(tokenize(F.col("reference"))))
    return answers.agg(
        F.round(F.avg(F.coalesce(token, F.lit(0.0))), 4).alias("jaccard"),
        F.round(F.avg(rouge_l(F.col("answer"), F.coalesce("reference", F.lit("")))), 4).alias("rouge_l"),
        F.round(F.avg(citation_accuracy(F.col("answer"), F.col("refs"))), 4).alias("citation"),
        F.count("*").alias("n"),
    )


def ground_truth_coverage(samples: DataFrame) -> DataFrame:
    """samples(source_type, ground_truth) -> source_type (null: all), samples, evaluated (those with a truth)."""
    has = F.count_if(F.size("ground_truth") > 0)
    return samples.groupingSets([("source_type",), ()], "source_type").agg(F.count("*").alias("samples"), has.alias("evaluated"))


def answer_confidence(hits: DataFrame) -> DataFrame:
    """hits(query_id, score) -> query_id, confidence = min((0.6 max + 0.4 mean) * min(n / 5, 1), 1)."""
    raw = (0.6 * F.max("score") + 0.4 * F.avg("score")) * F.least(F.count("*") / 5, F.lit(1.0))
    return hits.groupBy("query_id").agg(F.round(F.least(raw, F.lit(1.0)), 6).alias("confidence"))
