"""Operator 1: mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a word target by its weight; the targets share a multiple of the corpus and
stop at `max_epochs` times their source. A source is first taken whole as often as its target
allows; the rest is filled in the order of exponential keys -ln(u)/quality, up to the word
budget. u comes from the row's own hash, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.shared import materialize, range_buckets, running_total

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Weight of a document by its label: good, poor, none.
QUALITY = {1: 2.0, 0: 0.5, None: 1.0}
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """(source, source_size) -> the same with `weight` and `target`.

    Sources in code point order, null last, take the weights in turn. Target = min(max_epochs *
    source_size, rate * weight); the rate is raised, with what full sources cannot take, until
    no target is above its limit. Each step is one aggregate over the sources, so any number of
    sources will do. No sources: no rows. All sizes zero: targets zero.
    """
    order = [F.col("source").asc_nulls_last()]
    table = range_buckets(sizes.select("source", "source_size"), order, "mix-sources")
    ranked = running_total(table, [], order, F.lit(1), "_rank")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.select("source", "source_size", turn.alias("weight")), "mix-weights")
    limit = (F.col("source_size") * max_epochs).cast("double")
    total, all_weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, rate, full = share * (total or 0), 0.0, -1
    if total:
        rate = budget / all_weights
    while total:
        above = limit <= F.col("weight") * rate
        kept, open_weights, n = ranked.agg(
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(above, 1)),
        ).first()
        if n == full or not open_weights:
            break
        full, rate = n, (budget - kept) / open_weights
    target = F.round(F.least(limit, F.col("weight") * F.lit(rate)), 6)
    return ranked.withColumn("target", target)


def sampling_key(quality: Column, *row: Column) -> Column:
    """-ln(u)/quality; u in (0, 1) from the md5 of the row and the seed. Small keys are taken first."""
    digest = F.md5(F.concat_ws("|", F.lit(SEED), *row))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    return -F.ln(u) / quality


def mix(
    rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """rows(doc_id, source, size, quality, tag, row) -> the same with source_size, target, copies, taken.

    `tag` is a hash of the text: it parts rows that share a doc_id. copies = whole epochs plus
    one for documents of the fractional epoch; the document at the edge of the budget is taken
    if that brings the source nearer to its target, so a source ends within half a document of
    it. `row` is a number of the row that only parts rows equal in all else, which share one key.
    Null source: a source of its own. Null doc_id: told apart by tag. Size 0: taken 0. No rows: no
    rows.
    """
    key = sampling_key(F.col("quality"), F.col("doc_id").cast("string"), F.col("tag"))
    order = [F.col("source"), F.col("key"), F.col("doc_id"), F.col("tag"), F.col("row")]
    keyed = range_buckets(rows.withColumn("key", key), order, "mix-keys")
    targets = source_targets(
        keyed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs
    ).select(F.col("source").alias("_source"), "source_size", "target")
    summed = running_total(keyed, ["source"], order[1:], F.col("size"), "_before")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("_epochs") * F.col("source_size")
    more = (
        (F.col("size") > 0) & (F.col("_epochs") < max_epochs) & (2 * F.col("_before") + F.col("size") <= 2 * F.col("_rest"))
    )
    return (
        summed.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_epochs", epochs)
        .withColumn("_rest", rest)
        .withColumn("copies", (F.col("_epochs") + more.cast("long")).cast("int"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_source", "_bucket", "_epochs", "_rest", "_before")
    )


def quality_of(labels: DataFrame) -> DataFrame:
    """One row per labelled doc_id: its sampling weight (the best of its labels)."""
    best = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("q"))
    weight = F.when(F.col("q") == 1, QUALITY[1]).when(F.col("q") == 0, QUALITY[0]).otherwise(QUALITY[None])
    return best.select(F.col("doc_id").alias("_labelled"), weight.alias("quality"))


def mixed_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Mix docs(doc_id, text, source[, row]) by the labels' quality; other columns are not read."""
    row = F.col("row") if "row" in docs.columns else F.monotonically_increasing_id()
    rows = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.md5("text").alias("tag"), row.alias("row")
    )
    rows = rows.join(quality_of(labels), F.col("doc_id") == F.col("_labelled"), "left").drop("_labelled")
    return mix(rows.withColumn("quality", F.coalesce("quality", F.lit(QUALITY[None]))))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of every document; one row per row, other columns not read.

    Null texts have size 0 and are not taken. A null source is a source of its own, the last one.
    Null doc_ids are told apart by their texts; rows equal in both share a key and are taken in the
    order of the table. Long texts count whole, so a source ends within half a document of its
    target. No documents: no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixed_documents(docs, labels).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def _oracle() -> str:
    return f"""
WITH RECURSIVE q AS (SELECT doc_id, max(quality) q FROM labels GROUP BY doc_id),
r AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '{WORD}'))::BIGINT AS size, md5(d.text) AS tag,
         CASE q.q WHEN 1 THEN {QUALITY[1]} WHEN 0 THEN {QUALITY[0]} ELSE {QUALITY[None]} END::DOUBLE AS quality
  FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
k AS (SELECT *, -ln((('0x' || substr(md5(concat_ws('|', '{SEED}', doc_id::VARCHAR, tag)), 1, 12))::BIGINT::DOUBLE + 0.5)
              / 281474976710656.0::DOUBLE) / quality AS key FROM r),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn
      FROM r GROUP BY source),
w AS (SELECT source, source_size, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][turn + 1] AS weight FROM s),
step AS (
  SELECT 0 AS i, {SHARE}::DOUBLE * sum(source_size) / sum(weight) AS rate FROM w
  UNION ALL
  SELECT i + 1, (SELECT ({SHARE}::DOUBLE * sum(source_size) - sum(CASE WHEN {MAX_EPOCHS} * source_size <= weight * rate THEN {MAX_EPOCHS} * source_size ELSE 0 END))
                 / nullif(sum(CASE WHEN {MAX_EPOCHS} * source_size <= weight * rate THEN 0 ELSE weight END), 0) FROM w)
  FROM step WHERE i <= (SELECT count(*) FROM w) AND rate IS NOT NULL),
t AS (SELECT source, source_size, round(least({MAX_EPOCHS} * source_size, weight * (SELECT max(rate) FROM step)), 6)::DOUBLE AS target FROM w),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, tag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
e AS (SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (epochs + (size > 0 AND epochs < {MAX_EPOCHS} AND 2 * before + size <= 2 * (target - epochs * source_size))::INT)::INT AS copies FROM e)
SELECT doc_id, source, size, source_size, target, copies, (copies * size)::BIGINT AS taken FROM c
"""


QUERIES = {"op1_mix_sources": op1_mix_sources}
ORACLE_SQL = {"op1_mix_sources": _oracle()}
