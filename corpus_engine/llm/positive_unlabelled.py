"""Operator 4: toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words is trained with numpy from confirmed toxic texts and
unlabelled ones. With the class prior p, the risk is p * R+(positives) + max(0, R-(unlabelled)
- p * R-(positives)): unlabelled texts are not taken for clean ones, and where the second part
would fall below zero the step goes up its slope instead.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.llm.batches import map_texts
from corpus_engine.shared import materialize

#: Bits of a hashed word; most words that the classifier keeps.
BITS, KEPT = 20, 4096
#: Least log-likelihood ratio of a kept word.
EVIDENCE = 20.0
#: Most texts that the classifier is trained from: the smallest hashes of doc_id.
POSITIVES, UNLABELLED = 8000, 16_000
#: Bounds of the class prior, which is the share of toxic labels among the labelled texts.
PRIOR = (0.01, 0.5)
STEPS, RATE, RIDGE = 400, 0.05, 2e-4
#: Words whose weight a worker keeps at hand.
WORDS = 500_000

FIND = re.compile(r"\w+").findall


def word_ids(text: str | None) -> np.ndarray:
    """Hashed distinct words of the lower-cased text, sorted."""
    return np.unique(np.array([zlib.crc32(w.encode()) & ((1 << BITS) - 1) for w in set(FIND((text or "").lower()))], np.int32))


class Classifier:
    """score = 1 / (1 + exp(-(bias + sum of weights of the distinct words)))."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float):
        self.ids, self.weights, self.bias = ids, weights, bias


def uneven(counts: DataFrame, n: int, m: int, kept: int = KEPT, least: float = EVIDENCE) -> DataFrame:
    """counts(word, p, u) of texts that hold a word, of n positive and m other ones -> the words to keep.

    Words that occur in a larger share of the positive texts, by log-likelihood ratio; smaller
    hashes first among equals. Words below `least` are left out, so that rare words of a few positives are not
    learned by heart; words that mark other texts are too, so that a long text cannot outweigh its
    evidence.
    """
    pooled = (F.col("p") + F.col("u")) / (n + m)

    def gain(count: F.Column, total: int) -> F.Column:
        yes = F.when(count > 0, count * F.ln(count / (total * pooled))).otherwise(0.0)
        no = F.when(count < total, (total - count) * F.ln((total - count) / (total * (1 - pooled)))).otherwise(0.0)
        return 2 * (yes + no)

    rated = counts.where(F.col("p") / n > F.col("u") / m).withColumn("ratio", gain(F.col("p"), n) + gain(F.col("u"), m))
    return rated.where(F.col("ratio") >= least).orderBy(F.desc("ratio"), "word").limit(kept).select("word")


class _Rows:
    """Texts as rows of a sparse 0/1 matrix over the kept words."""

    def __init__(self, texts: list[np.ndarray], kept: np.ndarray):
        found = [np.searchsorted(kept, t) for t in texts]
        self.n = len(texts)
        self.row = np.repeat(np.arange(self.n), [len(f) for f in found])
        self.column = np.concatenate(found) if found else np.empty(0, int)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], self.n)

    def back(self, by_row: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, by_row[self.row], width)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], kept: np.ndarray, prior: float) -> Classifier:
    """Minimise the non-negative risk under logistic loss by Adam; the same input gives the same result.

    Texts are their kept words, distinct and sorted.
    """
    width = len(kept)
    p, u = _Rows(positive, kept), _Rows(unlabelled, kept)
    theta = np.zeros(width + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def slope(rows: _Rows, by_row: np.ndarray) -> np.ndarray:
        return np.append(rows.back(by_row / rows.n, width), by_row.mean())

    for step in range(1, STEPS + 1):
        xp, xu = p.dot(theta[:-1]) + theta[-1], u.dot(theta[:-1]) + theta[-1]
        as_positive = slope(p, -sigmoid(-xp)) * prior
        negative = np.logaddexp(0, xu).mean() - prior * np.logaddexp(0, xp).mean()
        as_negative = slope(u, sigmoid(xu)) - prior * slope(p, sigmoid(xp))
        gradient = as_positive + as_negative if negative >= 0 else -as_negative
        gradient[:-1] += RIDGE * theta[:-1]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Classifier(kept, theta[:-1], float(theta[-1]))


def smallest(ids: DataFrame, most: int) -> DataFrame:
    """The `most` ids(_id) of smallest hash, all if there are fewer.

    Ids far above the cut, by twice the share that is wanted, are left out before they are
    ordered, so that tasks send few rows however many there are.
    """
    n = ids.count()
    hashed = ids.withColumn("_h", F.xxhash64("_id"))
    if n > 4 * most:
        hashed = hashed.where(F.col("_h") < -(2**63) + int(2**64 * (2 * most / n)))
    return hashed.orderBy("_h", "_id").limit(most).drop("_h")


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifier:
    """Train from docs(doc_id, text) and labels(doc_id, toxic), both without held-out rows.

    A doc_id is toxic if any of its labels is. The ids of the sample are the smallest hashes, at
    most `positives` and `unlabelled` of them; of rows that share an id one is learned from, however many
    there are. Words are counted and chosen on the executors; the
    driver gets the kept words and, for each text of the sample, which of them it holds: at most KEPT
    numbers a text, however long it is. Without toxic or without other texts the classifier knows
    no words and scores the prior.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = marked.agg(F.count("*"), F.sum("toxic")).first()
    prior = float(np.clip((toxic or 0) / n if n else PRIOR[0], *PRIOR))
    known = marked.where("toxic = 1").select(F.col("doc_id").alias("_id"))
    ids = docs.select(F.col("doc_id").alias("_id")).where(F.col("_id").isNotNull())
    chosen = smallest(known, positives).withColumn("_p", F.lit(1)).unionByName(
        smallest(ids.join(known, "_id", "left_anti").distinct(), unlabelled).withColumn("_p", F.lit(0))
    )
    texts = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_p", "_id", "text")

    def work():
        kind = pa.list_(pa.int32())
        return lambda found: [pa.array([word_ids(t) for t in found], kind)]

    rows = materialize(map_texts(texts, ["_p", "_id"], "text", work, "words array<int>").withColumn("row", F.monotonically_increasing_id()), "toxic-words")
    first = rows.groupBy("_id").agg(F.min(F.struct(F.xxhash64("words"), "row")).alias("k")).select(F.col("k.row").alias("_row"))
    rows = rows.join(F.broadcast(first), F.col("row") == F.col("_row")).drop("_row")  # a number an id of the sample
    single = rows.select("_p", "row", F.explode("words").alias("word"))
    n, m = (rows.where(F.col("_p") == k).count() for k in (1, 0))
    if not n or not m:
        return Classifier(np.empty(0, np.int64), np.empty(0), float(np.log(prior / (1 - prior))))
    counts = single.groupBy("word").agg(F.sum("_p").alias("p"), F.sum(1 - F.col("_p")).alias("u"))
    chosen_words = [r.word for r in uneven(counts, n, m).collect()]  # KEPT at most
    words = single.join(F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in chosen_words], "_word int")), F.col("word") == F.col("_word"))
    held = words.groupBy("row", "_p").agg(F.sort_array(F.collect_list("word")).alias("words"))
    found = held.groupBy("_p", "words").agg(F.count("*").alias("n")).collect()  # KEPT numbers a text of the sample at most
    sets: list[list[np.ndarray]] = [[], []]
    for r in sorted(found, key=lambda r: (len(r.words), r.words)):
        sets[r._p] += [np.array(r.words, np.int64)] * r.n
    for k, size in ((1, n), (0, m)):  # texts without any kept word
        sets[k] = [np.empty(0, np.int64)] * (size - len(sets[k])) + sets[k]
    return train(sets[1], sets[0], np.sort(np.array(chosen_words, np.int64)), prior)


class _Weights(dict):
    """Weight of a word, by its hash; a full table is emptied."""

    def __init__(self, classifier: Classifier):
        super().__init__()
        self.known = dict(zip(classifier.ids.tolist(), classifier.weights.tolist()))

    def __missing__(self, word: str) -> float:
        if len(self) >= WORDS:
            self.clear()
        weight = self[word] = self.known.get(zlib.crc32(word.encode()) & ((1 << BITS) - 1), 0.0)
        return weight


def score(docs: DataFrame, classifier: Classifier, keep: list[str]) -> DataFrame:
    """docs(text, *keep) -> keep, score, predicted; one row per row, texts whole.

    Null and empty texts score by the bias alone. The classifier (KEPT words at most) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def work():
        weights, bias = _Weights(shared.value), shared.value.bias

        def do(texts: list[str | None]) -> list[pa.Array]:
            found = [sum(sorted(map(weights.__getitem__, set(FIND((t or "").lower()))))) for t in texts]
            scores = 1 / (1 + np.exp(-np.clip(np.array(found, float) + bias, -30, 30)))
            return [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]

        return do

    return map_texts(docs, keep, "text", work, "score double, predicted int")


def fold():
    """crc32 of the doc_id as text, modulo 5; null for a null doc_id, which is learned from nowhere."""
    return F.crc32(F.col("doc_id").cast("string")) % 5


def op4_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; one row per row, repeated rows and ids kept, other columns not read.

    Null and empty texts score by the bias. A null doc_id is not held out and teaches nothing, nor
    do labels without a document. Texts of any length are read whole; a word counts once. Without
    labels every score is the least prior. No documents: no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    classifier = fit(docs.select("doc_id", "text").where(fold() != 0), labels.where(fold() != 0))
    return score(docs, classifier, ["doc_id"]).select(
        "doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted"
    )


QUERIES = {"op4_positive_unlabelled": op4_positive_unlabelled}
ORACLE_SQL: dict[str, str] = {}
