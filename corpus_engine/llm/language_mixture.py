"""Operator 7: language identification by multilingual mixture inference.

Trigram likelihoods per language are learned from labelled documents. A document is cut into
short windows; expectation-maximisation finds the proportions of languages under which its
windows are likeliest, and languages are added to its set while the gain in likelihood exceeds
a penalty. The prediction is the language of the largest proportion.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpus_engine.llm.batches import map_texts

#: Bits of a hashed trigram, letters of a window, pseudo-count of a trigram.
BITS, WINDOW, ALPHA = 16, 24, 0.1
#: Code points of a text that are trigrams at once; what stands for other characters than letters.
PIECE, BLANK = 1 << 20, 32
#: Most documents a language is learned from: the smallest hashes of doc_id.
SAMPLE = 1500
#: Steps of expectation-maximisation; factor of the penalty for one more language (BIC: 1).
STEPS, PENALTY = 12, 2.0
#: How far from the level of strange text to that of its own a language asks text to be.
OWN = 0.4
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def trigrams(text: str, piece: int = PIECE) -> Iterator[np.ndarray]:
    """Hashed trigrams of a lower-cased text, by pieces of the text.

    Every run of other characters is one blank, and one stands at either end. Texts without a
    letter give nothing.
    """
    low = text.lower()
    held, after_letter = np.array([BLANK], np.uint32), False
    for at in range(0, len(low), piece):
        points = np.frombuffer(low[at : at + piece].encode("utf-32-le", "replace"), "<u4")
        letter = letters()[points]
        kept = letter.copy()
        kept[1:] |= letter[:-1]
        kept[0] |= after_letter
        after_letter = bool(letter[-1])
        held = np.concatenate((held, np.where(letter, points, BLANK)[kept].astype(np.uint32)))
        if at + piece >= len(low) and len(held) > 1 and after_letter:
            held = np.append(held, np.uint32(BLANK))
        if len(held) > 2:
            mixed = held[:-2] * np.uint32(0x9E3779B1) + held[1:-1] * np.uint32(0x85EBCA77) + held[2:] * np.uint32(0xC2B2AE3D)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            yield (mixed >> np.uint32(32 - BITS)).astype(np.uint16)
            held = held[-2:]


def windows_of(text: str | None, table: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihoods of the text's windows under each language, trigrams in each window).

    Only one piece of the text is held as trigrams at once; windows run on over pieces.
    """
    if not text or not table.shape[1]:
        return np.empty((0, table.shape[1])), np.empty(0, np.int64)
    sums, rest = [], np.empty(0, np.uint16)
    for grams in trigrams(text, piece):
        grams = np.concatenate((rest, grams)) if len(rest) else grams
        whole = len(grams) // WINDOW * WINDOW
        if whole:
            sums.append(np.add.reduceat(table[grams[:whole]], np.arange(0, whole, WINDOW), axis=0).astype(np.float64))
        rest = grams[whole:]
    sizes = np.full(sum(map(len, sums)) + bool(len(rest)), WINDOW)
    if len(rest):
        sums.append(table[rest].sum(0, keepdims=True).astype(np.float64))
        sizes[-1] = len(rest)
    return (np.concatenate(sums) if sums else np.empty((0, table.shape[1]))), sizes


def mixture(likelihood: np.ndarray, chosen: list[int]) -> tuple[np.ndarray, float]:
    """Proportions of the chosen columns and the log-likelihood, from windows' log-likelihoods."""
    part = likelihood[:, chosen]
    top = part.max(1, keepdims=True)
    ratio = np.exp(part - top)
    share = np.full(len(chosen), 1 / len(chosen))
    for _ in range(STEPS if len(chosen) > 1 else 0):
        weighted = ratio * share
        share = (weighted / weighted.sum(1, keepdims=True)).mean(0)
    return share, float(np.log(ratio @ share).sum() + top.sum())


def fitting(windows: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> float:
    """The share of a text in windows that are as likely as text of a learned language, all languages together."""
    if not len(sizes):
        return 0.0
    return float(sizes[(windows / sizes[:, None] >= least).any(1)].sum() / sizes.sum())


def infer(windows: np.ndarray) -> tuple[int, float, list[tuple[int, float]]]:
    """(language or -1, score, proportions) of a text, from its windows' log-likelihoods.

    Languages join the set one by one, the one that adds most likelihood first, while it adds more
    than the penalty. A language is tried only if it can: no mixture is likelier in a window than
    its likeliest language, so one whose windows do not raise that sum by the penalty cannot. Score:
    the language's proportion times its chance to be the right one of the single languages, so
    short or strange texts score low. Ties go to the first language.
    """
    if not len(windows):
        return -1, 0.0, []
    total = windows.sum(0)
    chosen = [int(total.argmax())]
    share, best = np.ones(1), float(total.max())
    penalty = PENALTY * (math.log(len(windows)) + 1)
    while len(chosen) < windows.shape[1]:
        held = windows[:, chosen].max(1)
        rivals = [k for k in range(windows.shape[1]) if k not in chosen and float(np.maximum(windows[:, k], held).sum()) - best > penalty]
        found = [(mixture(windows, [*chosen, k]), k) for k in rivals]
        if not found:
            break
        (new_share, new), k = max(found, key=lambda x: (x[0][1], -x[1]))
        if new - best <= penalty:
            break
        chosen, share, best = [*chosen, k], new_share, new
    first = max(range(len(chosen)), key=lambda i: (share[i], -chosen[i]))
    language = chosen[first]
    others = total[[k for k in range(len(total)) if k not in chosen]] - total[chosen[0]]
    sure = 1 / (1 + float(np.exp(others).sum()))
    return language, float(share[first]) * sure, sorted(zip(chosen, map(float, share)))


class LanguageModel:
    """Names of languages, the log-likelihood of each hashed trigram under each of them, and the least
    log-likelihood a trigram of text that fits each of them."""

    def __init__(self, languages: list[str], table: np.ndarray, least: np.ndarray):
        self.languages, self.table, self.least = languages, table, least


def levels(counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each language the log-likelihood a trigram that lies OWN of the way from strange texts to its own.

    Its own: the labelled texts, each trigram judged without itself. Strange: the nearest other
    language's texts under its table, or, if that is likelier, any trigram by chance.
    """
    total = np.maximum(counts.sum(0), 1)
    without = np.log((np.maximum(counts - 1, 0) + ALPHA) / (total - 1 + ALPHA * len(counts)))
    own = (counts * without).sum(0) / total
    others = counts.T @ table / total[:, None]  # [texts of, under the table of]
    np.fill_diagonal(others, -math.log(len(counts)))
    strange = np.maximum(others.max(0), -math.log(len(counts)))
    return strange + OWN * (own - strange)


def sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """labelled(doc_id, lang) -> _id, _lang: the `sample` ids of each language with the smallest hashes.

    Ids far above the cut, by twice the share that is wanted, are left out before they are told
    apart and ordered, so no task orders more than about twice the sample of a language.
    """
    ids = labelled.select("doc_id", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    ids = ids.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.xxhash64("doc_id").alias("_h"))
    sizes = ids.groupBy("_lang").agg(F.approx_count_distinct("_id", 0.02).alias("_n")).withColumnRenamed("_lang", "_of")
    # sizes: a row a language, of which the model holds 2**BITS numbers
    cut = F.when(F.col("_n") > 4 * sample, F.lit(2.0**64) * (2 * sample / F.col("_n")) - 2.0**63).otherwise(F.lit(2.0**63))
    near = ids.join(F.broadcast(sizes), F.col("_lang") == F.col("_of")).where(F.col("_h") <= cut).select("_lang", "_h", "_id").distinct()
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_id"))
    return near.withColumn("_r", rank).where(F.col("_r") <= sample).select("_id", "_lang")


def fit(labelled: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Learn from labelled(doc_id, text, lang) without null lang; any of its rows may be used.

    The sample is bounded by `sample` documents a language. Counts are summed on the executors;
    the driver gets at most 2**BITS rows a language. No rows: a model without languages.
    """
    picked = sampled(labelled, sample)
    texts = labelled.join(F.broadcast(picked), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))

    counted = map_texts(texts, ["lang"], "text", lambda: _counted, "grams array<int>, counts array<int>")
    pairs = counted.select("lang", F.explode(F.arrays_zip("grams", "counts")).alias("g"))
    sums = pairs.groupBy("lang", F.col("g.grams").alias("gram")).agg(F.sum("g.counts").alias("n")).toArrow()
    languages = sorted(set(sums.column("lang").to_pylist()))
    table = np.zeros((1 << BITS, len(languages)))
    place = {name: k for k, name in enumerate(languages)}
    if languages:
        columns = np.array([place[name] for name in sums.column("lang").to_pylist()])
        table[sums.column("gram").to_numpy(), columns] = sums.column("n").to_numpy()
        counts, table = table, np.log((table + ALPHA) / (table.sum(0) + ALPHA * len(table)))
    least = levels(counts, table) if languages else np.empty(0)
    return LanguageModel(languages, table.astype(np.float32), least.astype(np.float32))


def _counted(texts: list[str | None]) -> list[pa.Array]:
    found = []
    for text in texts:
        counts = np.zeros(1 << BITS, np.int64)
        for grams in trigrams(text or ""):
            counts += np.bincount(grams, minlength=1 << BITS)
        seen = np.flatnonzero(counts)
        found.append((seen.astype(np.int32), counts[seen].astype(np.int32)))
    kind = pa.list_(pa.int32())
    return [pa.array([g for g, _ in found], kind), pa.array([n for _, n in found], kind)]


def predict(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """docs(text, *keep) -> keep, lang_pred, score, languages map<string, double>, fit; one row per row.

    fit: the share of the text that is as likely as text of the learned languages, see fitting().
    Null text, or none with a letter: `und`, score 0, no languages and fit 0; so it is for every text if
    the model has none. The model is broadcast: 4 * 2**BITS bytes a language.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.least))

    def work():
        model = LanguageModel(*shared.value)
        languages, table = model.languages, model.table

        def do(texts: list[str | None]) -> list[pa.Array]:
            found, fits = [], []
            for text in texts:
                windows, sizes = windows_of(text, table)
                found.append(infer(windows))
                fits.append(fitting(windows, sizes, model.least))
            return [
                pa.array([languages[k] if k >= 0 else UNKNOWN for k, _, _ in found], pa.string()),
                pa.array([score for _, score, _ in found], pa.float64()),
                pa.array(
                    [[(languages[k], share) for k, share in shares] for _, _, shares in found],
                    pa.map_(pa.string(), pa.float64()),
                ),
                pa.array(fits, pa.float64()),
            ]

        return do

    return map_texts(docs, keep, "text", work, "lang_pred string, score double, languages map<string,double>, fit double")


def fold(modulus: int):
    """crc32 of the doc_id as text, modulo; null for a null doc_id, which is learned from nowhere."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def learned(docs: DataFrame) -> LanguageModel:
    return fit(docs.where((fold(4) != 2) & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; one row per row, repeated rows and ids kept, other columns not read.

    Null, empty and letterless texts: `und`, score 0. A null doc_id is not held out and teaches
    nothing. Texts of any length are read whole, by pieces. Ties go to the first language by
    name. No labelled documents: `und` for all. No documents: no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learned(docs)
    return predict(docs, model, ["doc_id"]).select(
        "doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


QUERIES = {"op7_language_mixture": op7_language_mixture}
ORACLE_SQL: dict[str, str] = {}
