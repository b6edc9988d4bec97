"""Findings that are much like each other, as a join: of each run of likenesses the first stays.

Two descriptions are alike if the sequence ratio, twice their matching characters over both lengths, is
above a bound. The ratio cannot exceed what the lengths allow, nor what the counts of characters
allow. So characters, numbered as they repeat, are ordered from rare to frequent; alike descriptions share one of
the first of them. Only pairs that share one, and whose lengths and counts allow it, are compared.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_engine.functions.text import characters
from corpus_engine.shared import materialize


@F.pandas_udf(T.DoubleType())
def sequence_ratio(later: pd.Series, earlier: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(later, earlier)], dtype=float)


def numbered_characters(text: Column) -> Column:
    """Each character with its number among its like: two such arrays share as many as the texts have in common."""
    found = F.array_sort(characters(text))
    first = lambda c, i: i - F.array_position(found, c) + 1
    return F.transform(found, lambda c, i: F.concat(c, F.lit("#"), first(c, i).cast("string")))


def alike(rows: DataFrame, ratio: float) -> DataFrame:
    """rows(row, group, d): pairs (later, earlier) of rows of a group with d in that order and a ratio above `ratio`."""
    least = ratio / (2 - ratio)  # of the shorter to the longer, and of common characters to the longer
    sets = materialize(rows.select("row", "group", "d", numbered_characters(F.col("d")).alias("c")).withColumn("n", F.size("c")), "characters")
    single = sets.select("row", "group", "n", F.explode("c").alias("ch"))
    rarity = single.groupBy("group", "ch").agg(F.count("*").alias("often")).select(F.col("group").alias("_g"), F.col("ch").alias("_ch"), "often")
    own = Window.partitionBy("row").orderBy("often", "ch")
    ranked = single.join(rarity, (F.col("group") == F.col("_g")) & (F.col("ch") == F.col("_ch"))).withColumn("k", F.row_number().over(own))
    prefix = materialize(ranked.where(F.col("k") <= F.col("n") - F.ceil(F.lit(least - 1e-9) * F.col("n")) + 1).select("row", "group", "ch", "n"), "prefixes")
    other = prefix.select(F.col("row").alias("_row"), F.col("group").alias("_g"), F.col("ch").alias("_ch"), F.col("n").alias("_n"))
    near = (F.col("group") == F.col("_g")) & (F.col("ch") == F.col("_ch")) & (F.col("_row") < F.col("row"))
    near &= (F.least("n", "_n") >= F.lit(least - 1e-9) * F.greatest("n", "_n"))
    met = prefix.join(other, near).select("row", "_row").distinct()
    left, right = sets.select("row", "d", "c", "n"), sets.select(F.col("row").alias("_row"), F.col("d").alias("_d"), F.col("c").alias("_c"), F.col("n").alias("_n"))
    pairs = met.join(left, "row").join(right, "_row")
    common = F.size(F.array_intersect("c", "_c"))
    pairs = pairs.where(2 * common > F.lit(ratio - 1e-9) * (F.col("n") + F.col("_n")))
    later = F.col("d") > F.col("_d")  # earlier is what comes first in the order of descriptions
    ends = lambda a, b: F.when(later, F.col(a)).otherwise(F.col(b))
    placed = pairs.select(ends("row", "_row").alias("later"), ends("_row", "row").alias("earlier"), ends("d", "_d").alias("a"), ends("_d", "d").alias("b"))
    return placed.where(sequence_ratio("a", "b") > ratio).select("later", "earlier")


def first_of_alike(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows(row), pairs(later, earlier) -> row: taken in order, those with no pair to one that was taken before.

    By rounds: what is paired with a row that is taken goes, what has no pairs left is taken. There are as
    many rounds as the longest chain of pairs.
    """
    pairs = materialize(pairs, "alike")
    taken = materialize(rows.select("row").join(pairs.select(F.col("later").alias("row")), "row", "left_anti"), "taken")
    found = [taken]
    while not pairs.isEmpty():
        gone = materialize(pairs.join(taken.withColumnRenamed("row", "earlier"), "earlier", "left_semi").select("later").distinct(), "gone")
        left = pairs.join(gone, "later", "left_anti").join(gone.withColumnRenamed("later", "earlier"), "earlier", "left_anti")
        left = materialize(left.select("later", "earlier"), "alike")
        open_ = pairs.select(F.col("later").alias("row")).distinct()
        decided = open_.join(gone.withColumnRenamed("later", "row"), "row", "left_anti")
        taken = materialize(decided.join(left.select(F.col("later").alias("row")), "row", "left_anti"), "taken")
        found.append(taken)
        pairs = left
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def distinct_findings(findings: DataFrame, ratio: float = 0.8) -> DataFrame:
    """findings(doc_id, error_type, description, severity): of much alike ones of a document and type the first stays.

    First by description, then severity. Alike: the sequence ratio of the later to the earlier is above
    `ratio`. Findings of equal description are alike; a null description counts as empty.
    """
    d = F.coalesce("description", F.lit(""))
    keyed = findings.select("doc_id", "error_type", "description", "severity", d.alias("d"))
    first = F.min(F.struct("severity", "description")).alias("f")
    one = keyed.groupBy("doc_id", "error_type", "d").agg(first).select("doc_id", "error_type", F.col("f.description").alias("description"), F.col("f.severity").alias("severity"), "d")
    one = materialize(one.withColumn("row", F.monotonically_increasing_id()), "findings")
    group = F.struct(F.col("doc_id"), F.col("error_type"))
    rows = one.select("row", F.to_json(group, {"ignoreNullFields": "false"}).alias("group"), "d")
    kept = first_of_alike(rows, alike(rows.where("d <> ''"), ratio))
    return one.join(kept, "row", "left_semi").select("doc_id", "error_type", "description", "severity")
