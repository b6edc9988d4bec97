"""Rules as tables: a rule a row, so that a rule set is data and may hold thousands of literals.

Patterns, and literals while they are few, become column expressions. More literals go into
automata that are broadcast and find all of them in one pass over a text, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.functions.rules import Rule, rule_score
from corpus_engine.shared import ship

RULES = "label string, name string, kind string, pattern string, weight double, cap int, field string, density double, bonus double"
#: Literals that are made into expressions; patterns at most; characters of literals in one automaton (about 100 bytes each).
FEW, PATTERNS, LETTERS = 200, 500, 2_000_000
KINDS = ("word", "regex")


def rule_table(spark, rules: tuple[Rule, ...]) -> DataFrame:
    """Rules of the library as a table."""
    return spark.createDataFrame([(r.label, r.name, r.kind, r.pattern, r.weight, r.cap, r.field, r.density, r.bonus) for r in rules], RULES)


def _as_rule(row) -> Rule:
    return Rule(row.label, row.name or "", row.kind, row.pattern, row.weight, row.cap, row.field or "text", row.density, row.bonus or 0.0)


def checked(rules: DataFrame) -> DataFrame:
    """The usable rows: a label, a known kind, a pattern that is not empty and a weight. Others are passed over."""
    fine = F.col("label").isNotNull() & F.col("kind").isin(*KINDS) & (F.length("pattern") > 0) & F.col("weight").isNotNull()
    return rules.where(fine)


def _slices(literals: list, most: int) -> Iterator[list]:
    held, size = [], 0
    for row in literals:
        if held and size + len(row.pattern) > most:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row.pattern)
    if held:
        yield held


@cache
def _automaton(shared):
    """One automaton a worker and broadcast: pattern -> the sums it adds to the labels."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for pattern, weights in shared.value.items():
        made.add_word(pattern, (pattern, weights))
    made.make_automaton()
    return made


def _scored_by_automaton(files: DataFrame, field: str, literals: list, labels: list[str], out: str) -> DataFrame:
    """files with the array `out`: for each label the weights of the literals that the field holds, each once."""
    spark = files.sparkSession
    table: dict[str, list[float]] = {}
    for row in literals:
        weights = table.setdefault(row.pattern, [0.0] * len(labels))
        weights[labels.index(row.label)] += row.weight
    shared = spark.sparkContext.broadcast(table)  # LETTERS characters at most
    n = len(labels)

    @F.pandas_udf("array<double>")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(shared)
        for batch in texts:
            found = []
            for text in batch:
                seen: dict[str, list[float]] = {pattern: weights for _, (pattern, weights) in automaton.iter(text or "")}
                found.append([float(sum(w[i] for w in seen.values())) for i in range(n)])
            yield pd.Series(found)

    return files.withColumn(out, score(F.col(field)))


def classify_by_table(files: DataFrame, rules: DataFrame, default: str, few: int = FEW, letters: int = LETTERS) -> DataFrame:
    """rules.classify_documents with rules(RULES) from a table: files with doc_type, confidence and a score of each label.

    The rules are counted before they are gathered: more than PATTERNS patterns are refused. Literals beyond
    `few` go by automata of `letters` characters each, one after the other, so any number is served. Scores
    are sums in the order of labels, names and patterns.
    """
    ship(files.sparkSession)
    usable = checked(rules)
    counts = {r.kind: r["count"] for r in usable.groupBy("kind").count().collect()}  # a row a kind
    if counts.get("regex", 0) > PATTERNS:
        raise ValueError(f"{counts['regex']} patterns: at most {PATTERNS} can be made into expressions")
    rows = usable.orderBy("label", "name", "pattern", "weight").toArrow().to_pylist()
    found = [_as_rule(type("Row", (), r)) for r in rows]
    labels = sorted({r.label for r in found})
    if not labels:
        return files.withColumns({"doc_type": F.lit(default), "confidence": F.lit(0.0)})
    words = [r for r in found if r.kind == "word"]
    compiled = [r for r in found if r.kind == "regex" or len(words) <= few]
    scored, sums = files, {label: F.lit(0.0) for label in labels}
    for rule in compiled:
        sums[rule.label] = sums[rule.label] + rule_score(rule)
    made = []
    if len(words) > few:
        for field in sorted({r.field for r in words}):
            for number, part in enumerate(_slices([r for r in words if r.field == field], letters)):
                made.append(f"_words_{field}_{number}")
                scored = _scored_by_automaton(scored, field, part, labels, made[-1])
        for i, label in enumerate(labels):
            for name in made:
                sums[label] = sums[label] + F.get(F.col(name), F.lit(i))
    scored = scored.withColumns({f"{label}_score": total for label, total in sums.items()}).drop(*made)
    columns = [F.col(f"{label}_score") for label in labels]
    every, best = sum(columns, F.lit(0.0)), F.greatest(*columns) if len(columns) > 1 else columns[0]
    winner = F.lit(default)
    for label, own in zip(labels, columns):
        wins = F.lit(True)
        for other in columns:
            if other is not own:
                wins &= own > other
        winner = F.when(wins & (own > 0), F.lit(label)).otherwise(winner)
    return scored.withColumns({"doc_type": winner, "confidence": F.when(every > 0, F.round(best / every, 6)).otherwise(0.0)})
