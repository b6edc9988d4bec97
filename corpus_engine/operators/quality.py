"""Quality rules: findings per document, their distribution, comparisons before and after cleaning."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each rule counts, with its type and severity.
BRACKETS = (("(", ")"), ("[", "]"), ("{", "}"), ("【", "】"), ("（", "）"))
REPEATED, REPEATABLE = r"([!.，。？！,;:\\\-])\1+", "!.，。？！,;:\\-"
#: One by one: a class of single Latin-1 characters is looked up in a table, one of ranges is tried range by range.
CONTROL = f"[{''.join(f'\\x{c:02x}' for c in (*range(9), 11, 12, *range(14, 32), *range(127, 160)))}]"
WORD = r"[\p{L}\p{N}_]+"
ODD_CASE = r"^(?:[a-z]*[A-Z][a-z]*[A-Z][a-zA-Z]*|[A-Z]*[a-z][A-Z]*[a-z][a-zA-Z]*)$"
#: Words that may be odd: of Latin letters, with a small one, and two capitals in a row or case that changes often. Other words are
#: passed over as a whole and leave the group empty, so no place within a word is tried.
MIXED_WORD = (
    r"((?=[A-Za-z]*[a-z])(?=[A-Za-z]*(?:[A-Z][A-Z]|[a-z][A-Z]+[a-z]+[A-Z]+[a-z]))[A-Za-z]+(?![\p{L}\p{N}_]))|[\p{L}\p{N}_]++"
)
#: Each symbol of a line behind ten newlines: up to ten characters before it, and after it.
SYMBOL, SYMBOLS, BEFORE = r"(?s)(?=(.{10}[&@#].{0,10})).", "&@#", 10
URL_LINE, MAIL_LINE = r"^https?://", r"^[\w.-]+@[\w.-]+\.\w+$"
RULES = {
    "spaces": ("format", "low"), "newlines": ("format", "low"), "odd_case": ("case", "medium"), "repeated": ("punctuation", "low"),
    "symbols": ("symbol", "medium"), "controls": ("format", "high"), "brackets": ("format", "medium"),
}


def odd_case(text: Column) -> Column:
    """Words of mixed case that are neither camelCase nor PascalCase."""
    def odd(word: Column) -> Column:
        runs = F.regexp_count(word, F.lit("[A-Z]+|[a-z]+"))
        capitals = F.length(F.regexp_replace(word, "[^A-Z]", ""))
        pair = word.rlike("[A-Z][A-Z]")
        mixed = word.rlike("[a-z]") & word.rlike("[A-Z]")
        return mixed & ((runs - 1 > 4) | (word.rlike("^[a-z]") & pair) | (word.rlike("^[A-Z]") & pair & (capitals > 4)))

    words = F.filter(F.regexp_extract_all(text, F.lit(MIXED_WORD), F.lit(1)), lambda w: (w != "") & w.rlike(ODD_CASE) & odd(w))
    return F.when(text.rlike("[A-Za-z][A-Z]"), F.size(words)).otherwise(0)


def holds(text: Column, *parts: str) -> Column:
    """Whether text holds any of the parts: a plain search, far cheaper than a pattern, which then runs on few texts."""
    return reduce(or_, (F.contains(text, F.lit(p)) for p in parts))


def unmatched(text: Column, open_: str, close: str) -> Column:
    """Closing brackets without an opening one, and opening ones that stay open. Of one kind alone all are, so they are only counted."""
    marks = F.regexp_extract_all(text, F.lit(f"[\\{open_}\\{close}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("lost"))

    def step(s: Column, c: Column) -> Column:
        opens = c == open_
        return F.struct(
            F.when(opens, s["open"] + 1).otherwise(F.greatest(s["open"] - 1, F.lit(0))).alias("open"),
            F.when(~opens & (s["open"] == 0), s["lost"] + 1).otherwise(s["lost"]).alias("lost"),
        )

    alone = lambda mark: F.when(holds(text, mark), F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))).otherwise(0)
    both = holds(text, open_) & holds(text, close)
    return F.when(both, F.aggregate(marks, start, step, lambda s: s["open"] + s["lost"])).otherwise(alone(open_) + alone(close))


def symbols(text: Column) -> Column:
    """& @ # outside of lines that are URLs or mail addresses, and of such places within lines."""
    def counts(padded: Column) -> Column:
        symbol, context = F.substring(padded, BEFORE + 1, 1), F.ltrim(padded, F.lit("\n"))
        url = F.regexp_extract(context, r"https?://\S*", 0)
        return ~url.contains(symbol) & ~context.rlike(r"^[\w.-]*@")

    def in_line(line: Column) -> Column:
        skip = F.trim(line).rlike(URL_LINE) | F.trim(line).rlike(MAIL_LINE)
        places = F.regexp_extract_all(F.concat(F.lit("\n" * BEFORE), line), F.lit(SYMBOL), F.lit(1))
        return F.when(skip, 0).otherwise(F.size(F.filter(places, counts)))

    marked = F.filter(F.split(text, "\n"), lambda line: holds(line, *SYMBOLS))
    return F.when(holds(text, *SYMBOLS), F.aggregate(F.transform(marked, in_line), F.lit(0), lambda s, n: s + n)).otherwise(0)


def rule_counts(text: Column) -> dict[str, Column]:
    """The findings of each rule. Patterns run where a plain search found what a finding needs; no text is taken apart by character."""
    count = lambda pattern, *parts: F.when(holds(text, *parts), F.regexp_count(text, F.lit(pattern))).otherwise(0)
    return {
        "spaces": count(" {3,}", " " * 3),
        "newlines": count("\n{3,}", "\n" * 3),
        "odd_case": odd_case(text),
        "repeated": count(REPEATED, *(m * 2 for m in REPEATABLE)),
        "symbols": symbols(text),
        "controls": F.regexp_count(text, F.lit(CONTROL)),
        "brackets": sum((unmatched(text, x, y) for x, y in BRACKETS), F.lit(0)),
    }


def quality_findings(df: DataFrame, rules: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """df(doc_id, text) -> doc_id, rule, error_type, severity, findings: one row for each rule with findings."""
    counts = rule_counts(F.coalesce(F.col("text"), F.lit("")))
    rows = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(RULES[r][0]).alias("error_type"), F.lit(RULES[r][1]).alias("severity"), counts[r].cast("long").alias("findings"))
        for r in rules
    ])
    return df.select("doc_id", F.inline(rows)).where("findings > 0")


def error_distribution(findings: DataFrame) -> DataFrame:
    """Findings by type, of each document and of all (doc_id null)."""
    by = findings.groupingSets([("doc_id", "error_type"), ("error_type",)], "doc_id", "error_type")
    return by.agg(F.sum("findings").alias("findings"))


def compare_before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings of each type before and after, how many fewer, and by how many per cent."""
    b = before.groupBy("error_type").agg(F.sum("findings").alias("before"))
    a = after.groupBy(F.col("error_type").alias("_t")).agg(F.sum("findings").alias("after"))
    met = b.join(a, F.col("error_type") == F.col("_t"), "full").select(
        F.coalesce("error_type", "_t").alias("error_type"), F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after")
    )
    fewer = F.col("before") - F.col("after")
    rate = F.when(F.col("before") > 0, F.round(fewer / F.col("before") * 100, 2)).otherwise(0.0)
    return met.withColumns({"errors_reduced": fewer, "reduction_rate": rate})


def _odd_word(word: str) -> bool:
    import re

    if not re.fullmatch(ODD_CASE[1:-1], word) or not re.search("[a-z]", word) or not re.search("[A-Z]", word):
        return False
    pair, capitals = re.search("[A-Z][A-Z]", word), sum(c.isupper() for c in word)
    return len(re.findall("[A-Z]+|[a-z]+", word)) > 5 or bool(pair and (word[0].islower() or capitals > 4))


def _symbol_places(text: str) -> Iterator[int]:
    import re

    at = 0
    for line in text.split("\n"):
        bare = line.strip(" ")
        if not re.match(URL_LINE, bare) and not re.fullmatch(MAIL_LINE[1:-1], bare, re.ASCII):
            for m in re.finditer("[&@#]", line):
                context = line[max(m.start() - 10, 0) : m.start() + 11]
                url = re.search(r"https?://\S*", context, re.ASCII)
                if not (url and m[0] in url[0]) and not re.match(r"[\w.-]*@", context, re.ASCII):
                    yield at + m.start()
        at += len(line) + 1


def _bracket_places(text: str) -> Iterator[int]:
    for open_, close in BRACKETS:
        held = []
        for at, c in enumerate(text):
            if c == open_:
                held.append(at)
            elif c == close:
                if held:
                    held.pop()
                else:
                    yield at
        yield from held


def places_of(text: str, rules: tuple[str, ...] = tuple(RULES)) -> Iterator[tuple[str, int, int]]:
    """(rule, position, length) of every finding of a text, as many as quality_findings counts; positions are code points from 0."""
    import re

    for name, pattern in (("spaces", " {3,}"), ("newlines", "\n{3,}"), ("repeated", REPEATED), ("controls", CONTROL)):
        if name in rules:
            yield from ((name, m.start(), m.end() - m.start()) for m in re.finditer(pattern, text))
    if "odd_case" in rules:
        for m in re.finditer("[A-Za-z]+", text):
            edges = text[m.start() - 1 : m.start()] + text[m.end() : m.end() + 1]
            if not any(c.isalnum() or c == "_" for c in edges) and _odd_word(m[0]):
                yield "odd_case", m.start(), m.end() - m.start()
    for name, places in (("symbols", _symbol_places), ("brackets", _bracket_places)):
        if name in rules:
            yield from ((name, at, 1) for at in places(text))


def finding_positions(df: DataFrame) -> DataFrame:
    """df(doc_id, text) -> doc_id, rule, position, length of every finding of every rule; see places_of."""
    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(doc_id, *place) for doc_id, text in zip(part["doc_id"], part["text"]) for place in places_of(text or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "rule", "position", "length"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, rule string, position int, length int")
