"""Column functions on text: cleaning steps, tokens, similarities, hash vectors.

All stay in the JVM but the two steps that no built-in function has (NFC, long-year slash dates
are built-in; NFC is an Arrow UDF).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns and replacements that the cleaning results depend on.
SPACE_ENDS = r"(?U)^\s+|\s+$"
TAGS = "<[^>]*>"
#: One by one: a class of single Latin-1 characters is looked up in a table, one of ranges is tried range by range.
CONTROLS = f"[{''.join(f'\\x{c:02X}' for c in (*range(9), 11, 12, *range(14, 32), 127))}]"
NOT_ALLOWED = r"(?U)[^\p{L}\p{N}_\s.,!?;:，。！？；：一-鿿]"
HALF_WIDTH, FULL_WIDTH = ",.!?;:", "，。！？；："
PERSONAL = (
    r"\b\d{17}[\dXx]\b",
    r"\b\d{15}\b",
    r"\b1[3-9]\d{9}\b",
    r"\b1[3-9]\d-\d{4}-\d{4}\b",
    r"\b1[3-9]\d{2}-\d{4}-\d{4}\b",
)
MASK = "***"
#: (?U)\s+, of which the characters of Latin-1 are looked up, and few others are asked for their kind.
RUNS_OF_SPACE = r"(?U)[\t\n\x0B\f\r \x85\xA0[\u1680-\u3000&&[\s]]]+"
LATIN_TOKEN = r"[\p{L}\p{N}&&[^一-鿿]]{2,}"
HAN_PAIR = r"(?=([一-鿿]{2}))"


def strip(text: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.regexp_replace(text, SPACE_ENDS, "")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAGS, "")


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, "")


def keep_allowed(text: Column) -> Column:
    """Letters, digits, white space, the listed punctuation and Han characters only."""
    return F.regexp_replace(text, NOT_ALLOWED, "")


def cn_date(text: Column) -> Column:
    """YYYY年M月D日 -> YYYY-MM-DD: one-digit months and days are filled up first."""
    text = F.regexp_replace(text, r"(\d{4})年(\d)月(\d{1,2})日", "$1年0$2月$3日")
    text = F.regexp_replace(text, r"(\d{4})年(\d{2})月(\d)日", "$1年$2月0$3日")
    return F.regexp_replace(text, r"(\d{4})年(\d{2})月(\d{2})日", "$1-$2-$3")


def slash_date(text: Column) -> Column:
    """D/M/Y -> Y-MM-DD. Years below 50 are 20xx, other years below 100 are 19xx.

    Dates are marked first, longest years first, then rewritten width by width; the marks are
    private-use characters, which cleaned text does not hold.
    """
    open_, close = "", ""
    text = F.regexp_replace(text, r"(\d{1,2})/(\d{1,2})/(\d{2,4})", f"{open_}0$1/0$2/$3{close}")
    text = F.regexp_replace(text, f"{open_}0(\\d\\d)/", f"{open_}$1/")
    text = F.regexp_replace(text, f"{open_}(\\d\\d)/0(\\d\\d)/", f"{open_}$1/$2/")
    day = f"{open_}(\\d\\d)/(\\d\\d)/"
    text = F.regexp_replace(text, f"{day}([0-4]\\d){close}", "20$3-$2-$1")
    text = F.regexp_replace(text, f"{day}([5-9]\\d){close}", "19$3-$2-$1")
    text = F.regexp_replace(text, f"{day}0([0-4]\\d){close}", "20$3-$2-$1")
    text = F.regexp_replace(text, f"{day}0([5-9]\\d){close}", "19$3-$2-$1")
    text = F.regexp_replace(text, f"{day}00([0-4]\\d){close}", "20$3-$2-$1")
    text = F.regexp_replace(text, f"{day}00([5-9]\\d){close}", "19$3-$2-$1")
    text = F.regexp_replace(text, f"{day}0(\\d{{3}}){close}", "$3-$2-$1")
    return F.regexp_replace(text, f"{day}(\\d{{3,4}}){close}", "$3-$2-$1")


def full_width(text: Column) -> Column:
    return F.translate(text, HALF_WIDTH, FULL_WIDTH)


def mask_personal(text: Column) -> Column:
    """Identity and phone numbers, whole words only, become ***."""
    for pattern in PERSONAL:
        text = F.regexp_replace(text, pattern, MASK)
    return text


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, RUNS_OF_SPACE, " ")


#: The order the reference results come from, and the default: dates and numbers before the filter.
REFERENCE_ORDER: tuple[Callable[[Column], Column], ...] = (
    strip, nfc, strip_tags, strip_control, keep_allowed, cn_date, slash_date, full_width, mask_personal, collapse_space,
)
DEFAULT_STEPS: tuple[Callable[[Column], Column], ...] = (
    strip, nfc, strip_tags, strip_control, cn_date, slash_date, mask_personal, keep_allowed, full_width, collapse_space,
)


def clean_corpus(
    df: DataFrame, text: str = "text", steps: Sequence[Callable[[Column], Column]] = DEFAULT_STEPS, source: str | None = None
) -> DataFrame:
    """Clean the text column by the steps in order. Rows whose `source` ends in .md stay as they are."""
    cleaned = F.col(text)
    for step in steps:
        cleaned = step(cleaned)
    if source is None:
        return df.withColumn(text, cleaned)
    kept = F.coalesce(F.lower(source).endswith(".md"), F.lit(False))
    return df.withColumns({
        text: F.when(kept, F.col(text)).otherwise(cleaned),
        "preprocessed_by": F.when(kept, F.lit("skipped_high_quality_md")).otherwise(F.lit("rules")),
        "high_quality_source": kept,
    })


def tokenize(text: Column) -> Column:
    """Lower-case tokens of two characters and more; runs of Han characters give their bigrams."""
    low = F.lower(F.coalesce(text, F.lit("")))
    latin = F.regexp_extract_all(low, F.lit(LATIN_TOKEN), F.lit(0))
    pairs = F.regexp_extract_all(low, F.lit(HAN_PAIR), F.lit(1))  # looks ahead only, so pairs overlap
    return F.concat(latin, pairs)


def estimate_tokens(text: Column) -> Column:
    length = F.length(text)
    return F.when(F.coalesce(length, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(length / 2))).cast("int")


def estimate_agent_tokens(characters: Column) -> Column:
    return F.floor(characters / F.lit(1.5)).cast("long")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays; 0 if either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / either)


def char_jaccard(a: Column, b: Column) -> Column:
    return jaccard(characters(a), characters(b))


# Chinese digits and units.
CN_DIGITS = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CN_UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000}


def cn_to_int(text: Column) -> Column:
    """Chinese numerals or digits as a number; null if unparsable, and for numerals that give zero."""
    digits = F.create_map(*[F.lit(x) for pair in CN_DIGITS.items() for x in pair])
    units = F.create_map(*[F.lit(x) for pair in CN_UNITS.items() for x in pair])
    trimmed = strip(text)

    def read(state: Column, c: Column) -> Column:
        unit = F.try_element_at(units, c)
        current = state["current"]
        return F.struct(
            F.when(unit.isNotNull(), state["sum"] + F.when(current == 0, 1).otherwise(current) * unit).otherwise(state["sum"]).alias("sum"),
            F.when(unit.isNotNull(), 0).otherwise(F.try_element_at(digits, c)).alias("current"),
        )

    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("current"))
    value = F.aggregate(characters(trimmed), start, read, lambda s: s["sum"] + s["current"])
    known = trimmed.rlike(f"^[{''.join([*CN_DIGITS, *CN_UNITS])}]+$")
    return F.when(trimmed.rlike(r"^\d+$"), trimmed.cast("int")).when(known & (value != 0), value)


def hash_place(token: Column, dims: int) -> Column:
    """The component of a term in a hash vector."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dims).cast("int")


def hash_sign(token: Column) -> Column:
    return F.when(F.conv(F.substring(F.md5(token), 9, 1), 16, 10).cast("int") < 8, 1.0).otherwise(-1.0)


def law_name(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"\.[^.]*$", "")


def sanitise_query(query: Column) -> Column:
    """Without role marks, angle quotes and fences, cut at 1000 characters."""
    text = F.regexp_replace(query, r"(?i)(system|assistant|user)\s*:", "")
    text = F.regexp_replace(text, "<<|>>|```", "")
    return strip(F.substring(text, 1, 1000))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence of characters, a bit a character of `a`.

    A row of the table is one integer, with a zero wherever the length goes up; a character of `b` costs one
    addition over the places where it stands in `a`.
    """
    places: dict[str, int] = {}
    for at, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << at
    every = (1 << len(a)) - 1
    row = every
    for c in b:
        if met := row & places.get(c, 0):
            row = ((row + met) | (row - met)) & every
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def rouge_l(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of characters of the stripped texts; 0 if one is empty."""

    def score(a: str | None, b: str | None) -> float:
        a, b = (a or "").strip(), (b or "").strip()
        if not a or not b:
            return 0.0
        common = common_subsequence(a, b)
        precision, recall = common / len(a), common / len(b)
        return 2 * precision * recall / (precision + recall) if common else 0.0

    return pd.Series([score(a, b) for a, b in zip(hypothesis, reference)], dtype=float)
