"""Chunkers: rows of documents to rows of chunks, and back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_engine.functions.text import cn_to_int, strip
from corpus_engine.shared import TASK_BYTES, deal, materialize, united

SIZE, OVERLAP = 500, 50
# Separators in the order they are tried, and the marks of structure.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "，", " ", "")
NUMERAL = r"[一二三四五六七八九十百千万零\d]+"
CHAPTER = rf"^(?:#{{1,6}}[ \t]*)?第({NUMERAL})章[ \t]*(.*)$"
SECTION = rf"^(?:#{{1,6}}[ \t]*)?第({NUMERAL})节[ \t]*(.*)$"
ARTICLE = rf"^\*{{0,2}}第({NUMERAL})条\*{{0,2}}[ \t]*(.*)$"


def chunk_id(*parts: Column) -> Column:
    """An id that reruns agree on."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def split_fixed(df: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """df(doc_id, text) -> doc_id, chunk_index, chunk_total, text: windows of `size`, `size - overlap` apart.

    An empty text gives one empty chunk, a null text none. Long texts give long rows of chunks,
    made one by one from the row, so nothing is gathered.
    """
    step = size - overlap
    total = F.greatest(F.lit(1), F.ceil((F.length("text") - overlap) / step)).cast("int")
    rows = df.where(F.col("text").isNotNull()).select("doc_id", "text", total.alias("chunk_total"))
    rows = rows.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("chunk_total") - 1)))
    return rows.select("doc_id", "chunk_index", "chunk_total", F.expr(f"substring(text, chunk_index * {step} + 1, {size})").alias("text"))


def recursive_pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the first separator that occurs, finer ones within long parts."""
    index = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, finer = separators[index], separators[index + 1 :]
    if mark:
        first, *rest = text.split(mark)
        parts = [p for p in (first, *(mark + r for r in rest)) if p]
    else:
        parts = list(text)
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        if held and (piece := "".join(held).strip()):
            out.append(piece)

    length = 0
    for part in parts:
        if len(part) > size and finer:
            close()
            held.clear()
            length = 0
            out.extend(recursive_pieces(part, size, overlap, finer))
            continue
        if held and length + len(part) > size:
            close()
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.pop(0))
        held.append(part)
        length += len(part)
    close()
    return out


def split_recursive(
    df: DataFrame, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """df(doc_id, text, *keep) -> doc_id, *keep, chunk_index, chunk_total, text, char_count; blank texts have no chunk."""

    @F.pandas_udf("array<string>")
    def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: recursive_pieces(t or "", size, overlap, separators))

    rows = df.select("doc_id", *keep, pieces(F.col("text")).alias("p"))
    return rows.select("doc_id", *keep, F.size("p").alias("chunk_total"), F.posexplode("p").alias("chunk_index", "text")).withColumn(
        "char_count", F.length("text")
    )


def pack_paragraphs(df: DataFrame, size: int = 5000, least: int = 6000) -> DataFrame:
    """Texts above `least` characters: paragraphs packed up to `size`, longer ones cut at sentence ends."""

    @F.pandas_udf("array<string>")
    def packs(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re

        def pack(parts: list[str], mark: str) -> list[str]:
            out, held = [], ""
            for part in parts:
                if held and len(held) + len(mark) + len(part) > size:
                    out.append(held)
                    held = part
                else:
                    held = f"{held}{mark}{part}" if held else part
            return [*out, held] if held else out

        def cut(text: str) -> list[str]:
            if len(text) <= least:
                return [text] if text else []
            parts: list[str] = []
            for paragraph in (p for p in text.split("\n\n") if p.strip()):
                parts += pack(re.split(r"(?<=[。！？.!?])", paragraph), "") if len(paragraph) > size else [paragraph]
            return pack(parts, "\n\n")

        for batch in texts:
            yield batch.map(lambda t: cut(t or ""))

    rows = df.select("doc_id", packs(F.col("text")).alias("p"))
    return rows.select("doc_id", F.posexplode("p").alias("chunk_index", "text"))


def rejoin_chunks(chunks: DataFrame, mark: str = "\n\n") -> DataFrame:
    """chunks(doc_id, chunk_index, text) -> doc_id, text in order. A document's chunks meet in one row, as its text does."""
    ordered = F.sort_array(F.collect_list(F.struct("chunk_index", "text")))
    return chunks.groupBy("doc_id").agg(F.concat_ws(mark, F.transform(ordered, lambda c: c["text"])).alias("text"))


def with_rows(df: DataFrame) -> DataFrame:
    """df with a number for each row, `_row`, written, so that the numbers stay."""
    return materialize(df.withColumn("_row", F.monotonically_increasing_id()), "rows")


def split_structured(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df(doc_id, file_name, text) -> (parents, children) by chapter, section and article lines.

    A chapter or section opens a parent; articles before any are a parent of their own. A
    parent's text runs from its heading to the end of its last article, children are articles.
    Parents without articles go. Documents without marks are a parent, and have no child. Each row is a
    document of its own, also where rows share a doc_id; `_row` tells them apart. Lines of a document meet
    in one task, so texts are measured first, and a task gets about TASK_BYTES of them.
    """
    if "_row" not in df.columns:
        df = with_rows(df.select("doc_id", "file_name", "text"))
    size = df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first().bytes
    df = deal(df, size, TASK_BYTES, "_row")
    lines = df.select("_row", "doc_id", F.regexp_replace("file_name", r"\.[^.]*$", "").alias("law_name"), F.posexplode(F.split("text", "\n")).alias("n", "line"))

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract("line", pattern, group)

    level = (
        F.when(F.col("line").rlike(CHAPTER), "chapter").when(F.col("line").rlike(SECTION), "section").when(F.col("line").rlike(ARTICLE), "article")
    )
    upto = Window.partitionBy("_row").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("level", level)
    heading = F.col("level").isin("chapter", "section")
    placed = marked.withColumns({
        "grp": F.sum(heading.cast("int")).over(upto),
        "art": F.sum((F.col("level") == "article").cast("int")).over(upto),
        "chapter": F.last(F.when(F.col("level") == "chapter", part(CHAPTER, 2)), True).over(upto),
        "chapter_number": F.last(F.when(F.col("level") == "chapter", cn_to_int(part(CHAPTER, 1))), True).over(upto),
        "marks": F.count("level").over(upto),
        "starts": F.max(F.when(heading, F.col("n"))).over(upto),
    })
    # a section holds until the next chapter
    chapters = F.sum((F.col("level") == "chapter").cast("int")).over(upto)
    placed = placed.withColumn("chap", chapters)
    within = Window.partitionBy("_row", "chap").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumns({
        "section": F.last(F.when(F.col("level") == "section", part(SECTION, 2)), True).over(within),
        "section_number": F.last(F.when(F.col("level") == "section", cn_to_int(part(SECTION, 1))), True).over(within),
    })
    inside = placed.where("marks > 0")
    in_order = F.sort_array(F.collect_list(F.struct("n", "line")))
    text = strip(F.concat_ws("\n", F.transform(in_order, lambda x: x["line"])))
    keys = ["_row", "doc_id", "law_name", "grp"]
    context = [F.max(c).alias(c) for c in ("chapter", "chapter_number", "section", "section_number")]
    # lines of a group before its first article and after its heading belong to the parent only
    first_article = F.min(F.when(F.col("level") == "article", F.col("art"))).over(Window.partitionBy("_row", "grp"))
    grouped = inside.withColumn("first_article", first_article).where("first_article is not null")
    in_article = (F.col("art") >= F.col("first_article"))
    children = grouped.where(in_article).groupBy(*keys, "art").agg(
        text.alias("text"), F.max(F.when(F.col("level") == "article", cn_to_int(part(ARTICLE, 1)))).alias("article_number"), *context
    )
    parents = grouped.groupBy(*keys).agg(
        text.alias("text"), F.count(F.when(F.col("level") == "article", 1)).alias("child_count"), *context
    )
    plain = marked.groupBy("_row", "doc_id", "law_name").agg(F.count("level").alias("m"), text.alias("text")).where("m = 0")
    parent_id = chunk_id(F.lit("parent"), F.col("doc_id").cast("string"), F.col("grp").cast("string"))
    parents = united(parents, plain.drop("m").withColumn("grp", F.lit(0)))
    parents = parents.withColumns({"parent_chunk_id": parent_id, "chunk_type": F.lit("parent"), "char_count": F.length("text"), "child_count": F.coalesce("child_count", F.lit(0))})
    children = children.withColumns({
        "parent_chunk_id": parent_id, "chunk_type": F.lit("child"), "char_count": F.length("text"),
        "chunk_id": chunk_id(F.lit("child"), F.col("doc_id").cast("string"), F.col("art").cast("string")),
    })
    return parents, children


def route_and_split(df: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """df(doc_id, file_name, text, doc_type): law by structure (plain chunks if it gives no child), others plain."""
    rows = with_rows(df.select("doc_id", "file_name", "text", "doc_type"))
    law, other = rows.where("doc_type = 'law'"), rows.where("doc_type is distinct from 'law'")
    parents, children = split_structured(law)
    with_child = children.select("_row").distinct()
    plain = united(other, law.join(with_child, "_row", "left_anti"))
    pieces = split_recursive(plain, size, overlap, keep=("_row", "doc_type"))
    parts = united(parents.join(with_child, "_row", "left_semi"), children).withColumn("doc_type", F.lit("law"))
    return united(pieces.withColumn("chunk_type", F.lit("plain")), parts)
