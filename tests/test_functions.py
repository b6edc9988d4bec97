"""Rules, cleaning steps and chunkers on hand-made rows."""

import random
import re

from pyspark.sql import functions as F

from corpus_engine.functions import rules, text
from corpus_engine.operators import chunk, metrics, quality, search


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_numerals(spark):
    found = {t: one(spark, text.cn_to_int(F.col("t")), t=t) for t in ("十二", "一百零三", "42", "二十三", "零", "0", "甲", "千", "一万二千")}
    assert found == {"十二": 12, "一百零三": 103, "42": 42, "二十三": 23, "零": None, "0": 0, "甲": None, "千": 1000, "一万二千": 12000}


def test_dates(spark):
    assert one(spark, text.slash_date(F.col("t")), t="3/4/24 1/12/99 05/06/2023 1/2/123") == "2024-04-03 1999-12-01 2023-06-05 123-02-01"
    assert one(spark, text.cn_date(F.col("t")), t="2024年1月5日 2024年11月25日") == "2024-01-05 2024-11-25"


def test_personal(spark):
    assert one(spark, text.mask_personal(F.col("t")), t="a 13812345678 110101199001011234 138-1234-5678 1381234567") == "a *** *** *** 1381234567"


def test_han_tokens(spark):
    assert one(spark, text.tokenize(F.col("t")), t="Ab c 民法典 刑") == ["ab", "民法", "法典"]


def test_rouge(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("abcd", "bd"), ("", "x"), ("abc", "xyz")], "a string, b string")
    assert [round(r.x, 4) for r in df.select(text.rouge_l("a", "b").alias("x")).collect()] == [1.0, 0.6667, 0.0, 0.0]


def test_correction(spark):
    fix = lambda q, p=False: one(spark, rules.correct_query(F.col("q"), p), q=q)
    assert fix("诉讼实效") == "诉讼时效"
    assert fix("辩护律师") == "辩护律师" and fix("辩护律师", True) == "辩护律师师"
    assert fix("刑法和《民法典》") == "《刑法》和《民法典》"
    assert fix("最高法规定") == "最高人民法院规定" and fix("最高检 最高人民检察院") == "最高检 最高人民检察院"


def plain_pieces(text, size, overlap, separators=chunk.SEPARATORS):
    """The splitting by a loop and recursion."""
    index = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, finer = separators[index], separators[index + 1 :]
    first, *rest = text.split(mark) if mark else [""]
    parts = [p for p in (first, *(mark + r for r in rest)) if p] if mark else list(text)
    out, held = [], []

    def close():
        if held and (piece := "".join(held).strip()):
            out.append(piece)

    for part in parts:
        if len(part) > size and finer:
            close()
            held = []
            out.extend(plain_pieces(part, size, overlap, finer))
            continue
        if held and len("".join(held)) + len(part) > size:
            close()
            while held and (len("".join(held)) > overlap or len("".join(held)) + len(part) > size):
                held.pop(0)
        held.append(part)
    close()
    return out


def plain_packs(text, size, least):
    def pack(parts, mark):
        out, held = [], ""
        for part in parts:
            if held and len(held) + len(mark) + len(part) > size:
                out.append(held)
                held = part
            else:
                held = f"{held}{mark}{part}" if held else part
        return [*out, held] if held else out

    if len(text) <= least:
        return [text] if text else []
    parts = []
    for paragraph in (p for p in text.split("\n\n") if p.strip()):
        parts += pack(re.split(r"(?<=[。！？.!?])", paragraph), "") if len(paragraph) > size else [paragraph]
    return pack(parts, "\n\n")


def test_splitters_are_those_of_plain_python(spark):
    draw = random.Random(7)
    made = lambda n: "".join(draw.choice(["词", "a", "bc", " ", " ", "。", "，", "\n", "\n\n", ". ", "🙂", "x" * 30]) for _ in range(n))
    texts = [None, "", "  \n", "一段。" * 300 + "\n\n" + "x" * 1200, "x" * 100, *[made(draw.randrange(200)) for _ in range(120)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for size, overlap in ((20, 5), (500, 50), (7, 0)):
        found: dict = {}
        for r in chunk.split_recursive(df, size, overlap).orderBy("doc_id", "chunk_index").collect():
            found.setdefault(r.doc_id, []).append(r.text)
            assert r.char_count == len(r.text)
        assert found == {k: p for k, t in enumerate(texts) if (p := plain_pieces(t or "", size, overlap))}
    for size, least in ((20, 30), (60, 60), (5000, 6000)):
        found = {}
        for r in chunk.pack_paragraphs(df, size, least).orderBy("doc_id", "chunk_index").collect():
            found.setdefault(r.doc_id, []).append(r.text)
        assert found == {k: p for k, t in enumerate(texts) if (p := plain_packs(t or "", size, least))}


def test_structure(spark):
    body = "前言\n第一条 甲\n## 第一章 总则\n第二条 乙\n继续\n第二章 分则\n第一节 一般\n**第三条** 丙"
    df = spark.createDataFrame([(1, "a.md", body), (2, "b.md", "无"), (3, "c.md", None)], "doc_id long, file_name string, text string")
    parents, children = chunk.split_structured(df)
    kids = {r.article_number: r for r in children.collect()}
    assert {n: k.text for n, k in kids.items()} == {1: "第一条 甲", 2: "第二条 乙\n继续", 3: "**第三条** 丙"}
    assert kids[3].chapter == "分则" and kids[3].section == "一般" and kids[2].section is None and kids[1].chapter is None
    found = {(r.doc_id, r.chapter, r.section, r.child_count) for r in parents.collect()}
    assert found == {(1, None, None, 1), (1, "总则", None, 1), (1, "分则", "一般", 1), (2, None, None, 0)}


def test_fusion_of_one_list(spark):
    schema = "query_id long, chunk_id long, rank int, score double, key string"
    near = spark.createDataFrame([(1, 10, 1, 0.9, "a"), (1, 11, 2, 0.8, "b"), (2, 10, 1, 0.7, "a")], schema)
    words = spark.createDataFrame([(1, 11, 1, 1.0, "b")], schema)
    rows = search.rrf(near, words, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, r.fusion_method) for r in rows] == [(1, 11, "RRF"), (1, 10, "RRF"), (2, 10, "vector-only")]
    assert rows[2].score == 0.7 and abs(rows[0].score - round(1 / 62 + 1 / 61, 6)) < 1e-9


def test_knn_blocks_agree(spark):
    rows = spark.range(300).select(F.col("id").alias("chunk_id"), F.array(*[F.rand(i) for i in range(4)]).alias("v")).cache()
    asked = rows.where("chunk_id % 7 = 0").withColumnRenamed("chunk_id", "query_id")
    whole = search.knn_search(asked, rows, 5).orderBy("query_id", "rank").collect()
    assert whole == search.knn_search(asked, rows, 5, block_rows=40).orderBy("query_id", "rank").collect()


def test_findings(spark):
    df = spark.createDataFrame([(1, "a   b!! (x"), (2, "see http://x&b hElLoWoRlD and more ok & b"), (3, None)], "doc_id long, text string")
    found = {(r.doc_id, r.rule): r.findings for r in quality.quality_findings(df).collect()}
    assert found == {(1, "spaces"): 1, (1, "repeated"): 1, (1, "brackets"): 1, (2, "odd_case"): 1, (2, "symbols"): 1}


def test_metrics_without_truth(spark):
    rel = spark.createDataFrame([("bm25", 1, 1, 0, 0)], "stage string, query_id long, rank int, rel int, total int")
    rows = metrics.metrics_at_k(rel, (1, 3)).collect()
    assert all(r.recall == 0 and r.precision == 0 and r.ndcg == 0 and r.hit == 0 and r.rr == 0 for r in rows)
