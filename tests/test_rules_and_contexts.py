"""Rules as tables against rules as code; whole contexts against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from corpus_engine.functions import rule_tables, rules
from corpus_engine.operators.contexts import build_contexts
from corpus_engine.plans import text_queries


@pytest.mark.parametrize("few,letters", [(10_000, 2_000_000), (0, 2_000_000), (0, 12)])
def test_a_table_of_the_library_s_rules_classifies_as_they_do(spark, small, few, letters):
    files = text_queries.legal_files(spark, small).unionByName(spark.createDataFrame([(-1, None, None), (-2, "判决书.txt", ""), (-3, "无", "原告 原告 总则 第一条")], "doc_id long, file_name string, text string"))
    want = rules.classify_documents(files)
    columns = ["doc_id", "law_score", "case_score", "doc_type", "confidence"]
    table = rule_tables.rule_table(spark, rules.LEGAL_RULES).repartition(3)
    found = rule_tables.classify_by_table(files, table, "case", few, letters)
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_odd_rules(spark):
    files = spark.createDataFrame([(1, "abcd abcd"), (2, "bc"), (3, None), (4, "zz")], "doc_id long, text string")
    rows = [("x", None, "word", "ab", 2.0), ("x", "n", "word", "ab", 1.0), ("y", "n", "word", "bc", 3.0), ("y", "n", "word", "", 9.0), (None, "n", "word", "bc", 9.0), ("y", "n", "odd", "bc", 9.0), ("x", "n", "word", "bc", None)]
    table = spark.createDataFrame([(*r, None, None, None, None) for r in rows], rule_tables.RULES)
    for few in (0, 100):
        found = {r.doc_id: (r.x_score, r.y_score, r.doc_type, r.confidence) for r in rule_tables.classify_by_table(files, table, "none", few).collect()}
        assert found == {1: (3.0, 3.0, "none", 0.5), 2: (0.0, 3.0, "y", 1.0), 3: (0.0, 0.0, "none", 0.0), 4: (0.0, 0.0, "none", 0.0)}
    none = rule_tables.classify_by_table(files, table.where("label = 'z'"), "none")
    assert {(r.doc_type, r.confidence) for r in none.collect()} == {("none", 0.0)}
    many = spark.range(501).select(F.lit("x").alias("label"), F.lit("n").alias("name"), F.lit("regex").alias("kind"), F.col("id").cast("string").alias("pattern"), F.lit(1.0).alias("weight"), F.lit(None).cast("int").alias("cap"), F.lit("text").alias("field"), F.lit(None).cast("double").alias("density"), F.lit(0.0).alias("bonus"))
    with pytest.raises(ValueError, match="patterns"):
        rule_tables.classify_by_table(files, many, "none")


def size(content: str) -> int:
    return 4 + (max(1, len(content) // 2) if content else 0)


def plain_context(history, question, prompt, available, rounds):
    """The talk to send for a session, one message after the other."""
    budget = available - size(prompt) - size(question)
    total = sum(size(m["content"]) for m in history)
    compressed = budget >= 0 and total > budget
    if budget < 0:
        history = []
    elif compressed:
        protected, rest = history[-2 * rounds :], history[: -2 * rounds]
        old = [m for m in rest if not m["summary"]]
        talk = [m for m in rest if m["summary"]] + protected
        if old:
            asked = [m["content"][:40] for m in old if m["role"] == "user"][:5]
            talk = [{"role": "assistant", "content": "[历史对话摘要]\n" + "；".join(asked)}, *talk]
        while sum(size(m["content"]) for m in talk) > budget:
            talk.pop(0)
        history = talk
    return [("system", prompt), *[(m["role"], m["content"]) for m in history], ("user", question)], compressed


def test_contexts_are_those_of_plain_python(spark):
    draw = random.Random(6)
    talks, asked, results = {}, [], []
    for session in range(40):
        talks[session] = [
            {"role": draw.choice(["user", "assistant"]), "content": draw.choice(["", "x" * draw.randrange(200), "词" * draw.randrange(90)]), "summary": draw.random() < 0.2}
            for _ in range(draw.randrange(0, 14))
        ]
        asked.append((session, draw.choice(["what?", None, "long " * draw.choice([3, 200])]), draw.choice(["law", None, "odd"])))
        results += [(session, rank, draw.choice(["s", None]), draw.choice(["text", None])) for rank in range(1, draw.choice([1, 3]))]
    rows = [(s, s * 100 + k, m["role"], m["content"] or draw.choice(["", None]), m["summary"]) for s, talk in talks.items() for k, m in enumerate(talk)]
    messages = spark.createDataFrame(rows, "session_id long, id long, role string, content string, summary boolean").withColumn("created_at", F.timestamp_seconds(F.col("id") % 100)).repartition(4)
    templates = spark.createDataFrame([("law", "LAW {retrieval_block}", "law alone"), ("other", "ANY {retrieval_block}", "any alone")], "query_type string, with_context string, without_context string")
    built = build_contexts(
        messages, spark.createDataFrame(asked, "session_id long, question string, query_type string"), spark.createDataFrame(results, "session_id long, rank int, source string, text string"), templates, "other", 220, 50
    ).collect()
    kinds = set()
    for session, question, kind in asked:
        own = sorted((r for r in results if r[0] == session), key=lambda r: r[1])
        block = "检索到的文档内容：\n" + "\n\n---\n\n".join(f"[{i}] 来源: {s or '未知'}\n内容: {t or ''}" for i, (_, _, s, t) in enumerate(own, 1)) if own else ""
        prompt = ("LAW " if kind == "law" else "ANY ") + block if own else "law alone" if kind == "law" else "any alone"
        want, compressed = plain_context(talks[session], question or "", prompt, 170, 2)
        found = sorted((r for r in built if r.session_id == session), key=lambda r: r.place)
        assert [(r.role, r.content) for r in found] == want and {r.was_compressed for r in found} == {compressed}
        assert {r.total_tokens for r in found} == {sum(size(c) for _, c in want)} and [r.place for r in found] == list(range(len(found)))
        kinds.add((compressed, len(want) > 2))
    assert len(kinds) >= 3
