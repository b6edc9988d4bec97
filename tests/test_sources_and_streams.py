"""Readers on small files; streams against their batch twins."""

import json

from pyspark.sql import functions as F

from corpus_engine.operators import chunk
from corpus_engine.sources import files
from corpus_engine.streaming import jobs


def test_scans(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello\nworld")
    (tmp_path / "b.md").write_text("# head")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "c.txt").write_text("no")
    (tmp_path / "d.bin").write_text("?")
    found = files.scan_directory(spark, str(tmp_path), exclude=("/skip/",))
    assert {(r.file_type, r.text) for r in found.collect()} == {("txt", "hello\nworld"), ("markdown", "# head")}
    assert {(r.name, r.supported) for r in files.file_inventory(spark, str(tmp_path)).collect()} == {("a.txt", True), ("b.md", True), ("c.txt", True), ("d.bin", False)}
    stamped = files.stamp_source_metadata(found, "2024-01-01").select("doc_id", "file_hash", "file_size").collect()
    assert len({r.doc_id for r in stamped}) == 2 and {r.file_size for r in stamped} == {11, 6}
    assert files.scan_text(spark, str(tmp_path / "a.txt")).first().text == "hello\nworld"


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,\n")
    assert [r.text for r in files.scan_csv(spark, str(tmp_path / "t.csv")).collect()] == ["a: 1\nb: x", "a: 2\nb: "]


def test_eval_sets(spark, tmp_path):
    qa = {"data": [{"question": "q1", "reference": ["民法-2018-10-26:    \"第一条 x\""], "answer": " "}, {"question": " ", "reference": [], "answer": "a"}]}
    mcq = [{"input": "Question: 什么\nA. 一\nB. 二", "output": "《民法典》规定第三条，因此，正确答案是B", "type": "x"}]
    (tmp_path / "qa.json").write_text(json.dumps(qa))
    (tmp_path / "mcq.json").write_text(json.dumps(mcq))
    row = files.read_eval(spark, str(tmp_path / "qa.json")).collect()
    assert [(r.question, r.ground_truth, r.reference_answer) for r in row] == [("q1", ["第一条 x"], None)]
    row = files.read_eval(spark, str(tmp_path / "mcq.json")).first()
    assert (row.question, row.ground_truth, row.reference_answer) == ("什么", ["民法典第三条"], "B")


def test_windows_stream(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    named = lambda df: df.select(F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"))
    stream = named(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = jobs.stage_counts(stream).writeStream.outputMode("complete").format("memory").queryName("stage_windows")
    query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(spark.table("stage_windows").collect()) == sorted(jobs.stage_counts(named(events)).collect())


def test_ingest_stream(spark, tmp_path):
    schema = "doc_id long, text string, uploaded_at timestamp"
    prepare = lambda df: chunk.split_fixed(df, 10, 0).join(df.select("doc_id", "file_hash"), "doc_id")
    for number, texts in enumerate((["aaa", "bbb", "aaa"], ["bbb", "ccc"])):
        rows = spark.createDataFrame([(number * 10 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        rows.withColumn("uploaded_at", F.lit("2024-01-01").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.stream_ingest(spark, stream, prepare, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["aaa", "bbb", "ccc"]


def test_report(spark, tmp_path):
    metrics = spark.createDataFrame([("bm25", 1, 0.25), ("bm25", 3, 0.5), ("vector", 1, None)], "stage string, k int, recall double")
    means = spark.createDataFrame([(0.5, 7)], "rouge_l double, n long")
    text = files.write_metrics_report(metrics, str(tmp_path), means, ks=(1, 3))
    tables = [part.splitlines() for part in text.split("\n\n") if part.startswith("|")]
    assert tables[0][2:] == ["| bm25 | 1 | 0.2500 |", "| bm25 | 3 | 0.5000 |", "| vector | 1 | N/A |"]
    assert tables[1] == ["| stage | at_1 | at_3 |", "|---|---|---|", "| bm25 | 0.2500 | 0.5000 |", "| vector | N/A | N/A |"]
    assert tables[2][2:] == ["| 0.5000 | 7 |"]
    assert spark.read.json(f"{tmp_path}/metrics").count() == 3 and spark.read.json(f"{tmp_path}/generation").first().n == 7
    empty = files.write_metrics_report(metrics.limit(0), str(tmp_path / "none"))
    assert "Generation" not in empty and empty.count("\n|") == 4
