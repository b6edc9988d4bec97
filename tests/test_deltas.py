"""What is kept by deltas: segments of postings, versions of collections, pages; inverted files; findings and table functions."""

import random
import re
import time
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from oracle import agree, counterpart
from pyspark.sql import functions as F

from corpus_engine import shared
from corpus_engine.functions import tables, text
from corpus_engine.operators import assemble, chunk, findings, inverted_file, jobs, quality, retrieve, search
from corpus_engine.operators.collections import Collections
from corpus_engine.operators.pages import PageIndex
from corpus_engine.operators.posting_segments import PostingSegments
from corpus_engine.plans import job_queries, model_queries, registry, search_queries, text_queries
from corpus_engine.shared import materialize
from corpus_engine.sources.manifest import Manifest, VersionConflict


def scores(spark, index):
    asked = spark.createDataFrame([(1, "red fox fox"), (2, "blue sea and the hill"), (3, "none of it")], "query_id long, query string")
    return {(r.query_id, r.chunk_id): (r.rank, r.score) for r in search.bm25_search(asked, index, 50).collect()}


def texts(seed: int, ids) -> list[tuple]:
    draw = random.Random(seed)
    words = "red fox blue sea hill and the of it a tree".split()
    return [(k, draw.choice([None, "", " ".join(draw.choice(words) for _ in range(draw.randrange(1, 12)))])) for k in ids]


def test_segments_score_as_a_rebuilt_index(spark, tmp_path):
    schema = "chunk_id long, text string"
    kept = PostingSegments(spark, str(tmp_path / "index"))
    assert scores(spark, kept.index()) == {}
    held: dict = {}

    def check():
        rebuilt = search.bm25_index(spark.createDataFrame(list(held.items()), schema))
        index = kept.index()
        assert scores(spark, index) == scores(spark, rebuilt)
        df = lambda i: {(r.term, r.df, round(r.idf, 9)) for r in i.terms.collect()}
        assert df(index) == df(rebuilt) and index.totals.first() == rebuilt.totals.first()

    def folders():
        return {r.folder for r in kept.manifest.entries()}

    for seed, ids in enumerate((range(0, 40), range(40, 55), range(55, 60))):
        before = folders()
        rows = texts(seed, ids)
        kept.append(spark.createDataFrame(rows, schema))
        held |= dict(rows)
        assert before < folders() and len(folders() - before) == 1
    check()
    pinned = kept.manifest.latest()
    gone = [*range(3, 50, 4), 999]
    before = folders()
    kept.delete(spark.createDataFrame([(k,) for k in gone], "chunk_id long"))
    assert len(folders() - before) == 1 and before < folders()
    held = {k: v for k, v in held.items() if k not in gone}
    check()
    assert kept.delete(spark.createDataFrame([(999,), (3,)], "chunk_id long")) == kept.manifest.latest() == pinned + 1  # nothing to do
    back = texts(9, [3, 7, 100])
    kept.append(spark.createDataFrame(back, schema))
    held |= dict(back)
    check()
    small = sorted(r.rows for r in kept.manifest.entries() if r.kind == "postings")[-1]
    kept.merge(small)  # all but the largest, which keeps its tombstones
    assert sum(r.kind == "postings" for r in kept.manifest.entries()) == 2 and any(r.kind == "tombstones" for r in kept.manifest.entries())
    check()
    kept.delete(spark.createDataFrame([(7,), (5,)], "chunk_id long"))
    held = {k: v for k, v in held.items() if k not in (5, 7)}
    check()
    kept.merge()
    assert [r.kind for r in kept.manifest.entries()] == ["postings"]
    check()
    assert kept.index(pinned).totals.first().n == 60  # an older version can still be read


def test_edits_touch_their_partitions_only(spark, tmp_path):
    kept = Collections(spark, str(tmp_path / "store"), "chunk_id long, text string", parts=8)
    rows = spark.range(200).select(F.col("id").alias("chunk_id"), F.concat(F.lit("t"), "id").alias("text"))
    kept.append(rows.where("chunk_id < 120"), "laws, 甲/乙")
    kept.append(rows.where("chunk_id >= 120"), "cases")
    assert kept.append(rows.where("chunk_id < 0"), "none") == 2
    first = kept.manifest.latest()
    before = {(r.collection, r.part, r.folder) for r in kept.manifest.entries()}
    kept.delete(spark.createDataFrame([(5,), (5,), (7777,)], "chunk_id long"))
    after = {(r.collection, r.part, r.folder) for r in kept.manifest.entries()}
    assert len(before - after) == 1 == len(after - before) and len(before & after) == len(before) - 1
    assert {r.chunk_id for r in kept.read().collect()} == set(range(200)) - {5} and kept.read(first).count() == 200
    kept.update(spark.createDataFrame([(150, "new"), (151, None), (9999, "x")], "chunk_id long, text string"))
    assert {r.text for r in kept.read().where("chunk_id in (150, 151)").collect()} == {"new", "t151"}
    assert kept.read(first).where("text = 'new'").count() == 0 and kept.counts() == {"laws, 甲/乙": 119, "cases": 80}
    now = kept.manifest.latest()
    bad = spark.createDataFrame([(1, "a")], "chunk_id long, text string").withColumn("text", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        kept.append(bad, "cases")
    assert kept.manifest.latest() == now and kept.read().count() == 199
    kept.drop("cases")
    assert kept.read().count() == 119 == kept.read(collection="laws, 甲/乙").count() and kept.read(collection="cases").count() == 0
    assert kept.drop("cases") == kept.manifest.latest() == now + 1


def test_commits_that_cross(spark, tmp_path):
    manifest = Manifest(spark, str(tmp_path / "m"), "folder string")
    assert manifest.latest() == 0 and manifest.entries() == []
    assert manifest.commit([("a",)], 0) == 1
    with pytest.raises(VersionConflict):
        manifest.commit([("b",)], 0)
    assert [r.folder for r in manifest.entries()] == ["a"]


def test_inverted_file_is_exact_and_passes_cells_by(spark, monkeypatch):
    monkeypatch.setattr(inverted_file, "BLOCK", 300)
    draw = np.random.default_rng(3)
    centre = draw.standard_normal((20, 16))
    x = centre[draw.integers(0, 20, 2000)] + 0.1 * draw.standard_normal((2000, 16))
    x[:700] = x[0]  # a third of all are copies: one cell, several blocks
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(5000, None), (5001, [float("nan")] * 16), (5002, [1.0])], "chunk_id long, v array<double>").repartition(4)
    asked = rows.where("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    built = inverted_file.InvertedFile(rows)
    assert built.blocks.max() > 1 and built.rows.count() == 2000
    found, compared = built.search(asked, 10)
    exact = search.knn_search(asked.where("query_id < 5000"), rows, 10)
    assert sorted(map(tuple, found.select("query_id", "chunk_id", "distance", "rank").collect())) == sorted(map(tuple, exact.select("query_id", "chunk_id", "distance", "rank").collect()))
    report = inverted_file.recall(found, exact, compared, 200 * 2000).first()
    assert report.recall == 1.0 and report.compared < 0.2
    none = inverted_file.InvertedFile(rows.where("chunk_id < 0"))
    assert none.search(asked, 3)[0].count() == 0


def test_pages_read_their_ranges(spark):
    draw = random.Random(2)
    rows = [(draw.choice([None, "a", "a", "a", "b", "c"]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "source string, id long").repartition(3)
    index = PageIndex(df, ["source", "id"])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    for offset, limit in ((0, 7), (120, 200), (495, 20), (500, 5), (9999, 1), (3, 0)):
        page = index.page(offset, limit).collect()
        assert [(r.source, r.id) for r in page] == order[offset : offset + limit] and all(r.total == 500 for r in page)
    assert all(len(index.parts(offset, 5)[0]) <= 2 for offset in range(0, 500, 5))


def test_alike_findings_are_those_of_difflib(spark):
    draw = random.Random(4)
    kinds = ["spaces found at line", "newlines found in line", "odd mark near", "", "x"]
    rows = []
    for doc in range(12):
        for _ in range(draw.randrange(1, 30)):
            made = draw.choice(kinds) + "".join(draw.choice(" 0123é") for _ in range(draw.randrange(6)))
            rows.append((doc if doc else None, draw.choice(["format", "case"]), draw.choice([made, made, made, None]), draw.choice(["low", "high"])))
    df = spark.createDataFrame(rows, "doc_id long, error_type string, description string, severity string").repartition(4)
    for ratio in (0.8, 0.5):
        want = []
        for group in {(r[0], r[1]) for r in rows}:
            kept: list[str] = []
            for _, _, description, severity in sorted((r for r in rows if (r[0], r[1]) == group), key=lambda r: (r[2] or "", r[3])):
                if not any(SequenceMatcher(None, description or "", k).ratio() > ratio for k in kept):
                    kept.append(description or "")
                    want.append((*group, description or "", severity))
        found = [(r.doc_id, r.error_type, r.description or "", r.severity) for r in findings.distinct_findings(df, ratio).collect()]
        assert sorted(found, key=str) == sorted(want, key=str)


def test_table_function_is_finding_positions(spark, small):
    tables.register(spark)
    rows = text_queries.personal(spark, small).unionByName(spark.createDataFrame([(-1, "hElLoWoRlD   & (]"), (-2, None)], "doc_id long, text string"))
    want = sorted(map(tuple, quality.finding_positions(rows).collect()))
    by_sql = spark.sql("SELECT doc_id, p.rule, p.position, p.length FROM {rows}, LATERAL finding_places(text) AS p", rows=rows)
    assert sorted(map(tuple, by_sql.collect())) == want and want
    by_join = rows.lateralJoin(tables.FindingPlaces(F.col("text").outer())).select("doc_id", "rule", "position", "length")
    assert sorted(map(tuple, by_join.collect())) == want
    some = spark.sql("SELECT p.rule FROM {rows}, LATERAL finding_places(text, 'spaces,brackets') AS p", rows=rows)
    assert {r.rule for r in some.collect()} == {"spaces", "brackets"}
    for bad in ("finding_places(1)", "finding_places('a', 'no_such')"):
        with pytest.raises(Exception, match="finding_places"):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_longest_common_subsequence():
    draw = random.Random(5)
    for _ in range(500):
        a, b = ("".join(draw.choice("abcé🙂") for _ in range(draw.randrange(15))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        assert text.common_subsequence(a, b) == row[-1]
    assert text.common_subsequence("ab" * 10_000, "ba" * 10_000) == 19_999


@pytest.mark.parametrize("broadcasts", ["10485760", "-1"])
@pytest.mark.parametrize("name", ["retrieved", "routed_both_ways", "evaluation_whole"])
def test_lists_compose_in_one_plan(spark, small, monkeypatch, name, broadcasts):
    """Without the writes between, and with unions taken for partitioned, the fused lists are the same."""
    monkeypatch.setattr(retrieve, "materialize", lambda df, name: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcasts)
    try:
        agree(registry.queries()[name](spark, small), registry.oracle_sql()[name], small)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_probes_are_handed_on_in_small_batches(spark, monkeypatch):
    """A query goes to a share of rows once, not to each of its cells, and few probes are held at once."""
    draw = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(draw.standard_normal((3000, 8)))], "chunk_id long, v array<double>").repartition(2)
    asked = rows.where("chunk_id % 5 = 0").withColumnRenamed("chunk_id", "query_id")
    monkeypatch.setattr(inverted_file, "STEP", 50)
    monkeypatch.setattr(inverted_file, "PROBES", 40)
    monkeypatch.setattr(inverted_file, "SLICE", 250)
    monkeypatch.setattr(inverted_file, "BLOCK", 500)
    monkeypatch.setattr(inverted_file, "SHARES", 6)
    kept = {}
    monkeypatch.setattr(inverted_file, "materialize", lambda df, name: kept.setdefault(name, materialize(df, name)))
    built = inverted_file.InvertedFile(rows)
    found, compared = built.search(asked, 10)
    shares = built.rows.groupBy("share").count().collect()
    assert max(r["count"] for r in shares) <= 500 and 6 <= len(shares) <= 13 and built.blocks.max() == 1
    probes = kept["further-probes"]
    assert probes.groupBy("query_id", "share").count().where("count > 1").count() == 0 and probes.count() <= 600 * len(shares)
    cells = probes.select(F.explode("cells").alias("cell"), "share")
    assert cells.join(built.rows.select("cell", "share").distinct(), ["cell", "share"], "left_anti").count() == 0
    sizes = {r.cell: r["count"] for r in built.rows.groupBy("cell").count().collect()}
    assert compared == sum(sizes[r.cell] * r["count"] for name in ("probes", "further-probes") for r in kept[name].select(F.explode("cells").alias("cell")).groupBy("cell").count().collect())
    want = search.knn_search(asked, rows, 10).select("query_id", "chunk_id", "distance", "rank")
    assert sorted(map(tuple, found.select("query_id", "chunk_id", "distance", "rank").collect())) == sorted(map(tuple, want.collect()))


def test_more_text_makes_more_tasks_not_larger_ones(spark, monkeypatch):
    """Postings, scores and vectors are made in tasks of bounded size, with the same results; rows of one id still meet."""
    draw = random.Random(8)
    words = [f"word{i}" for i in range(40)]
    texts = [(i % 190, " ".join(draw.choices(words, k=draw.randrange(1, 30)))) for i in range(200)] + [(500, ""), (501, None)]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string").repartition(3)
    asked = spark.createDataFrame([(q, " ".join(draw.choices(words, k=3))) for q in range(20)], "query_id long, query string")

    def made():
        index = search.bm25_index(chunks)
        scores = search.bm25_scores(search.query_terms(asked), index)
        vectors = search.posting_vectors(index)
        rows = index.postings.groupBy(F.input_file_name()).agg(F.sum("tf").alias("n")).collect()
        sums = scores.groupBy(F.spark_partition_id()).count().collect()
        held = vectors.groupBy(F.spark_partition_id()).count().collect()
        every = [sorted(map(repr, df.collect())) for df in (index.postings, search.bm25_search(asked, index, 5), vectors, index.totals)]
        return every, max(r.n for r in rows), max(r["count"] for r in sums), max(r["count"] for r in held), index.postings

    want, *most, postings = made()
    assert postings.where("chunk_id = 3").select("term", "dl").distinct().count() == postings.where("chunk_id = 3").count()
    monkeypatch.setattr(search, "TASK_BYTES", 800)
    monkeypatch.setattr(search, "TASK_TOKENS", 120)
    monkeypatch.setattr(search, "TASK_SUMS", 100)
    found, *less, _ = made()
    assert found == want and all(b < a / 2 for a, b in zip(most, less))
    nothing = search.bm25_index(chunks.where("chunk_id < 0"))
    assert search.bm25_search(asked, nothing, 5).count() == 0 and search.posting_vectors(nothing).count() == 0
    assert nothing.totals.first() == (0, None)


def test_rows_are_dealt_out_from_small_scans(spark, monkeypatch, tmp_path):
    """A task that deals rows out reads little, so that it can hold all of them; a lower setting stays."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    rows = [(i, f"law{i}.md", f"word{i % 7} word{i % 11} and more") for i in range(200)]
    spark.createDataFrame(rows, "chunk_id long, file_name string, text string").repartition(20).write.parquet(f"{tmp_path}/t")
    chunks, index = spark.read.parquet(f"{tmp_path}/t"), None
    asked = search.query_terms(spark.createDataFrame([(1, "word3 more"), (2, "word5")], "query_id long, query string"))
    scans = lambda: spark.read.parquet(f"{tmp_path}/t").rdd.getNumPartitions()
    deals = {
        "index": lambda: search.bm25_index(chunks).postings, "scores": lambda: search.bm25_scores(asked, index), "vectors": lambda: search.posting_vectors(index),
        "lines": lambda: chunk.split_structured(chunks.withColumnRenamed("chunk_id", "doc_id"))[0],
    }
    try:
        index, many = search.bm25_index(chunks), scans()
        want = {deal: sorted(map(repr, made().collect())) for deal, made in deals.items()}
        monkeypatch.setattr(shared, "SCAN_BYTES", 5_000_000)
        for deal, made in deals.items():
            spark.conf.set(name, before)
            assert sorted(map(repr, made().collect())) == want[deal]
            assert spark.conf.get(name) == "5000000" and scans() >= 2 * many, deal
        spark.conf.set(name, "1m")
        deals["index"]()
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_parents_are_met_without_sorting_all_texts(spark, tmp_path):
    """Few hits among many texts: no join sorts the texts; hits without parent, of unknown ids and repeated chunks stay as they were."""
    draw = random.Random(3)
    rows = [(i, i - i % 10 if i % 10 else None, "".join(draw.choices("abcdefgh", k=200))) for i in range(3000)] + [(7, 20, "again")]
    spark.createDataFrame(rows, "chunk_id long, parent_chunk_id long, text string").write.parquet(f"{tmp_path}/t")
    hits = [(1, 7, 1, 0.9), (1, 10, 2, 0.8), (2, 5000, 1, 0.7), (2, 2999, 2, 0.6), (3, None, 1, 0.5)]
    ranked = spark.createDataFrame(hits, "query_id long, chunk_id long, rank int, score double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60k")
        found = assemble.expand_to_parent(ranked, spark.read.parquet(f"{tmp_path}/t"))
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(repr, (tuple(r) for r in found.collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    text_of = {r[0]: r[2] for r in rows[:3000]}
    want = [(1, 0, 1, 0.9, text_of[0]), (1, 20, 1, 0.9, text_of[20]), (1, 10, 2, 0.8, text_of[10]), (2, 5000, 1, 0.7, None), (2, 2990, 2, 0.6, text_of[2990]), (3, None, 1, 0.5, None)]
    assert got == sorted(map(repr, want))


def test_texts_of_hits_are_met_without_dealing_out_all_texts(spark, small, monkeypatch, tmp_path):
    """Few hits among many texts: no join shuffles or sorts the texts; unknown and null ids go, repeated ones meet each row."""
    draw = random.Random(5)
    rows = [(i, "".join(draw.choices("abcdefgh", k=200))) for i in range(3000)] + [(7, "again"), (None, "none")]
    spark.createDataFrame(rows, "chunk_id long, text string").write.parquet(f"{tmp_path}/t")
    hits = [(1, 7, 1), (1, 10, 2), (2, 5000, 1), (2, 10, 2), (3, None, 1)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    made = []
    monkeypatch.setattr(assemble, "materialize", lambda df, name: made.append(plan(df)) or materialize(df, name))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60k")
        ranked = spark.createDataFrame(hits, "query_id long, chunk_id long, rank int")
        found = assemble.with_texts(ranked, spark.read.parquet(f"{tmp_path}/t"))
        got = sorted(map(tuple, found.collect()))
        want = [(7, 1, 1, rows[7][1]), (7, 1, 1, "again"), (10, 1, 2, rows[10][1]), (10, 2, 2, rows[10][1])]
        assert found.columns == ["chunk_id", "query_id", "rank", "text"] and got == sorted(want)
        for query in (search_queries.deduped, search_queries.flagship, search_queries.lenient_relevance, job_queries.contexts, model_queries.observations):
            made.append(plan(query(spark, small)))
        assert not [p for p in made if "documents.parquet" in p and "SortMergeJoin" in p]
        assert len(made) >= 10 and any("LeftSemi" in p and "documents.parquet" in p for p in made)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_deduped_deals_more_text_out_to_more_tasks(spark, small, monkeypatch):
    """The whole query: its postings and its sums are dealt out by their amount, not by a fixed number of tasks; rows stay the same."""
    plans, want = {}, sorted(map(tuple, search_queries.deduped(spark, small).collect()))
    keep = lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or materialize(df, name)
    for module in (search, assemble):
        monkeypatch.setattr(module, "materialize", keep, raising=False)

    def dealt(each: int) -> list[int]:
        monkeypatch.setattr(search, "TASK_BYTES", each, raising=False)
        monkeypatch.setattr(search, "TASK_SUMS", each // 80, raising=False)
        assert sorted(map(tuple, search_queries.deduped(spark, small).collect())) == want
        return [max(int(n) for n in re.findall(r"hashpartitioning\(chunk_id#[^)]*, (\d+)\)", plans[name])) for name in ("postings", "hits") if name in plans]

    few, many = dealt(80_000), dealt(20_000)
    assert all(a >= 3 * b > 3 for a, b in zip(many, few)) and len(many) == 2


def test_reranked_sums_scores_once(spark, small):
    """The list that is reranked is written: postings are not read by its plan, for the list and again for the new scores."""
    plan = search_queries.reranked(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "postings-" not in plan and "query-terms-" not in plan


def test_lines_are_dealt_out_by_size_of_texts(spark, monkeypatch):
    """Documents are taken apart in tasks of bounded size; parents and children are the same."""
    law = "第一章 总则\n第一条 甲\n乙\n第二条 丙\n第二章 附则\n第三条 丁"
    docs = spark.createDataFrame([(i, f"law_{i}.md", law if i % 3 else "plain") for i in range(120)], "doc_id long, file_name string, text string").repartition(2)
    texts = lambda parts: [sorted((r.doc_id, r.text) for r in part.select("doc_id", "text").collect()) for part in parts]
    whole, dealt = chunk.split_structured(docs), None
    most = max(r["count"] for r in whole[1].groupBy(F.spark_partition_id()).count().collect())
    monkeypatch.setattr(chunk, "TASK_BYTES", 400)
    dealt = chunk.split_structured(docs)
    assert texts(dealt) == texts(whole) and len(texts(dealt)[1]) == 240
    assert max(r["count"] for r in dealt[1].groupBy(F.spark_partition_id()).count().collect()) < most / 2


def test_ingest_cleans_once(spark, small, monkeypatch):
    """Cleaned and classified texts are written once, and chunks and facts are both read from there."""
    kept = []
    monkeypatch.setattr(jobs, "materialize", lambda df, name: kept.append(name) or materialize(df, name))
    files = text_queries.legal_files(spark, small).limit(50)
    found = jobs.ingest(files, spark.createDataFrame([], "file_hash string"))
    assert kept == ["kinds"] and found.inputFiles() and not any("documents.parquet" in f for f in found.inputFiles())
    assert found.select("doc_id").distinct().count() == 50 - files.where("text is null or trim(text) = ''").count()


def test_findings_of_long_lines_in_one_pass(spark):
    """Findings are as many as the places that plain Python finds; many symbols and brackets of one long line take time in proportion."""
    draw = random.Random(11)
    parts = [*"aAbBzZ09_ \n\r\t.-@&#()[]{}【】（）!,;:。\\é中😀𝒜\u0085\x07\x80", "http://", "https://x", "a@b.cn", "ABc", "aBcDeFg", "XMLHttp", "   ", "\n\n\n", "!!"]
    texts = {i: "".join(draw.choices(parts, k=draw.randrange(60))) for i in range(1500)}
    found = quality.quality_findings(spark.createDataFrame([*texts.items(), (-1, None)], "doc_id long, text string").repartition(4))
    want = {(i, rule): n for i, t in texts.items() for rule, n in Counter(rule for rule, *_ in quality.places_of(t)).items()}
    assert {(r.doc_id, r.rule): r.findings for r in found.collect()} == want
    started = time.monotonic()
    long = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a& ) "), 20_000).alias("text"))
    assert {r.rule: r.findings for r in quality.quality_findings(long).collect()} == {"symbols": 20_000, "brackets": 20_000}
    assert time.monotonic() - started < 20


def dealt_rows(spark, run) -> int:
    """Rows that all stages of run() wrote for a shuffle."""
    context = spark.sparkContext
    scala, jvm = context._jsc.sc(), context._jvm
    stages = lambda: scala.listenerBus().waitUntilEmpty() or scala.statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    each = lambda found: [(found.apply(i).stageId(), found.apply(i).shuffleWriteRecords()) for i in range(found.size())]
    last = max((k for k, _ in each(stages())), default=-1)
    run()
    return sum(n for k, n in each(stages()) if k > last)


def test_scopes_share_what_is_dealt_out(spark, small, monkeypatch):
    """Postings are dealt out whole for the vectors alone, and for each scope those of the queries' terms; texts are not dealt out again."""
    kept = []
    monkeypatch.setattr(search, "materialize", lambda df, name: kept.append((name, made := materialize(df, name))) or made)
    found, plain = [], registry.oracle_sql()["routed_both_ways"]
    rows = dealt_rows(spark, lambda: found.append(job_queries.routed_both_ways(spark, small).toPandas()))
    postings = next(df for name, df in kept if name == "postings")
    total = postings.count()
    asked = search.query_terms(search_queries.passages(spark, small)).select("term").distinct()
    met = postings.join(asked, "term", "left_semi").count()
    terms = postings.select("term").distinct().count()
    assert met < total and rows < total + 2 * met + 2 * 4 * terms + 10_000
    assert len(found[0]) == len(counterpart(plain, small))


def test_kept_chunks_are_met_after_the_postings_are_dealt_out(spark):
    """Repeated, null and unknown ids to keep change nothing; postings are dealt out once, by their amount."""
    draw = random.Random(4)
    words = [f"word{i}" for i in range(60)]
    chunks = spark.createDataFrame([(i, " ".join(draw.choices(words, k=12))) for i in range(300)], "chunk_id long, text string")
    asked = spark.createDataFrame([(q, " ".join(draw.choices(words[:6], k=3))) for q in range(9)], "query_id long, query string")
    index = search.bm25_index(chunks)
    keep = spark.createDataFrame([(i,) for i in [*range(0, 300, 3), *range(0, 300, 6), 999, None]], "chunk_id long")
    all_ = search.bm25_scores(search.query_terms(asked), index).where("chunk_id % 3 = 0")
    kept = search.bm25_scores(search.query_terms(asked), index, keep=keep)
    rounded = lambda df: sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in df.collect())
    assert rounded(kept) == rounded(all_) and all_.count() > 50
    tiled = search.bm25_scores(search.query_terms(asked), index, keep=keep, tile_rows=1)  # too many terms to be broadcast
    assert rounded(tiled) == rounded(all_)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = search.bm25_scores(search.query_terms(asked), index, keep=keep)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    postings = [line for line in plan.split("postings-")[0].splitlines() if "Exchange hashpartitioning(chunk_id" in line]
    assert len(postings) == 1 and "REPARTITION_BY_NUM" in postings[0]
