"""Operators 11, 12 and 13 against brute force on small tables, with nulls, ties, repeated rows and clashing names."""

import collections
import hashlib
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle import agree

from corpus_engine.llm import bloom_dedup, hard_negatives, prefix_trie, registry

NEW = ("op11_bloom_dedup", "op12_prefix_trie", "op13_hard_negatives")


@pytest.mark.parametrize("name", NEW)
def test_agrees_with_sql(spark, small, name):
    agree(registry.queries()[name](spark, small), registry.oracle_sql()[name], small)


@pytest.mark.parametrize("name", NEW)
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert registry.queries()[name](spark, str(tmp_path)).count() == 0


# Operator 11

SHORT = [None, "", " \t\n\x0b\x0c\r ", "a b", "ab", "a  b", "a b", "A b", "🙂 x", "🙂x", "x" * 200_000, "x " * 200_000]


def brute_groups(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0))
    out = []
    for doc_id, text in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        _, nameless, best = min(groups[norm])
        out.append((doc_id, None if nameless else best, len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


def documents(seed: int, n: int = 3000):
    draw = random.Random(seed)
    rows = [(k, f"alone {k}") for k in range(n)] + [(n + k, "hot text" + " " * (k % 7)) for k in range(n // 2)]
    rows += [(2 * n + k, draw.choice(SHORT)) for k in range(60)] + [(None, None), (None, "nobody else"), (None, "no body else"), (7, "alone 7"), (7, "alone 7")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("slots", [1 << 17, 1])
def test_duplicates_against_brute_force(spark, monkeypatch, slots):
    monkeypatch.setattr(bloom_dedup, "SLOTS", slots)
    rows = documents(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for name in ("row", "sha", "h", "n", "maybe", "c0"):
        docs = docs.withColumn(name, F.lit(name))
    found = bloom_dedup.exact_duplicates(docs).collect()
    want, groups = brute_groups(rows)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], key=str) == want
    kept = [r for r in found if r.kept]
    assert len(kept) == groups == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)
    left = bloom_dedup.distinct_documents(docs)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in kept)


def test_suspects_hold_all_repeated_hashes_and_few_others(spark):
    hashes = spark.range(40_000).select(F.xxhash64("id").alias("h"))
    twice = spark.range(500).select(F.xxhash64("id").alias("h"))
    hot = spark.range(20_000).select(F.xxhash64(F.lit(3)).alias("h"))
    found = {r.h for r in bloom_dedup.suspects(hashes.unionByName(twice).unionByName(hot).repartition(7), 60_500).collect()}
    want = {r.h for r in twice.collect()} | {hot.first().h}
    assert want <= found and len(found - want) < 0.01 * 40_000
    rows = bloom_dedup.suspected(hashes, spark.createDataFrame([(h,) for h in want], "h long"))
    assert rows.where("maybe").join(twice, "h").count() == 500 and rows.where("maybe").count() < 500 + 0.05 * 40_000


# Operator 12


def brute_nodes(turns):
    """The contract's rows from (conv_id, turn, role, text)."""
    convs = collections.defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs[conv].append((turn is not None, turn or 0, digest, role, text))
    convs = {c: [(r, x) for *_, r, x in sorted(rows)] for c, rows in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        made[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members = collections.defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    own = {p: (len(m) - 1) * (len(p[-1][1]) if p else 0) for p, m in members.items()}
    leaves, saved = collections.Counter(), collections.Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += own[p]
    rows = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if made[c] == p)
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def talk(seed: int, copies: int = 0, longest: int = 9):
    draw = random.Random(seed)
    rows = []
    for conv in [*range(-120, 130, 3), 200, 201, 205, 300, 1000]:
        for turn in range(draw.randrange(1, longest)):
            rows.append((conv, draw.choice([None, turn, turn, 1]), draw.choice([None, "user", "user"]), draw.choice([None, "a", "a", "bb", "cç🙂"])))
    for k in range(copies):  # equal conversations, and two long ones that part late
        rows += [(5000 + 100 * k, turn, "user", "the same") for turn in range(4)]
    for conv, end in ((90_000, "x"), (90_100, "y"), (90_200, "y")):
        rows += [(conv, turn, "user", f"long {turn}" if turn < 30 else end) for turn in range(36)]
    rows += [(90_300, turn, "user", f"long {turn}") for turn in range(24)] + [(None, 1, "user", "lost")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("storey,shard,sampled", [(64, 100_000, 20), (3, 10, 4), (4, 7, 2), (1, 5, 1), (64, 5, 3)])
def test_trie_against_brute_force(spark, monkeypatch, storey, shard, sampled):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "SAMPLED", sampled)
    monkeypatch.setattr(prefix_trie, "BLOCK", 12)
    rows = talk(storey, copies=40)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("s", F.lit("clash")).repartition(5)
    nodes = prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.numbered_turns(turns)), storey)
    found = [(r.conv, r.depth, r.parent_conv, r.n, r.children, r.leaves, r.saved, r.ends) for r in nodes.collect()]
    assert sorted(found, key=str) == brute_nodes(rows)


# Operator 13


def brute_negatives(rows):
    sound = []
    for k, (vec_id, v, label) in enumerate(rows):
        if label is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
            sound.append((k, vec_id, label, [int(np.floor(256 * float(np.float32(c)))) for c in v]))
    out = []
    for k, a, label, x in sound:
        if a is None or a % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), i is None, i or 0, i, other) for n, i, other, y in sound if n != k and len(y) == len(x)]
        scored.sort(key=lambda s: s[:3])
        for score, _, _, positive, _ in [s for s in scored if s[4] == label][:5]:
            good = [s for s in scored if s[4] != label and 50 * -score <= 100 * -s[0] <= 95 * -score][:3]
            out += [(a, positive, rank, s[3], -score, -s[0]) for rank, s in enumerate(good, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block,near", [(16_384, 0.0), (50, 0.8)])
def test_negatives_against_brute_force(spark, monkeypatch, block, near):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    draw = np.random.default_rng(int(near * 10))
    centre = draw.standard_normal((4, 70))
    v = near * centre[draw.integers(0, 4, 700)] + (1 - near) * draw.standard_normal((700, 70))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[:200, 0] = 0.0
    rows = [(k, [float(np.float32(c)) for c in v[k]], int(draw.integers(0, 3)) if k % 3 else 0) for k in range(700)]
    rows += [(5000, None, 1), (5050, [None] * 70, 1), (5100, [float("nan")] * 70, 1), (5150, [0.0] * 70, 2), (5200, rows[3][1], None), (None, rows[7][1], 1), (5250, [0.5, 0.5], 1), (5300, [0.5, 0.25], 1), (5301, [0.25, 0.25], 2), (5350, [], 1)]
    rows += [(6000 + k, rows[50][1], k % 2) for k in range(12)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("x", F.lit("clash")).repartition(4)
    shifted = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    found = [tuple(r) for r in hard_negatives.hard_negatives(shifted).collect()]
    assert sorted(found, key=str) == brute_negatives(rows)


def test_intervals_hold_the_scores():
    draw = np.random.default_rng(4)
    for dims in (3, 64, 100):
        x = draw.integers(-300, 300, (500, dims)) * draw.integers(0, 3, (500, 1))
        q = draw.integers(-300, 300, (9, dims))
        codes, aligned, rest = hard_negatives.encode(x)
        bits = hard_negatives.Anchors(q)
        for a in range(len(q)):
            low, high = bits.intervals(a, codes, aligned, rest)
            exact = x @ q[a]
            assert (low <= exact).all() and (exact <= high).all()
            assert (high - low).mean() < 0.6 * np.linalg.norm(q[a]) * np.linalg.norm(x, axis=1).mean()
