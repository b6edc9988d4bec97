"""The pipeline against brute force, and on odd and empty documents."""

import array
import hashlib

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from corpus_engine.llm import byte_bpe, language_mixture, secret_layers, simhash_tiles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_mixture.learned(docs)
    fit = {r.doc_id: language_mixture.fitting(*language_mixture.windows_of(r.text, model.table), model.least) for r in docs.collect()}
    kept = [r for r in docs.collect() if fit[r.doc_id] >= corpus_pipeline.LEAST_SHARE]
    one = corpus_pipeline.language_id(spark, docs, small)
    assert sorted(one.collect()) == sorted(kept) and one.columns == docs.columns

    groups = {r.doc_id: r.component_id for r in simhash_tiles.near_duplicates(one).collect()}
    two = corpus_pipeline.near_duplicates(spark, one, small)
    assert sorted(two.collect()) == sorted(r for r in kept if groups[r.doc_id] == r.doc_id)

    three = corpus_pipeline.secrets(spark, two, small)
    clean = {r.doc_id: secret_layers.masked(r.text) for r in two.collect()}
    assert {r.doc_id: (r.text, r.n_chars) for r in three.collect()} == {d: (t, len(t)) for d, t in clean.items()}

    four = corpus_pipeline.mix(spark, three, small)
    counts = {r.doc_id: r["count"] for r in four.groupBy("doc_id").count().collect()}
    assert set(counts.values()) <= {1, 2} and set(counts) <= set(clean) and four.columns == docs.columns

    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = corpus_pipeline.run(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d for d, n in counts.items() for _ in range(n))
    for r in rows:
        ids = library.encode_ordinary(clean[r.doc_id])
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(array.array("I", ids).tobytes()).hexdigest()


def test_text_of_no_learned_language_goes(spark, small):
    import random

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null")
    texts = {r.lang: r.text for r in docs.where("lang in ('en', 'de', 'es') and n_chars > 600").collect()}
    draw = random.Random(1)
    odd = {
        -1: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(600)),
        -2: "for (int i = 0; i < n; i++) { buf[i] = ptr->next; if (!ctx) return NULL; memcpy(dst, src, sizeof(xs)); } " * 5,
        -3: "Wszyscy ludzie rodza sie wolni i rowni pod wzgledem swej godnosci i swych praw. Sa oni obdarzeni rozumem i sumieniem. " * 3,
        -4: texts["en"][:600] + " " + texts["de"][:600] + " " + texts["es"][:600], -5: texts["en"][:600],
    }
    added = spark.createDataFrame([(k, t, None, "a", len(t)) for k, t in odd.items()], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(added), small).collect()}
    assert kept & set(odd) == {-4, -5} and docs.where("text is not null").count() == len(kept) - 2
    unlearned = docs.withColumn("lang", F.when(F.col("lang") != "de", F.col("lang")))
    found = {r.doc_id: r.lang for r in docs.collect()}
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, unlearned, small).collect()}
    assert sum(found[k] == "de" for k in kept) <= 0.1 * sum(x == "de" for x in found.values())
    assert sum(found[k] != "de" for k in kept) >= 0.95 * sum(x != "de" for x in found.values())


def test_odd_documents(spark, small):
    rows = [
        (1, "the cat sat on the mat with the dog", "en", "a", 35), (1, "the cat sat on the mat with the dog", "en", "a", 35), (None, "the cat sat on the mat", None, None, None),
        (2, None, "en", "a", 0), (3, "", None, "b", 0), (4, 'token = "abcdefgh12345" in the middle of the text', "en", "b", 48),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("row", "copies", "fp", "score", "masked", "c0"):
        docs = docs.withColumn(name, F.lit(name))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, small), "odd")
        assert docs.columns[-1] == "c0" and docs.count() > 0
        assert {r.c0 for r in docs.collect()} == {"c0"}
    assert all("abcdefgh" not in (r.text or "") for r in docs.collect())
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0
