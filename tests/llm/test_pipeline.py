import hashlib
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_takes_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        tables.append((name, docs))
        if name != "byte_bpe":
            assert docs.columns == COLUMNS
    kept = {name: df.collect() for name, df in tables}
    assert {r.lang for r in kept["language_id"]} == {"en", "fr", "de", "es"}
    assert len(kept["language_id"]) >= 0.98 * len(before)
    assert len({r.text for r in kept["simhash_near_dedup"]}) == len(kept["simhash_near_dedup"]) < len(kept["language_id"])
    for r in kept["substring_dedup"]:
        assert r.n_chars == len(r.text) <= before[r.doc_id].n_chars
    words = lambda rows: sum(len(r.text.encode().split()) for r in rows)
    assert abs(words(kept["mixing"]) - words(kept["substring_dedup"])) < 0.02 * words(kept["substring_dedup"]) + 5000
    assert {r.doc_id for r in kept["mixing"]} <= {r.doc_id for r in kept["substring_dedup"]}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = sorted((r.doc_id, r.text) for r in kept["mixing"])
    got = sorted((r.doc_id, r.ids, r.decoded_sha256) for r in kept["byte_bpe"])
    assert [(i, library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts] == got
    assert [tuple(r)[:4] for r in corpus_pipeline.run(spark, SF).orderBy("doc_id", "ids_sha256").collect()] == [tuple(r)[:4] for r in tables[-1][1].orderBy("doc_id", "ids_sha256").collect()]


def test_odd_rows(spark, odd, none):
    for df in (odd, none):
        docs = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF).cache()
            assert docs.columns == df.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_columns_of_odd_names_and_types(spark, documents):
    docs = documents.limit(60).withColumn("my col: x", F.lit("a.b")).withColumn("a`b", F.lit(1)).withColumn("tags", F.create_map(F.lit("k"), F.col("doc_id")))
    columns, types = docs.columns, docs.dtypes
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns and docs.dtypes == types
    rows = docs.collect()
    assert rows and all(r["my col: x"] == "a.b" and r["tags"] == {"k": r.doc_id} for r in rows)


def test_texts_in_no_learnt_language_go(spark, documents):
    """Random letters of any length are rejected; short and long texts in the languages stay."""
    rng = random.Random(3)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(n)) for n in (60, 100, 300, 1000)]
    noise += ["これは日本語の文章です。" * 40, "Это предложение на русском языке. " * 30]
    docs = documents.unionByName(spark.createDataFrame([(10**6 + i, t, None, "noise", len(t)) for i, t in enumerate(noise)], documents.schema))
    kept = corpus_pipeline.identify_language(spark, docs, SF).select("doc_id").collect()
    ids = {r.doc_id for r in kept}
    assert not [i for i in ids if i >= 10**6]
    assert len(ids) >= 0.99 * documents.filter("text rlike '[a-z]'").count()
