import random

from pyspark.sql import functions as F

from tessera.llm import hamming


def brute(index, queries, k):
    out = []
    for q, code in queries:
        near = sorted((bin((code ^ c) & (2**64 - 1)).count("1"), i) for i, c in index)[:k]
        out += [(q, n, i, d) for n, (d, i) in enumerate(near, 1)]
    return sorted(out)


def test_random_codes_with_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(hamming, "INDEX_BLOCK", 150)
    monkeypatch.setattr(hamming, "LEAST_QUERIES", 7)
    rng = random.Random(5)
    bases = [rng.getrandbits(64) for _ in range(6)]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    rows = []
    for i in range(600):
        x = rng.choice(bases)
        for _ in range(rng.randrange(6) if i % 3 else 0):
            x ^= 1 << rng.randrange(64)
        rows.append((i, signed(x)))
    rows.append(rows[5])
    df = spark.createDataFrame([*rows, (None, 1), (9999, None)], "id long, code long")
    queries = [r for r in rows if r[0] % 20 == 0] + [(10_000, signed(rng.getrandbits(64)))]
    got = hamming.top_k(df, spark.createDataFrame(queries, "id long, code long"), 10)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, queries, 10)


def test_all_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    codes = table.select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    plain = [(r.vec_id, sum(1 << i for i, x in enumerate(r.embedding) if x > 0)) for r in table.collect()]
    assert [(r.id, r.code % 2**64) for r in codes.collect()] == plain
    got = hamming.top_k(codes, codes.filter("id % 20 = 0"), 10)
    assert sorted(tuple(r) for r in got.collect()) == brute(plain, [r for r in plain if r[0] % 20 == 0], 10)


def test_few_or_no_rows(spark):
    none = spark.createDataFrame([], "id long, code long")
    three = spark.createDataFrame([(1, 0), (2, 0), (3, -1)], "id long, code long")
    assert hamming.top_k(none, three, 5).count() == 0
    assert hamming.top_k(three, none, 5).count() == 0
    assert sorted(tuple(r) for r in hamming.top_k(three, three.filter("id = 3"), 5).collect()) == [(3, 1, 3, 0), (3, 2, 1, 64), (3, 3, 2, 64)]


def test_short_null_and_odd_vectors(spark):
    df = spark.createDataFrame([([1.0, -1.0, float("nan")],), ([],), ([None, 2.0],)], "v array<float>")
    assert [r.c for r in df.select(hamming.sign_code(F.col("v")).alias("c")).collect()][1:] == [0, 2]
