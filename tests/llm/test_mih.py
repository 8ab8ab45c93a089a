import numpy as np
from pyspark.sql import functions as F

from tessera.llm import mih

SCHEMA = "vec_id long, embedding array<float>"


def brute(data, k, every=50):
    """{query: [(id, cosine)]} over (id, vector) pairs, one by one in doubles."""
    ids = np.array([i for i, _ in data])
    v = np.array([x for _, x in data], dtype=np.float32).astype(np.float64)
    norm = np.sqrt((v * v).sum(axis=1))
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = v @ v[q] / norm / norm[q]
        near = [j for j in np.lexsort((ids, -score.round(12))) if ids[j] != ids[q]]
        out[int(ids[q])] = [(int(ids[j]), score[j]) for j in near[:k]]
    return out


def found(df, k=5, radius=None, every=50):
    out = {}
    for r in sorted(mih.top_k(df, F.col("id") % every == 0, k, radius=radius).collect()):
        out.setdefault(r.query_id, []).append((r.id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = [(r.vec_id, r.embedding) for r in table.collect()]
    want, got = brute(data, 5, 20), found(table, every=20)
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    assert recall(got, want) >= 0.93
    true = {q: dict(x) for q, x in brute(data, len(data), 20).items()}
    assert all(abs(s - true[q][i]) < 1e-12 for q, x in got.items() for i, s in x)


def test_exact_without_a_bound(spark, monkeypatch):
    monkeypatch.setattr(mih, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(mih, "LEAST_QUERIES", 5)
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    data = [(r.vec_id, r.embedding) for r in table.collect()]
    got, want = found(table, radius=mih.BITS), brute(data, 5)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}


def test_every_code_within_a_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 16, (3000, mih.SEGMENTS), dtype=np.uint16)
    near = codes[rng.integers(0, 3000, 2000)].copy()
    for row in near:
        for bit in rng.integers(0, mih.BITS, rng.integers(0, 40)):
            row[bit // 16] ^= np.uint16(1 << (bit % 16))
    codes = np.concatenate((codes, near))
    index = mih.Index(codes)
    for code in near[:40]:
        apart = np.bitwise_count(codes ^ code).sum(axis=1)
        for radius in (0, 1, 7, 8, 13, 24, 31, 53, 127, 128):
            assert index.within(code, radius).tolist() == np.flatnonzero(apart <= radius).tolist()


def test_close_groups_need_a_small_radius(spark):
    """Rows in tight groups: the measured radius is small and nothing is lost."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 32))
    v = (centres[np.arange(1200) % 60] + 0.02 * rng.standard_normal((1200, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SCHEMA)
    rows, _ = mih.usable(df, "vec_id", "embedding")
    coder = mih.learn(mih.unit(v))
    radius = mih._calibrate(rows, rows.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), coder, 32, 5)
    assert radius < 20
    want, got = brute(list(enumerate(v.tolist())), 5), found(df)
    assert recall(got, want) >= 0.95


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]),
        (50, [1.0, 0.0]),
        (50, [1.0, 0.0]),
        (1, [1.0, 0.0]),
        (2, [-1.0, 1.0]),
        (3, [0.0, 0.0]),
        (4, [nan, 1.0]),
        (5, [inf, 1.0]),
        (6, [None, 1.0]),
        (7, None),
        (8, []),
        (9, [1.0, 2.0, 3.0]),
        (None, [1.0, 0.0]),
        (100, [1.0, 1.0]),
        (100, [0.0, 1.0]),  # an id with two vectors
        (150, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("id", "v", "h", "n", "found")})
    got = mih.top_k(df, F.col("id") % 50 == 0, 3).collect()
    by = {}
    for r in sorted(got):
        by.setdefault(r.query_id, []).append((r.rank, r.id, round(r.score, 6)))
    half = round(2**-0.5, 6)
    assert by[0] == [(1, 1, 1.0), (2, 50, 1.0), (3, 100, half)]
    assert by[50] == [(1, 0, 1.0), (2, 1, 1.0), (3, 100, half)]
    assert sorted(by[100]) == [(1, 0, half), (1, 2, half), (2, 1, half), (2, 100, half), (3, 0, 0.0), (3, 50, half)]
    assert by.keys() == {0, 50, 100}


def test_many_copies(spark):
    """A third of all rows is one vector: few of its ids are indexed, and none is lost."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((900, 8)).astype(np.float32)
    v[::3] = v[0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SCHEMA)
    got = found(df)
    assert [i for i, _ in got[300]] == [0, 3, 6, 9, 12] and [i for i, _ in got[0]] == [3, 6, 9, 12, 15]
    assert recall(got, brute(list(enumerate(v.tolist())), 5)) >= 0.9


def test_few_or_no_rows(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == {}
    assert found(spark.createDataFrame([(50, [1.0])], SCHEMA)) == {}
    got = found(spark.createDataFrame([(50, [1e-30, 0.0]), (1, [1e30, 1e30])], SCHEMA))
    assert [i for i, _ in got[50]] == [1] and abs(got[50][0][1] - 2**-0.5) < 1e-7
    assert found(spark.createDataFrame([(1, [1.0]), (2, [1.0])], SCHEMA)) == {}
