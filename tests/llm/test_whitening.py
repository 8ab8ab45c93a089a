from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import whitening


def collected(df, components=32):
    rows = whitening.components_of(df, components=components).collect()
    return sorted(rows, key=lambda r: (r.vec_id is None, r.vec_id or 0, r.component))


def test_all_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    data = {r.vec_id: r.embedding for r in table.collect()}
    x = {k: [int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for k, v in data.items()}
    n, d = len(x), len(next(iter(x.values())))
    s = [sum(v[j] for v in x.values()) for j in range(d)]
    centred = np.array([[float(Fraction(v[j] * n - s[j], n)) for j in range(d)] for v in x.values()])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    got = collected(table)
    assert len(got) == n * 32 and {r.n for r in got} == {n}
    for r in got:
        assert r.deviation == sum((n * c - t) ** 2 for c, t in zip(x[r.vec_id], s, strict=True))
        assert abs(r.explained - values[-r.component] / values.sum()) < 1e-9
    whitened = np.array([r.whitened for r in got]).reshape(n, 32)
    want = centred @ vectors[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    order = [list(x).index(k) for k in sorted(x)]
    sign = np.sign((whitened * want[order]).sum(axis=0))
    assert np.abs(whitened - want[order] * sign).max() < 1e-6
    apart = whitened - whitened.mean(axis=0)
    assert abs(np.abs(apart.T @ apart / n - np.eye(32)).max() - got[0].identity_error) < 1e-9
    assert 0 <= got[0].identity_error < 1e-4


def test_exact_scatter_of_large_numbers(spark):
    """Sums far beyond 2^53, and beyond 2^63, come out to the last digit."""
    rng = np.random.default_rng(3)
    v = rng.uniform(-1e14, 1e14, (300, 5))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    model = whitening.fit(df, "embedding", 5)
    x = [[int(c) for c in row] for row in whitening.integers(v)]
    n, s = 300, [sum(r[j] for r in x) for j in range(5)]
    assert (model.n, model.sums) == (n, s) and len(model.primes) > 4
    scatter = [[sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x) / n**3 for j in range(5)] for i in range(5)]
    shown = model.components @ np.diag(model.values) @ model.components.T
    assert np.abs(shown - np.array(scatter)).max() < 1e-9 * np.abs(scatter).max()
    assert collected(df)[0].deviation is None  # more than a long holds


def test_residues_combine():
    moduli = whitening.primes(10**40)
    for x in (0, 1, -1, 10**39, -(10**39), 123456789012345678901234567890):
        assert whitening._combine([x % p for p in moduli], moduli) == x
    assert all(p < 2**20 for p in moduli) and whitening.CHUNK * (2**20) ** 2 <= 2**53


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0, 3.0]),
        (1, [1.0, 2.0, 3.0]),
        (2, [0.5, -2.0, 3.0]),
        (None, [0.25, 1.0, 3.0]),
        (3, None),
        (4, [1.0, None, 2.0]),
        (5, [nan, 1.0, 1.0]),
        (6, [1.0, -inf, 1.0]),
        (7, []),
        (8, [1.0, 2.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("n", "component", "_vector", "whitened", "v")})
    got = collected(df)
    assert [r.vec_id for r in got] == [1] * 6 + [2] * 3 + [None] * 3 and {r.n for r in got} == {4}
    # The third entry is constant and rows have two free directions: the last component has no variance.
    assert all((r.whitened is None) == (r.component == 3) for r in got)
    assert got[0].identity_error < 1e-9


def test_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.components_of(spark.createDataFrame([], schema)).count() == 0
    assert whitening.components_of(spark.createDataFrame([(1, None)], schema)).count() == 0
    one = whitening.components_of(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
