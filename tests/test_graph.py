import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, semantic

SCHEMA = "id long, embedding array<double>, language string"


def rows_of(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v], "x") for i, v in enumerate(vectors)], SCHEMA)


def queries_of(rows, every=20):
    return rows.filter(f"id % {every} = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"), F.lit(None).cast("string").alias("query_language"))


def pairs(found):
    return {(r.query_id, r.id) for r in found.collect()}


@pytest.mark.parametrize("kind", ["even", "groups"])
def test_recall_over_shards_and_the_exact_setting(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 24))
    if kind == "groups":  # far from each other, so a graph of nearest rows alone would fall apart
        v = np.repeat(rng.normal(size=(30, 24)) * 20, 100, axis=0) + v * 0.1
    rows = rows_of(spark, v).cache()
    queries = queries_of(rows)
    index = graph.build(rows, "id", "embedding", str(tmp_path / "index"), shard_rows=800)
    assert index.count() == 4 and index.select(F.sum(F.size("ids"))).first()[0] == 3000
    truth = semantic.topk_batch(rows, queries, 10, "id", "embedding")
    exact = graph.topk(index, queries, 10, None)
    assert {tuple(r) for r in exact.collect()} == {tuple(r) for r in truth.select("query_id", "id", "score", "rank").collect()}
    ef = graph.width_for(index, rows, "id", "embedding")
    found = graph.search_shards(index, queries, 10, ef).cache()
    assert len(pairs(graph.merge(found, 10)) & pairs(truth)) >= 0.9 * truth.count()
    assert found.agg(F.sum("computed")).first()[0] < 0.5 * 3000 * 150


def test_every_node_is_reached():
    rng = np.random.default_rng(5)
    v = np.repeat(rng.normal(size=(50, 8)) * 50, 20, axis=0) + rng.normal(size=(1000, 8)) * 0.01
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v = v[rng.permutation(len(v))]
    ends, links = graph._layer(v, 4)
    seen = np.zeros(len(v), dtype=bool)
    graph._reach(ends, links, np.array([0]), seen)
    assert seen.all()


def test_a_shuffle_of_many_queries_finds_the_same(spark, tmp_path, monkeypatch):
    rows = rows_of(spark, np.random.default_rng(1).normal(size=(600, 8))).cache()
    index = graph.build(rows, "id", "embedding", str(tmp_path / "index"), shard_rows=200)
    want = {tuple(r) for r in graph.topk(index, queries_of(rows, 3), 5, 12).collect()}
    monkeypatch.setattr(graph, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(graph, "QUERY_BLOCK", 64)
    assert {tuple(r) for r in graph.topk(index, queries_of(rows, 3), 5, 12).collect()} == want and len(want) == 1000


def test_equal_vectors_ties_and_odd_rows(spark, tmp_path):
    odd = [(None, [1.0, 0.0], "x"), (7000, None, "x"), (7001, [0.0, 0.0], "x"), (7002, [float("nan"), 1.0], "x"), (7003, [None, 1.0], "x"), (7004, [float("inf"), 1.0], "x"), (7005, [], "x")]
    many = [(i, [1.0, 0.0], "x") for i in range(500)] + [(600, [0.0, 1.0], "x"), (600, [0.0, 1.0], "x"), (600, [1.0, 1.0], "x")]
    rows = spark.createDataFrame(odd + many, SCHEMA).withColumn("rank", F.lit(9)).withColumn("shard", F.lit("clash"))
    index = graph.build(rows, "id", "embedding", str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 0.0])], "query_id long, query_vector array<double>")
    for ef in (None, 10):
        got = [tuple(r) for r in graph.topk(index, asked, 3, ef).orderBy("query_id", "rank").collect()]
        assert got == [(1, 0, 1.0, 1), (1, 1, 1.0, 2), (1, 2, 1.0, 3), (2, 600, 1.0, 1), (2, 600, 0.707107, 2), (2, 0, 0.0, 3)]
    with pytest.raises(ValueError):
        graph.topk(index, asked, graph.MOST_K + 1, None)
    none = graph.build(rows.limit(0), "id", "embedding", str(tmp_path / "none"))
    assert none.count() == 0 and graph.topk(none, asked, 3, 10).count() == 0
    assert graph.topk(index, asked.limit(0), 3, 10).count() == 0
