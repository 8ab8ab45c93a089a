import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing


def test_targets_share_everything_and_stop_at_three_times():
    sizes = {"a": 10, "b": 1000, "c": 500, None: 90, "é": 40, "z": 0}
    goal = mixing.targets(sizes)
    assert sum(goal.values()) == pytest.approx(sum(sizes.values()))
    assert goal["a"] == 30 and goal["z"] == 0
    assert all(goal[s] <= 3 * sizes[s] + 1e-9 for s in sizes)
    free = {"b": 2, "c": 1}  # what is left over is dealt by weight
    open_ = [s for s in sizes if goal[s] < 3 * sizes[s]]
    assert set(open_) <= {"b", "c", None, "é"}
    if {"b", "c"} <= set(open_):
        assert goal["b"] / goal["c"] == pytest.approx(free["b"] / free["c"])
    assert mixing.targets({}) == {}


def test_pairing_keeps_the_words_and_leaves_one_open():
    rng = random.Random(1)
    rows = [(str(i), rng.random(), rng.randrange(1, 50)) for i in range(200)]
    p = mixing.pair_off(rows, 3)
    assert sum(0 < x < 1 for x in p) <= 1
    assert sum(x * r[2] for x, r in zip(p, rows, strict=True)) == pytest.approx(sum(r[1] * r[2] for r in rows))


def test_pairing_is_fair():
    hits = [0.0, 0.0, 0.0]
    for seed in range(3000):
        for i, x in enumerate(mixing.pair_off([("a", 0.3, 2), ("b", 0.6, 5), ("c", 0.5, 1)], seed)):
            hits[i] += x / 3000
    assert hits == pytest.approx([0.3, 0.6, 0.5], abs=0.04)


def test_large_documents_are_settled_into_small_ones():
    """One document of 3,000 words and 200 of 20: what stays open is a small one, and every chance is kept."""
    rows = [("large", 0.5, 3000), *((f"s{i}", 0.5, 20) for i in range(200))]
    hits = np.zeros(len(rows))
    for seed in range(1500):
        p = mixing.pair_off(rows, seed)
        open_ = [r[2] for r, x in zip(rows, p, strict=True) if 0 < x < 1]
        assert len(open_) <= 1 and all(x == 20 for x in open_)
        hits += p / 1500
    assert hits[0] == pytest.approx(0.5, abs=0.05)
    assert hits[1:].mean() == pytest.approx(0.5, abs=0.01) and abs(hits[1:] - 0.5).max() < 0.08


@pytest.mark.parametrize("seed", range(5))
def test_pairing_keeps_mixed_chances(seed):
    rng = random.Random(seed)
    rows = sorted(((str(i), 0.25 + rng.random() / 2, rng.randrange(10, 30)) for i in range(12)), key=lambda r: -r[2])
    hits = sum(mixing.pair_off(rows, s) for s in range(4000)) / 4000
    off = abs(hits - [r[1] for r in rows])
    assert off[:6].max() < 0.04  # the last few go the way that is left


@pytest.mark.parametrize("seed", range(4))
def test_targets_of_a_table_are_those_of_a_dictionary(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:04d}": rng.choice([0, 1, 5, 100, 10_000, 10**6]) for i in range(300)} | {None: 77, "": 3}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, groups long").repartition(5)
    want = mixing.targets(sizes)
    got = {r.source: r.target for r in mixing.with_targets(df).collect()}
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
def test_each_source_comes_near_its_target(spark, scale):
    docs = spark.read.parquet(f"/root/testdata/sf{scale}/documents.parquet")
    worded = F.when(F.col("size") > 0, F.col("size"))
    for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.array_sort(F.collect_list(worded)).alias("sizes")).collect():
        assert abs(r.taken - r.target) <= max(0.004 * r.target, r.sizes[3])  # a few small documents


def test_one_row_very_often(spark, monkeypatch):
    """Nine rows in ten are one row: it is one group, its copies are dealt out evenly, and its rows are spread."""
    monkeypatch.setattr(mixing, "REPEAT_ROWS", 1000)
    docs = spark.range(30_000).selectExpr(
        "if(id < 27000, 1, id) doc_id", "if(id < 27000, 'a text of five words', concat('text ', id)) text", "if(id % 2 = 0 or id < 27000, 'a', 'b') source", "map('k', id) extra"
    )
    got = mixing.mix(docs).groupBy("doc_id").agg(F.min("taken").alias("low"), F.max("taken").alias("high"), F.count("*").alias("n"), F.sum("taken").alias("t"), F.max("source").alias("source"), F.max("target").alias("target")).collect()
    one = next(r for r in got if r.doc_id == 1)
    assert one.n == 27_000 and one.high - one.low <= 5
    for s in "ab":
        assert abs(sum(r.t for r in got if r.source == s) - max(r.target for r in got if r.source == s)) <= 5
    applied = mixing.apply_mix(docs)
    assert applied.columns == docs.columns
    assert applied.filter("doc_id = 1").count() * 5 == one.t
    again = lambda df: {r.k: r.n for r in mixing.apply_mix(df).groupBy(F.expr("cast(extra['k'] as long)").alias("k")).agg(F.count("*").alias("n")).collect()}
    few = docs.filter("doc_id < 27100 and extra['k'] > 26900")
    assert again(few) == again(few.repartition(7))


def run(docs):
    return sorted((str(r.doc_id), str(r.source), r.size, r.source_size, r.target, r.taken) for r in mixing.mix(docs).collect())


def test_documents(documents, rows, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_DOCS", 3)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    got = run(documents)
    assert got == run(documents.repartition(7))
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, source, size, _, _, t in got:
        sizes[source] += size
        taken[source] += t
        largest[source] = max(largest[source], size)
        assert t % max(size, 1) == 0 and t <= 3 * size
    goal = mixing.targets(dict(sizes))
    assert {r[0]: r[2] for r in got} == {str(r["doc_id"]): len(r["text"].encode().split()) for r in rows}
    for s, g in goal.items():
        assert abs(taken[s] - g) <= largest[s]
    assert all(r[3] == sizes[r[1]] and r[4] == pytest.approx(goal[r[1]]) for r in got)


def test_odd_rows(odd, none):
    got = run(odd)
    assert len(got) == odd.count()
    assert all(r[5] == 0 for r in got if r[2] == 0)
    assert {r[1] for r in got} == {"a", "b", "c", "", "None"}
    assert mixing.mix(none).count() == 0
    applied = mixing.apply_mix(odd)
    assert applied.columns == odd.columns
    assert sum(len(r.text.encode().split()) for r in applied.collect()) == sum(r[5] for r in got)
    assert mixing.apply_mix(none).count() == 0
