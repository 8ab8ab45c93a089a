"""Replayed sessions against a stack held key by key."""

import random

import pytest

from tessera.operators import replay

SCHEMA = "who string, session long, seq long, key string"


def by_hand(keys, n):
    """(place, session, seq, key) of one list's keys in order."""
    stack, floor, now, quit_ = [], 0, None, False
    for session, seq, key in sorted(keys):
        if session != now:
            floor, now, quit_ = len(stack), session, False
        if quit_ or len(stack) >= n:
            continue
        if key in "kd":
            stack.append((session, seq, key))
        elif key == "u" and len(stack) > floor:
            stack.pop()
        elif key == "q":
            quit_ = True
    return [(i, *x) for i, x in enumerate(stack, 1)]


def items(spark, sizes):
    return spark.createDataFrame([(w, i) for w, n in sizes.items() for i in range(1, n + 1)], "who string, item long")


@pytest.mark.parametrize("parts", [1, 7])
def test_random_logs(spark, parts):
    """One list has most of the keys, and ranges cut its sessions."""
    rng = random.Random(3)
    sizes = {"a": 400, "b": 5, "c": 60, None: 30}
    log = {w: [(s, i, rng.choice("kkdduuuqx" if rng.random() < 0.05 else "kkduux")) for s in range(4) for i in range(n)] for w, n in (("a", 300), ("b", 12), ("c", 20), (None, 8))}
    rows = [(w, *k) for w, ks in log.items() for k in ks]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = replay.replay(spark.createDataFrame(rows, SCHEMA), items(spark, sizes), ["who"], ["item"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected = {(w, *x) for w, ks in log.items() for x in by_hand(ks, sizes[w])}
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def one(spark, keys, n=3, **more):
    log = spark.createDataFrame([("a", s, i, k) for i, (s, k) in enumerate(keys)], SCHEMA)
    return [(r["item"], r["key"]) for r in sorted(replay.replay(log, items(spark, {"a": n}), ["who"], ["item"], **more).collect())]


def test_undo_quit_and_resume(spark):
    assert one(spark, [(1, "u"), (1, "K"), (1, "u"), (1, "u"), (1, "d")]) == [(1, "d")]
    assert one(spark, [(1, "k"), (1, "q"), (1, "u"), (2, "u"), (2, "d")]) == [(1, "k"), (2, "d")]
    assert one(spark, [(1, "k"), (1, "k"), (1, "u"), (1, "x"), (1, "d")]) == [(1, "k"), (2, "d")]


def test_nothing_is_taken_back_once_all_are_decided(spark):
    assert one(spark, [(1, "k"), (1, "d"), (1, "u"), (1, "k"), (1, "k"), (1, "u"), (2, "u"), (2, "d")]) == [(1, "k"), (2, "k"), (3, "k")]


def test_items_decided_before_are_skipped(spark):
    earlier = spark.createDataFrame([(1,), (1,), (9,)], "item long")
    assert one(spark, [(1, "k"), (1, "d"), (1, "k")], decided=earlier, on=["item"]) == [(2, "k"), (3, "d")]


def test_nulls_repeats_and_empty_tables(spark):
    rows = [("a", 1, 1, "k"), ("a", 1, 1, "k"), ("a", 1, 2, None), ("a", None, 3, "k"), ("a", 1, None, "k"), ("z", 1, 1, "k")]
    log = spark.createDataFrame(rows, SCHEMA)
    some = items(spark, {"a": 2})
    assert [tuple(r) for r in replay.replay(log, some, ["who"], ["item"]).collect()] == [("a", 1, 1, 1, "k")]
    assert not replay.replay(log.limit(0), some, ["who"], ["item"]).collect()
    assert not replay.replay(log, some.limit(0), ["who"], ["item"]).collect()


def test_a_second_round_needs_the_whole_first(spark):
    pairs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4)], "who string, item long")
    log = spark.createDataFrame([("a", 1, 1, "3"), ("a", 1, 2, "0"), ("b", 1, 1, "2")], SCHEMA)
    once = replay.first_round(pairs, log, "who", ["item"])
    assert {(r["item"], r["grade"]) for r in once.collect()} == {(1, 3), (2, 0), (3, 2), (4, None)}
    again = spark.createDataFrame([("a", 1, 1, "1"), ("a", 1, 2, "u"), ("a", 1, 3, "2"), ("a", 1, 4, "1"), ("b", 1, 1, "2")], SCHEMA)
    twice = {r["item"]: r["regrade"] for r in replay.second_round(once, again, "who", "item", seed=1).collect()}
    assert sorted(twice[i] for i in (1, 2)) == [1, 2] and twice[3] is None and twice[4] is None
