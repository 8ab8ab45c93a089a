import os

import pytest

from tessera.streaming import judge_stream

SCHEMA = "signature string, query_id string, passage_id string, query string, passage_text string"


def counted(log, fail_after=None):
    """A grader that writes down each prompt it grades, and dies after some."""

    def make():
        def grade(prompt, budget):
            if fail_after is not None and sum(1 for _ in open(log)) >= fail_after:
                return "no digit"
            with open(log, "a") as f:
                f.write(prompt.rpartition("Passage:\n")[2] + "\n")
            return str(len(prompt) % 4)

        return grade

    return make


@pytest.fixture
def at(tmp_path):
    log = tmp_path / "graded.txt"
    log.touch()
    return [str(tmp_path / name) for name in ("pairs", "judged", "state")] + [str(log)]


def pairs(spark, ids, signature="m::v3"):
    return spark.createDataFrame([(signature, "q", str(i), "late night", f"passage {'x' * (i % 7)} {i}") for i in ids], SCHEMA)


def test_a_killed_run_resumes_and_grades_no_flushed_pair_again(spark, at):
    source, sink, state, log = at
    for i in range(0, 60, 20):  # three files, a flush each
        judge_stream.land(pairs(spark, range(i, i + 20)).coalesce(1), source)
        os.utime(source)
    with pytest.raises(Exception, match="no grade in"):
        judge_stream.judge_new(spark, source, sink, state, counted(log, fail_after=30), files_per_batch=1)
    flushed = {r.passage_id for r in judge_stream.read_judged(spark, sink).collect()}
    assert len(flushed) == 20
    judge_stream.judge_new(spark, source, sink, state, counted(log), files_per_batch=1)
    rows = judge_stream.read_judged(spark, sink).collect()
    assert len(rows) == 60 == len({r.passage_id for r in rows}) and all(r.fresh and r.asked == 1 for r in rows)
    graded = [line.split()[-1] for line in open(log)]
    assert all(graded.count(x) == 1 for x in flushed) and set(graded) == {str(i) for i in range(60)}
    # What was asked before has its grade from the state; another signature has not.
    judge_stream.land(pairs(spark, range(10)).unionAll(pairs(spark, range(3), "m::v2")), source)
    judge_stream.judge_new(spark, source, sink, state, counted(log))
    again = [r for r in judge_stream.read_judged(spark, sink).collect() if not r.fresh or r.signature == "m::v2"]
    first = {r.passage_id: r.grade for r in rows}
    assert len(again) == 13 and all(r.grade == first[r.passage_id] and r.fresh == (r.signature == "m::v2") for r in again)
    assert len(open(log).readlines()) == len(graded) + 3
    judge_stream.judge_new(spark, source, sink, state, counted(log))  # nothing new
    assert judge_stream.cache(judge_stream.read_judged(spark, sink)).count() == 63


def test_seeds_repeats_and_odd_rows(spark, at):
    source, sink, state, log = at
    many = [("s", "q", "1", "r", "same", None)] * 300
    odd = [(None, None, None, None, None, None), ("s", "q", "2", "r", "known", None), ("s", "q", "2", "r", "known", 3), ("s", "q", "2", None, None, 1), ("s", "q", "3", "r", "b", None), ("s", "q", "3", "r", "a", None), ("s", "q", "4", None, None, 2)]
    long = [("s", "q", "5", "r", "w " * 200_000, None)]
    judge_stream.land(spark.createDataFrame(many + odd + long, judge_stream.PAIRS), source, flush=None)
    judge_stream.judge_new(spark, source, sink, state, counted(log))
    rows = {r.passage_id: (r.asked, r.fresh) for r in judge_stream.read_judged(spark, sink).collect()}
    assert rows == {"1": (300, True), None: (1, True), "2": (1, False), "3": (2, True), "5": (1, True)}
    assert {r.passage_id: r.grade for r in judge_stream.read_judged(spark, sink).collect()}["2"] == 3
    graded = [line.strip() for line in open(log)]
    assert len(graded) == 4 and "a" in graded and "b" not in graded
    judge_stream.land(spark.createDataFrame([], SCHEMA), source)
    judge_stream.land(spark.createDataFrame([("s", "q", "4", "r", "x", None), ("s", "q", "2", "r", "x", 0), ("s", "q", "2", "r", "x", None)], judge_stream.PAIRS), source)
    judge_stream.judge_new(spark, source, sink, state, counted(log))
    last = {r.passage_id: r.grade for r in judge_stream.read_judged(spark, sink).filter("not fresh").collect()}
    assert last == {"2": 3, "4": 2} and len(open(log).readlines()) == len(graded)
