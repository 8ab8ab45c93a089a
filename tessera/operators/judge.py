"""Grading passages with a cache of judgments in front of a grader."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.constants import TOKEN_BUDGETS

#: (prompt, token budget) -> reply.
Grader = Callable[[str, int], str]


def overlap_grader() -> Grader:
    """An offline grader: how many of a request's words its passage has."""

    def grade(prompt: str, budget: int) -> str:
        request, _, passage = prompt.partition("Request: ")[2].partition("\n\nPassage:\n")
        wanted = set(request.lower().split())
        share = len(wanted & set(passage.lower().split())) / max(1, len(wanted))
        return str(min(3, int(share * 4)))

    return grade


def split_cache(pairs: DataFrame, cache: DataFrame, signature: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their grade, misses) of pairs (query_id, passage_id) under one signature."""
    known = cache.filter(F.col("signature") == signature).select("query_id", "passage_id", "grade")
    return pairs.join(known, ["query_id", "passage_id"]), pairs.join(known, ["query_id", "passage_id"], "left_anti")


def attempt(grader: Grader, prompt: str, budgets: tuple[int, ...] = TOKEN_BUDGETS) -> int:
    """E5: the last digit that is a grade in the first reply that has one; an error after all attempts."""
    for budget in budgets:
        reply = grader(prompt, budget)
        digits = [t for t in "".join(c if c.isalnum() or c == "_" else " " for c in reply).split() if t in ("0", "1", "2", "3")]
        if digits:
            return int(digits[-1])
    raise ValueError(f"no grade in {reply!r}")


def grade(pairs: DataFrame, make_grader: Callable[[], Grader] = overlap_grader, budgets: tuple[int, ...] = TOKEN_BUDGETS) -> DataFrame:
    """E5: adds ``grade`` to pairs with a query and passage_text; no grade after all attempts fails the job."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grader = make_grader()
        for prompts in batches:
            yield prompts.map(lambda p: attempt(grader, p, budgets))

    return pairs.withColumn("grade", run(text.judge_prompt(F.col("query"), F.col("passage_text"))))


def judge_all(pairs: DataFrame, cache: DataFrame, signature: str, make_grader: Callable[[], Grader] = overlap_grader) -> tuple[DataFrame, DataFrame]:
    """(all graded pairs, rows to append to the cache)."""
    hits, misses = split_cache(pairs, cache, signature)
    graded = grade(misses, make_grader)
    return hits.unionByName(graded.select(*hits.columns)), graded.select(F.lit(signature).alias("signature"), "query_id", "passage_id", "grade")


def repeat_rate(first: DataFrame, second: DataFrame) -> DataFrame:
    """How often a grader repeats itself."""
    both = first.select("query_id", "passage_id", F.col("grade").alias("g1")).join(second.select("query_id", "passage_id", F.col("grade").alias("g2")), ["query_id", "passage_id"])
    return both.agg(F.count("*").alias("n"), F.avg((F.col("g1") == F.col("g2")).cast("double")).alias("repeat_rate"))


def credible_stats(report: DataFrame, version: str) -> DataFrame:
    """Of a version's statistics those of the last batch, the held-out one."""
    w = Window.partitionBy("version").orderBy(F.desc("batch"))
    return report.filter(F.col("version") == version).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
