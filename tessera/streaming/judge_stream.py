"""Pairs graded as they arrive, with the judgments made so far as the stream's state.

A pair's grade is kept under (signature, query, passage). A pair that is asked
again, in the same micro-batch or after a restart, has its grade from there; a
grader is asked only for what has none. Micro-batches are the flush: what a
killed run had graded up to its last whole batch is never graded again, and
the sink's log shows each batch's rows once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions import text
from tessera.functions.constants import TOKEN_BUDGETS
from tessera.operators import judge

#: What a file of pairs holds. A row with a grade is a judgment made elsewhere: it seeds the cache and asks nothing.
PAIRS = "signature string, query_id string, passage_id string, query string, passage_text string, grade int"
#: One row for each pair that a micro-batch asked for: how often, and whether the grader was asked.
JUDGED = "signature string, query_id string, passage_id string, grade int, asked long, fresh boolean"
KEY = ["signature", "query_id", "passage_id"]
#: Pairs of one file that ``land`` writes, so of one flush where a batch takes one file.
FLUSH = 20
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def land(pairs: DataFrame, folder: str, flush: int | None = FLUSH) -> None:
    """Add pairs to the folder that a stream reads, at most ``flush`` a file; None leaves files as they come."""
    rows = pairs if "grade" in pairs.columns else pairs.withColumn("grade", F.lit(None).cast("int"))
    names = [c.split()[0] for c in PAIRS.split(", ")]
    rows.select(*names).write.mode("append").option("maxRecordsPerFile", flush or 0).parquet(folder)


def _processor(make_grader: Callable[[], judge.Grader], budgets: tuple[int, ...]) -> Callable:
    made: list[judge.Grader] = []

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get[0] if state.exists else None
        asked, prompt, given = 0, None, []
        for rows in batches:  # a pair asked very often comes in pieces; only its count is kept
            ask = rows["grade"].isna()
            asked += int(ask.sum())
            if ask.any():
                least = rows.loc[ask, "prompt"].min()
                prompt = least if prompt is None else min(prompt, least)
            if not ask.all():
                given.append(int(rows.loc[~ask, "grade"].max()))
        grade = known if known is not None else max(given, default=None)
        fresh = grade is None
        if fresh:
            if not made:
                made.append(make_grader())
            grade = judge.attempt(made[0], prompt, budgets)
        if known is None:
            state.update((grade,))
        if asked:
            yield pd.DataFrame({c: [v] for c, v in zip([*KEY, "grade", "asked", "fresh"], [*key, grade, asked, fresh], strict=True)})

    return run


def judge_new(
    spark: SparkSession, source: str, sink: str, checkpoint: str,
    make_grader: Callable[[], judge.Grader] = judge.overlap_grader, version: str = "v3", files_per_batch: int = 100, budgets: tuple[int, ...] = TOKEN_BUDGETS,
) -> None:
    """Judge all files of ``source`` that earlier calls haven't finished, appending ``JUDGED`` rows to ``sink``.

    Takes what is there and stops. A grader that gives no grade after all
    attempts fails the run, which makes up nothing; the next call resumes at
    the batch that failed. Null texts are empty texts, null parts of a key are
    a key of their own. Of several texts under one key in a batch the least
    prompt is graded, of several judgments that seed it the greatest counts,
    and a grade that is known never changes. Prompts are made by expressions,
    and the state is in RocksDB below ``checkpoint``, so it may outgrow memory.
    """
    pairs = spark.readStream.schema(PAIRS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    prompt = text.judge_prompt(F.coalesce("query", F.lit("")), F.coalesce("passage_text", F.lit("")), version=version)
    asked = pairs.select(*KEY, "grade", F.when(F.col("grade").isNull(), prompt).alias("prompt"))
    judged = asked.groupBy(*KEY).applyInPandasWithState(_processor(make_grader, budgets), JUDGED, "grade int", "append", GroupStateTimeout.NoTimeout)
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        stream = judged.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before)
    stream.awaitTermination()


def read_judged(spark: SparkSession, sink: str) -> DataFrame:
    """What all calls have appended; batches that did not end are not seen."""
    return spark.read.schema(JUDGED).parquet(sink)


def cache(judged: DataFrame) -> DataFrame:
    """(signature, query_id, passage_id, grade) of the judgments that this stream's grader made, as ``judge.split_cache`` takes them."""
    return judged.filter("fresh").select(*KEY, "grade")
