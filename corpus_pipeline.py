"""A corpus pipeline of five operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next stage's ``docs``. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, mixing, similar, substrings
from tessera.llm.common import column, row_of
from tessera.storage import discard, persist_only, table

def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some learnt language stay; ``lang`` is the one predicted.

    Rejected are null texts, texts without a letter and those whose score is
    too low for their length (``langid.least_scores``). Repeated rows are judged each; a null ``lang``
    is filled in. With no row to learn from, all are rejected. Texts are scored
    twice, for the least scores and for the outcome: a table of all of them
    with their scores would take as much disk as the input.
    """
    names, model = docs.columns, langid.fit(docs)
    sizes = langid.predict(docs.select("text", F.length("text").alias("size")), model, ["size"])
    least = langid.least_scores(sizes, "_row.text", "size")
    scored = langid.predict(docs.select(row_of(docs), "text"), model, ["_row"])
    kept = scored.filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return kept.select(*(F.col("lang_pred").alias("lang") if c == "lang" else column(c, "_row") for c in names))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, exact: bool = False) -> DataFrame:
    """One document of each group stays whose five-word shingles are similar by 0.8 or more.

    Groups are found by SimHash tries and verified with whole shingle sets.
    Texts without a word, nulls among them, are one group, and so are repeated
    rows; the least (doc_id, content) stays. No rows give no rows. ``exact``
    finds every similar pair; without it few are missed (``similar``).
    """
    return similar.keep_one(docs, exact)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier are cut; texts left without a word go.

    So do null and empty texts. Of a passage the place with the least
    (doc_id, text, byte) stays; rows alike in id and text are one document.
    """
    return substrings.remove(docs).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts are not taken; a null source is one of its own; rows
    alike share their copies evenly. No rows give no rows.
    """
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, with their digests.

    A null text has no ids; repeated rows are encoded each; no rows give none.
    """
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, ["doc_id", "lang", "source"], with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: No SQL expresses these stages; they are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str, exact: bool = False) -> DataFrame:
    """All stages over ``documents``; with ``exact`` near-duplicates are found without a miss."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage = partial(stage, exact=True) if exact and stage is drop_near_duplicates else stage
        before, docs = docs, persist_only(partial(stage, spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
