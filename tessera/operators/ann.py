"""V8: an index of vectors for approximate search: partitioned inverted lists.

Vectors of unit length are dealt to the nearest of some centres, which are
fitted on a bounded sample; every row is indexed. A search reads the lists of
the centres nearest to its query and scores their rows exactly, so only the
choice of lists is approximate, and with all lists the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.operators.semantic import boosted, cosine, topk_batch

#: Rows that the centres are fitted on, and rounds of fitting.
SAMPLE, ROUNDS, SEED = 20_000, 10, 7
#: Rows that a list should hold, and how many lists there may be: the driver holds the centres.
LIST_ROWS, MOST_LISTS = 10_000, 4096


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-300)


def fit(df: DataFrame, vector_column: str, lists: int | None = None) -> np.ndarray:
    """Centres of about as many lists as the rows need, by spherical k-means on at most ``SAMPLE`` rows.

    The sample is the rows with the least hashes of their vectors, so it is
    the same for the same rows. Without rows there is one centre, zero.
    """
    rows = df.filter(F.col(vector_column).isNotNull()).select(F.col(vector_column).alias("v"))
    if lists is None:
        lists = min(MOST_LISTS, max(8, round((rows.count() / LIST_ROWS) ** 0.5 * 4)))
    got = rows.orderBy(F.xxhash64(F.lit(SEED), "v")).limit(SAMPLE).toArrow()
    if not got.num_rows:
        return np.zeros((1, 1))
    v = _unit(np.stack([np.asarray(x, dtype=np.float64) for x in got.column("v").to_pylist()]))
    centres = v[np.random.default_rng(SEED).choice(len(v), min(lists, len(v)), replace=False)]
    for _ in range(ROUNDS):
        own = (v @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        used = np.bincount(own, minlength=len(centres)) > 0
        centres[used] = _unit(sums[used])
    return centres


def assign(df: DataFrame, vector_column: str, centres: np.ndarray) -> DataFrame:
    """``df`` with ``list``, the nearest centre of each row's vector; rows without one drop out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(vector_column)
            v = np.stack([np.asarray(x, dtype=np.float64) for x in batch.column(at).to_pylist()]) if batch.num_rows else np.zeros((0, centres.shape[1]))
            own = (_unit(v) @ centres.T).argmax(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], [*batch.schema.names, "list"])

    rows = df.filter(F.col(vector_column).isNotNull())
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("list", IntegerType())]))


def build(df: DataFrame, vector_column: str, path: str, lists: int | None = None) -> np.ndarray:
    """Write every row below ``path``, a folder for each list, and give the centres."""
    centres = fit(df, vector_column, lists)
    indexed = assign(df, vector_column, centres)
    # A list may hold a third of all rows: each is spread over some files by a hash.
    indexed.repartition("list", F.pmod(F.xxhash64(vector_column), F.lit(8))).write.partitionBy("list").parquet(path)
    return centres


def probes(centres: np.ndarray, vector: list[float], share: float) -> list[int]:
    """The lists to read for a query: the nearest ``share`` of them, at least one; 1.0 is an exact search."""
    near = np.argsort(-(centres @ _unit(np.asarray(vector, dtype=np.float64))), kind="stable")
    return sorted(near[: max(1, ceil(len(near) * share))].tolist())


def share_for(index: DataFrame, centres: np.ndarray, id_column: str, vector_column: str, k: int = 10, recall: float = 0.95, sample: int = 100) -> float:
    """The least share of lists that holds ``recall`` of the k nearest rows of some rows taken as queries.

    Measured against an exact search for at most ``sample`` queries, so the
    share suits the data: rows in clear groups need few lists, rows without
    any order nearly all.
    """
    asked = index.orderBy(F.xxhash64(F.lit(SEED), id_column)).limit(sample)
    queries = asked.select(F.col(id_column).alias("query_id"), F.col(vector_column).alias("query_vector"), F.lit(None).cast("string").alias("query_language"))
    nearest = topk_batch(index.withColumn("language", F.lit(None).cast("string")), queries, k, id_column, vector_column)
    listed = nearest.select("query_id", F.col("id").alias("_found")).join(index.select(F.col(id_column).alias("_found"), "list"), "_found")
    order = {r["query_id"]: np.argsort(np.argsort(-(centres @ _unit(np.asarray(r["query_vector"], dtype=np.float64))), kind="stable")) for r in queries.collect()}
    places = sorted(int(order[r["query_id"]][r["list"]]) for r in listed.collect())
    return (places[ceil(recall * len(places)) - 1] + 1) / len(centres) if places else 1.0


def topk(
    index: DataFrame, centres: np.ndarray, vector: list[float], k: int, id_column: str, vector_column: str, share: float,
    language_column: str | None = None, language: Column | str | None = None,
) -> DataFrame:
    """The k best rows as (id, score) among the lists nearest to the query, ties by id.

    ``index`` is the table that ``build`` wrote, read back: only the folders
    of those lists are scanned. ``share`` as ``share_for`` measured it; 1.0
    gives what an exact search does.
    """
    score = cosine(F.col(vector_column), F.array(*(F.lit(float(x)) for x in vector)))
    if language_column:
        score = boosted(score, F.col(language_column), language)
    wanted = index.filter(F.col("list").isin(*probes(centres, vector, share)))
    scored = wanted.withColumn("score", F.round(score, 6)).filter("score is not null")
    return scored.orderBy(F.desc("score"), id_column).limit(k)
