"""Search by vector: exact cosine over all rows, with a boost for one language."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.constants import LANGUAGE_BOOST, MAX_K, MIN_K, MULTILINGUAL, QUERY_LANGUAGES

#: Query vectors of one broadcast, and of one product.
QUERY_BLOCK, TILE = 16_384, 256


def dot(a: Column, b: Column) -> Column:
    """Σ a_i b_i in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """V2: null where a vector is null or zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def boosted(similarity: Column, language: Column, wanted: Column | str | None, boost: float = LANGUAGE_BOOST) -> Column:
    """V3: more for the wanted language; null on either side adds nothing."""
    if wanted is None:
        return similarity
    return similarity + F.when(language == wanted, boost).otherwise(0.0)


def topk(df: DataFrame, vector: list[float], k: int, id_column: str, vector_column: str, language_column: str | None = None, language: str | None = None) -> DataFrame:
    """K1: the k best rows as (id, score), ties by id; rows without a vector are no candidates.

    The query is a literal of one vector, and each task keeps its own k best.
    """
    query = F.array(*(F.lit(float(x)) for x in vector))
    score = cosine(F.col(vector_column), query)
    if language_column:
        score = boosted(score, F.col(language_column), language)
    scored = df.filter(F.col(vector_column).isNotNull()).withColumn("score", F.round(score, 6)).filter("score is not null")
    return scored.orderBy(F.desc("score"), id_column).limit(k)


def topk_batch(df: DataFrame, queries: DataFrame, k: int, id_column: str, vector_column: str) -> DataFrame:
    """The k best rows of every query (query_id, query_vector, query_language), ties by id.

    A stated query set against all rows: queries are read in blocks of
    ``QUERY_BLOCK`` vectors, the size of one broadcast, and each block is one
    pass over the rows. A task multiplies a batch of rows with some queries at
    a time, takes each query's k best of the batch by a partial sort and
    merges them into those it has, so what is shuffled is k rows a query and
    task. Rows without a vector are no candidates.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(vector_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"), F.col("language"))
    out = spark.createDataFrame([], "query_id long, id long, score double")
    block = []
    for row in chain(queries.select("query_id", "query_vector", "query_language").toLocalIterator(), [None]):
        if row is not None:
            block.append(row)
        if block and (row is None or len(block) == QUERY_BLOCK):
            out = out.unionByName(_search(rows, block, k))
            block = []
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def _search(rows: DataFrame, block: list, k: int) -> DataFrame:
    """(query_id, id, score): each task's k best rows of each query of a block."""
    q = np.array([r["query_vector"] for r in block], dtype=np.float64)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    names, wanted = np.array([r["query_id"] for r in block]), [r["query_language"] for r in block]
    shared = rows.sparkSession.sparkContext.broadcast((names, q, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, wanted = shared.value
        score = np.full((len(q), k), -np.inf)
        best = np.full((len(q), k), np.iinfo(np.int64).max)
        kinds = sorted({w for w in wanted if w is not None})
        of_query = np.array([kinds.index(w) + 1 if w is not None else 0 for w in wanted])
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)
            norm = np.linalg.norm(v, axis=1)
            v /= np.maximum(norm, 1e-300)[:, None]
            place = {x: i + 1 for i, x in enumerate(kinds)}
            of_row = np.array([place.get(x, -1) for x in batch.column(2).to_pylist()])
            for a in range(0, len(q), TILE):
                part = slice(a, a + TILE)
                found = q[part] @ v.T + LANGUAGE_BOOST * (of_query[part, None] == of_row[None, :])
                found = np.where(norm > 0, np.round(found, 6), -np.inf)
                top = min(k, len(ids))
                # Everything at least as good as the kth, so that ties are settled by id.
                least = np.partition(found, -top, axis=1)[:, -top]
                at, row = np.nonzero(found >= np.maximum(least, score[part, -1])[:, None])
                all_query = np.concatenate((np.repeat(np.arange(len(found)), k), at))
                all_score = np.concatenate((score[part].ravel(), found[at, row]))
                all_id = np.concatenate((best[part].ravel(), ids[row]))
                order = np.lexsort((all_id, -all_score, all_query))
                sizes = np.bincount(all_query)
                first = np.repeat(np.cumsum(sizes) - sizes, k) + np.tile(np.arange(k), len(found))
                score[part], best[part] = all_score[order[first]].reshape(-1, k), all_id[order[first]].reshape(-1, k)
        real = np.isfinite(score)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, real.sum(1))), pa.array(best[real]), pa.array(score[real])], ["query_id", "id", "score"])

    return rows.mapInArrow(run, "query_id long, id long, score double")


def depth(k: int) -> int:
    """K7: how many passages to fetch so that k songs are left."""
    return min(max(4 * k, 40), 200)


def clamp_k(k: int) -> int:
    """F16."""
    return max(MIN_K, min(MAX_K, k))


def check_query(query: str) -> str:
    """F16: a blank query is an error."""
    if not query.strip():
        raise ValueError("the query is blank")
    return query


def route(detected: str | None, multilingual: bool = True) -> tuple[str, str | None]:
    """V4, V5: (which vectors to search, which language to boost) for a query's language."""
    if detected in MULTILINGUAL:
        return ("multilingual", detected) if multilingual else ("base", None)
    return "base", detected if detected in QUERY_LANGUAGES else None


def route_label(detected: str | None) -> str:
    """V7: what a user sees of it."""
    return detected if detected in QUERY_LANGUAGES else "unknown"


def best_per_parent(ranked: DataFrame, parent: list[str], order: list[Column], k: int) -> DataFrame:
    """Each parent's best row, the k best of those, ranked anew.

    ``ranked`` is the outcome of a top-k search, at most 200 rows.
    """
    best = ranked.withColumn("_rn", F.row_number().over(Window.partitionBy(*parent).orderBy(*order))).filter("_rn = 1").drop("_rn")
    cut = best.orderBy(*order).limit(k)
    return cut.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def with_parents(ranked: DataFrame, parents: DataFrame, parent_id: str) -> DataFrame:
    """parents' columns for ranked rows; a rank whose row is gone stays a gap."""
    return ranked.join(parents, parent_id)
