"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

A 64-bit code is cut into ``SEGMENTS`` segments, each with an index from its
value to the codes that have it. For a query the values within radius 0 of its
segments are looked up, then those at radius 1, and so on. After radius r every
code within ``SEGMENTS * (r + 1) - 1`` bits has been met, since one of its
segments differs by r bits at most; a query is done when its kth distance so
far is no more than that. Every code met is verified by its full distance.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import persist

SEGMENTS, WIDTH = 4, 16
#: Codes and queries of a block: what one task holds; queries that are searched at once; the fewest worth a block.
INDEX_BLOCK, QUERY_BLOCK, AT_ONCE, LEAST_QUERIES = 4_000_000, 1 << 20, 8192, 256
#: Codes that are verified at once.
PORTION = 1 << 21


def sign_code(vector: Column, dimensions: int = 64) -> Column:
    """A long with bit i set where component i is above 0; missing components count as 0."""
    bits = [F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(dimensions)]
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
    return bits[0]


def _patterns(radius: int) -> np.ndarray:
    """All 16-bit values with ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), radius)], dtype=np.uint64)


_MASK = np.uint64((1 << WIDTH) - 1)
_SHIFTS = tuple(np.uint64(WIDTH * s) for s in range(SEGMENTS))


def segment_tables(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each segment the positions of codes by its value, and where each value begins."""
    tables = []
    for s in _SHIFTS:
        value = (codes >> s & _MASK).astype(np.uint16)
        begin = np.concatenate(([0], np.cumsum(np.bincount(value, minlength=1 << WIDTH))))
        tables.append((np.argsort(value, kind="stable").astype(np.int32), begin))
    return tables


def search(codes: np.ndarray, order: np.ndarray, queries: np.ndarray, k: int, tables: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, position, distance) of each query's k nearest codes.

    ``codes`` and ``queries`` are uint64; of codes at one distance those with
    the least ``order`` come first.
    """
    mask, shift, tables = _MASK, _SHIFTS, tables or segment_tables(codes)
    best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    active = np.arange(len(queries))
    for radius in range(WIDTH + 1):
        if not len(active):
            break
        patterns = _patterns(radius)
        for s in range(SEGMENTS):
            by, begin = tables[s]
            rows = max(1, PORTION // max(1, len(patterns) * (1 + len(codes) // (1 << WIDTH))))
            for a in range(0, len(active), rows):
                q = active[a : a + rows]
                probe = ((queries[q] >> shift[s] & mask)[:, None] ^ patterns[None, :]).astype(np.int64)
                low, high = begin[probe].ravel(), begin[probe + 1].ravel()
                size = high - low
                total = int(size.sum())
                if not total:
                    continue
                at = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(total)
                found, query = by[at], np.repeat(np.repeat(q, len(patterns)), size)
                differ = codes[found] ^ queries[query]
                # Met here for the first time: no earlier segment is as near, no later one nearer.
                fresh = np.ones(total, dtype=bool)
                for j in range(SEGMENTS):
                    if j != s:
                        fresh &= np.bitwise_count(differ >> shift[j] & mask) >= radius + (j < s)
                found, query, distance = found[fresh], query[fresh], np.bitwise_count(differ[fresh]).astype(np.int64)
                best = _nearest(np.concatenate((best[0], query)), np.concatenate((best[1], found)), np.concatenate((best[2], distance)), order, k)
        count = np.bincount(best[0], minlength=len(queries))
        worst = np.zeros(len(queries), dtype=np.int64)
        np.maximum.at(worst, best[0], best[2])
        covered = SEGMENTS * (radius + 1) - 1
        over = (count >= min(k, len(codes))) & (worst <= covered)
        ended = over[best[0]]
        done.append(tuple(x[ended] for x in best))
        best = tuple(x[~ended] for x in best)
        active = active[~over[active]]
    none = np.empty(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in zip(*done, strict=True)) if done else (none, none, none)


def _nearest(query: np.ndarray, found: np.ndarray, distance: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    by = np.lexsort((order[found], distance, query))
    query, found, distance = query[by], found[by], distance[by]
    head = np.concatenate(([True], query[1:] != query[:-1])) if len(query) else np.empty(0, bool)
    rank = np.arange(len(query)) - np.maximum.accumulate(np.where(head, np.arange(len(query)), 0))
    return query[rank < k], found[rank < k], distance[rank < k]


def top_k(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, distance): the k codes nearest to each query, exactly.

    Both tables are (id long, code long); rows with a null are left out. Of
    codes at one distance the lesser ids come first; a row that is both query
    and code finds itself. Repeated rows count each. With fewer than k codes
    all are returned; an empty table on either side gives an empty result.

    Equal codes are gathered first: of each code only the k least ids can be
    in a result, and equal queries have one answer. Blocks of distinct codes
    meet blocks of distinct queries, each pair in one task that sends on k
    rows a query.
    """
    spark = index.sparkSession
    of_code = Window.partitionBy("code").orderBy("id")
    kept = index.filter("id is not null and code is not null").select("id", "code").withColumn("n", F.row_number().over(of_code)).filter(F.col("n") <= k)
    codes = persist(kept.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    asked = persist(queries.filter("id is not null and code is not null").select(F.col("id").alias("query_id"), "code"), "queries")
    distinct = asked.select("code").distinct()
    n_codes, n_queries = codes.count(), distinct.count()
    index_blocks = max(1, math.ceil(n_codes / INDEX_BLOCK))
    # Every code is sent once for each block of queries: as few as memory allows, or as keep all cores busy.
    busy = math.ceil(spark.sparkContext.defaultParallelism / index_blocks)
    query_blocks = max(1, math.ceil(n_queries / QUERY_BLOCK), min(busy, math.ceil(n_queries / LEAST_QUERIES)))
    number = lambda n: F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    least = F.get("ids", F.lit(0))
    rows = codes.select("code", least.alias("first"), F.lit(False).alias("asks"), number(index_blocks).alias("index_block"), spread(query_blocks).alias("query_block"))
    asks = distinct.select("code", F.lit(0).cast("long").alias("first"), F.lit(True).alias("asks"), spread(index_blocks).alias("index_block"), number(query_blocks).alias("query_block"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_query = pdf["asks"].to_numpy()
        code = pdf["code"].to_numpy().view(np.uint64)
        own, wanted = code[~is_query], code[is_query]
        order = pdf["first"].to_numpy()[~is_query]
        tables = segment_tables(own)
        parts = [(a, search(own, order, wanted[a : a + AT_ONCE], k, tables)) for a in range(0, len(wanted), AT_ONCE)]
        query, found, distance = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*((a + q, f, d) for a, (q, f, d) in parts), strict=True)) if parts else np.empty((3, 0), np.int64)
        return pd.DataFrame({"query_code": wanted[query].view(np.int64), "code": own[found].view(np.int64), "distance": distance.astype(np.int32)})

    near = rows.unionByName(asks).groupBy("index_block", "query_block").applyInPandas(run, "query_code long, code long, distance int")
    # k distinct codes of each query suffice; then their ids, at most k for each.
    by_code = Window.partitionBy("query_code").orderBy("distance", "first")
    first = codes.select("code", least.alias("first"), "ids")
    near = near.join(first, "code").withColumn("n", F.row_number().over(by_code)).filter(F.col("n") <= k)
    named = near.select("query_code", "distance", F.explode("ids").alias("id"))
    rank = F.row_number().over(Window.partitionBy("query_code").orderBy("distance", "id"))
    answer = named.withColumn("rank", rank).filter(F.col("rank") <= k)
    return asked.join(answer, F.col("code") == F.col("query_code")).select("query_id", "rank", "id", "distance")
