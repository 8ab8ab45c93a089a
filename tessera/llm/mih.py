"""Approximate nearest neighbours by cosine: multi-index hashing of learnt binary codes.

Vectors of unit length are rotated and cut at zero to codes of ``BITS`` bits.
The rotations are learnt on a bounded sample so that little is lost by the
cut. A code is split into substrings of 16 bits, each with an index from its
value to the rows that have it. If two codes of m substrings differ in at
most R = m * a + b bits (b < m), then in one of the first b + 1 substrings they
differ in a bits or fewer, or in one of the others in a - 1 or fewer: all rows
within R bits of a query are found by probing those. They are reranked by
the cosine of the original vectors.

R is measured, not assumed: an exact search for some queries tells how far
the codes of true neighbours lie apart, and R holds ``SHARE`` of them. A
query that has too few neighbours within R is searched again without a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import column, short_batches
from tessera.storage import discard, persist

BITS, WIDTH = 128, 16
SEGMENTS = BITS // WIDTH
#: Distinct vectors that the rotations are learnt on, rounds of learning, queries whose true neighbours are looked up.
SAMPLE, ROUNDS, TRIALS, SEED = 20_000, 25, 200, 7
#: Share of true neighbours that the radius holds.
SHARE = 0.97
#: Bytes of vectors in a block of the index or of queries, and the fewest queries worth a block.
BLOCK_BYTES, LEAST_QUERIES = 64 << 20, 128


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in doubles; a power of two is taken out first, so that no square overflows."""
    v = vectors.astype(np.float64)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0.0))[1][:, None])
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


@dataclass
class Coder:
    """Rotations whose signs are the bits, and the mean that is taken off before."""

    mean: np.ndarray
    rotations: np.ndarray

    def codes(self, units: np.ndarray) -> np.ndarray:
        """One row of ``SEGMENTS`` 16-bit numbers for each vector."""
        bits = (units - self.mean) @ self.rotations > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint16)


def learn(sample: np.ndarray) -> Coder:
    """Rotations by iterative quantisation of the sample's principal components.

    With fewer dimensions than bits several rotations are learnt, each from a
    random start of its own. Without a sample the code is constant.
    """
    n, d = sample.shape
    if not n:
        return Coder(np.zeros(d), np.zeros((d, BITS)))
    rng = np.random.default_rng(SEED)
    mean = sample.mean(axis=0)
    centred = sample - mean
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
    made: list[np.ndarray] = []
    left = BITS
    while left:
        c = min(d, left)
        turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        # All axes where the bits suffice for them, else the first; a part of a basis needs them mixed.
        base = axes[:, :c] if c < d and not made else axes
        turn = turn[: base.shape[1], :c] if c < base.shape[1] else np.linalg.qr(turn[:c, :c])[0]
        shown = centred @ base
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(shown.T @ np.where(shown @ turn > 0, 1.0, -1.0), full_matrices=False)
            turn = u @ vt
        made.append(base @ turn)
        left -= c
    return Coder(mean, np.concatenate(made, axis=1))


_PATTERNS: dict[int, np.ndarray] = {}


def patterns(radius: int) -> np.ndarray:
    """All 16-bit values with at most ``radius`` bits set."""
    if radius not in _PATTERNS:
        _PATTERNS[radius] = np.array([sum(1 << b for b in c) for r in range(min(radius, WIDTH) + 1) for c in combinations(range(WIDTH), r)], dtype=np.uint16)
    return _PATTERNS[radius]


class Index:
    """The rows of one block by the value of each substring."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes

    @cached_property
    def segments(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each substring: the values there are, where each begins, and the rows in that order."""
        out = []
        for s in range(SEGMENTS):
            order = np.argsort(self.codes[:, s], kind="stable")
            values, begins = np.unique(self.codes[order, s], return_index=True)
            out.append((values, np.append(begins, len(order)), order))
        return out

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code differs from ``code`` in at most ``radius`` bits."""
        if radius >= BITS:
            return np.arange(len(self.codes))
        a, b = divmod(radius, SEGMENTS)
        met = np.zeros(len(self.codes), dtype=bool)
        for s, (values, begins, order) in enumerate(self.segments):
            own = a if s <= b else a - 1
            if own < 0:
                continue
            if own < WIDTH and len(patterns(own)) < len(values):  # probe each value near the query's
                probe = code[s] ^ patterns(own)
                at = np.minimum(np.searchsorted(values, probe), len(values) - 1)
                at = at[values[at] == probe]
            else:  # fewer values than probes: ask each whether it would be probed
                at = np.flatnonzero(np.bitwise_count(values ^ code[s]) <= own)
            low, size = begins[at], begins[at + 1] - begins[at]
            ends = np.cumsum(size)
            if len(ends) and ends[-1]:
                met[order[np.arange(ends[-1]) + np.repeat(low - ends + size, size)]] = True
        rows = np.flatnonzero(met)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


def nearest(index: Index, units: np.ndarray, least: np.ndarray, queries: np.ndarray, query_codes: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the k rows within ``radius`` nearest to each query, of equal ones those with the least ``least``."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for q in range(len(queries)):
        rows = index.within(query_codes[q], radius)
        if not len(rows):
            continue
        # One product for all finds those worth a look; equal vectors need equal scores, so these are summed alike.
        rough = units[rows] @ queries[q]
        if len(rows) > k:
            rows = rows[rough >= np.partition(rough, len(rows) - k)[len(rows) - k] - 1e-9]
        score = np.einsum("ij,j->i", units[rows], queries[q])
        best = np.lexsort((least[rows], -score))[:k]
        out.append((np.full(len(best), q), rows[best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _vectors(col: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def usable(df: DataFrame, id_column: str, vector: str) -> tuple[DataFrame, int]:
    """Distinct (id, v) with an id and a vector of finite entries, not all zero, of the commonest length; and that length (0: none)."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = df.select(column(id_column).cast("long").alias("id"), column(vector).alias("v")).filter("id is not null and v is not null")
    rows = rows.filter(F.coalesce(F.forall("v", finite), F.lit(False)) & F.exists("v", lambda c: c != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows.filter(F.size("v") == common["d"]).distinct(), common["d"]) if common else (rows, 0)


def _calibrate(index: DataFrame, asked: DataFrame, coder: Coder, d: int, k: int) -> int:
    """The least radius that holds ``SHARE`` of the true k nearest of at most ``TRIALS`` queries.

    The queries are those with the least hashes; each task scores its rows
    against all of them and sends on k rows a query.
    """
    got = asked.orderBy(F.xxhash64(F.lit(SEED), "v"), "query_id").limit(TRIALS).select("v").toArrow()
    queries = unit(_vectors(got.column("v"), d))
    codes = coder.codes(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = unit(_vectors(batch.column(0), d))
            own = coder.codes(units)
            score = queries @ units.T
            score[score > 1 - 1e-9] = -np.inf  # the query itself, or a copy: no question at any radius
            at = np.argsort(-score, axis=1, kind="stable")[:, :k]
            q = np.repeat(np.arange(len(queries)), at.shape[1])
            apart = np.bitwise_count(own[at.ravel()] ^ codes[q]).sum(axis=1).astype(np.int32)
            kept = score[q, at.ravel()] > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (q.astype(np.int32), score[q, at.ravel()], apart)], ["q", "score", "apart"])

    met = index.select("v").mapInArrow(run, "q int, score double, apart int")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "apart"))
    apart = sorted(r["apart"] for r in met.withColumn("n", best).filter(F.col("n") <= k).select("apart").collect())
    return apart[ceil(SHARE * len(apart)) - 1] if apart else 0


def _search(index: DataFrame, asked: DataFrame, coder: Coder, d: int, radius: int, k: int) -> DataFrame:
    """(query_id, h, found): the k nearest rows of each distinct query vector within ``radius``, best first.

    ``index`` is (v, ids), ``asked`` (query_id, v); ``h`` is a hash of the
    query's vector and ``same`` tells which rows found have that vector. A
    block of the index meets a block of queries in one task.
    """
    spark = index.sparkSession
    rows, queries = index.count(), asked.count()
    wide = 8 * (d + SEGMENTS)
    index_blocks = max(1, ceil(rows * wide / BLOCK_BYTES))
    # Every row is sent once for each block of queries: as few as memory allows, or as keep all cores busy.
    busy = ceil(spark.sparkContext.defaultParallelism / index_blocks)
    query_blocks = max(1, ceil(queries * wide / BLOCK_BYTES), min(busy, ceil(queries / LEAST_QUERIES)))

    def run(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        units = unit(_vectors(group.column("v"), d)) if len(asks) else np.zeros((0, d))
        ids = group.column("ids").combine_chunks()
        first = ids.flatten().to_numpy()[np.asarray(ids.offsets)[:-1] - np.asarray(ids.offsets)[0]] if len(asks) else np.zeros(0, np.int64)
        mine, theirs = np.flatnonzero(~asks), np.flatnonzero(asks)
        codes = coder.codes(units)
        q, row, score = nearest(Index(codes[mine]), units[mine], first[mine], units[theirs], codes[theirs], radius, k)
        hashes = group.column("h").to_numpy()
        return pa.table({"query_id": pa.array(first[theirs][q]), "h": pa.array(hashes[theirs][q]), "score": pa.array(score), "same": pa.array(hashes[mine][row] == hashes[theirs][q]), "ids": ids.take(pa.array(mine[row]))})

    number = lambda n: F.pmod(F.xxhash64(F.lit(SEED), "v"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    h = F.xxhash64("v").alias("h")
    own = index.select("v", "ids", h, F.lit(False).alias("asks"), number(index_blocks).alias("index_block"), spread(query_blocks).alias("query_block"))
    wanted = asked.select("v", F.array("query_id").alias("ids"), h, F.lit(True).alias("asks"), spread(index_blocks).alias("index_block"), number(query_blocks).alias("query_block"))
    met = own.unionByName(wanted).groupBy("index_block", "query_block").applyInArrow(run, "query_id long, h long, score double, same boolean, ids array<long>")
    by_query = Window.partitionBy("query_id", "h")
    few = met.withColumn("n", F.row_number().over(by_query.orderBy(F.desc("score"), F.get("ids", F.lit(0))))).filter(F.col("n") <= k)
    each = few.select("query_id", "h", "score", "same", F.explode("ids").alias("id"))
    best = each.withColumn("n", F.row_number().over(by_query.orderBy(F.desc("score"), "id"))).filter(F.col("n") <= k)
    order = F.array_sort(F.collect_list(F.struct("n", "id", "score", "same")))
    return best.groupBy("query_id", "h").agg(order.alias("found"))


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", radius: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows found of each query, but for itself.

    Rows whose id or vector is null, or whose vector is empty, zero, of
    another length than the commonest or has null or non-finite entries take
    no part, as query or as candidate. Rows alike count once; rows with one id
    and different vectors are queries and candidates each. ``is_query`` is a condition on
    ``id``. Equal scores are ordered by id. With k candidates or fewer all
    are returned; an empty table gives an empty result. ``radius`` sets the
    radius instead of the measured one; with ``BITS`` the search is exact.

    Equal vectors are gathered first, so of any number of copies only k + 1
    ids are indexed, and equal queries are searched once.
    """
    spark = df.sparkSession
    short_batches(spark)
    rows, d = usable(df, id_column, vector)
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    rows = persist(rows, "mih-rows")
    of_vector = Window.partitionBy("v").orderBy("id")
    kept = rows.withColumn("n", F.row_number().over(of_vector)).filter(F.col("n") <= k + 1)
    index = persist(kept.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "mih-index")
    asks = rows.filter(is_query)
    # Equal query vectors are one: its least id and a hash of the vector name it.
    asked = persist(asks.groupBy("v").agg(F.min("id").alias("query_id")), "mih-queries")
    sample = index.orderBy(F.xxhash64(F.lit(SEED), "v")).limit(SAMPLE).select("v").toArrow()
    coder = learn(unit(_vectors(sample.column("v"), d)))
    if radius is None:
        radius = _calibrate(index, asked, coder, d, k)
    found = persist(_search(index, asked, coder, d, radius, k + 1), "mih-found")
    wanted = min(k + 1, rows.count())
    if radius < BITS:
        done = found.filter(F.size("found") >= wanted).select("query_id", "h")
        again = asked.withColumn("h", F.xxhash64("v")).join(done, ["query_id", "h"], "left_anti").drop("h")
        again = persist(again, "mih-again")
        more = persist(_search(index, again, coder, d, BITS, k + 1), "mih-more")
        found, first = persist(found.join(done, ["query_id", "h"], "left_semi").unionByName(more), "mih-all"), found
        for made in (first, again, more):
            discard(made)
    discard(index)
    named = asked.select(F.col("query_id").alias("_least"), F.xxhash64("v").alias("h"), "v")
    each = asks.join(named, "v").select(F.col("id").alias("query_id"), "_least", "h")
    answers = each.join(found.select(F.col("query_id").alias("_least"), "h", "found"), ["_least", "h"])
    others = F.slice(F.filter("found", lambda x: (x["id"] != F.col("query_id")) | ~x["same"]), 1, k)
    out = answers.select("query_id", F.posexplode(others).alias("_at", "_x"))
    return out.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_x.id").alias("id"), F.col("_x.score").alias("score"))
