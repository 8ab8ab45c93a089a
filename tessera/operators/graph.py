"""V8: an index of vectors for approximate search: a layered graph for each shard, searched by beams.

Equal vectors are one node, which lists its ids. Nodes are dealt to shards by a
hash of the vector, so no shard grows with the data, only their number does.
In a shard nodes are in the order of that hash: a layer is a prefix of it, each
a ``M``-th of the one below, and a node is linked to near nodes before it that
differ from each other, and back. A search walks down the layers to the nearest
node and widens from there, keeping the ``ef`` best; shards' k best are merged.

The index has one row a shard, which a search reads in place: only queries and
k rows a query and shard are moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.semantic import topk_batch
from tessera.storage import discard, persist

#: Links a node has (twice as many in the lowest layer), and near nodes that they are chosen from.
M, CONSTRUCTION = 16, 64
#: Vectors of a shard, queries of a block, and rows of a product while a shard is linked.
SHARD_ROWS, QUERY_BLOCK, TILE = 20_000, 4_096, 1_024
#: Numbers of the vectors that are gathered at once while links are chosen.
GATHERED = 1 << 22
#: Queries whose beams are widened together.
BEAMS = 256
#: Ids that a node lists, the least ones: no search for that many or fewer can need more.
MOST_K = 100
#: Queries are broadcast up to this size, and otherwise dealt to the shards by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Rows that the width of a beam is measured on.
SAMPLE, SEED = 100, 7

_INDEX = "shard int, ids array<array<bigint>>, dimensions int, vectors binary, layers array<int>, ends array<int>, links array<int>"
_FOUND = "query_id bigint, id bigint, score double, computed bigint"


def _spread(v: np.ndarray, rows: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Which of each row's ``near`` nodes (nearest first, -1 for none) are nearer to it than to all kept before."""
    kept = np.zeros(near.shape, dtype=bool)
    step = max(1, GATHERED // (near.shape[1] * v.shape[1]))
    for a in range(0, len(rows), step):
        part = slice(a, a + step)
        others = v[near[part]]
        to_row = np.einsum("bd,bcd->bc", v[rows[part]], others)
        among = others @ others.transpose(0, 2, 1)
        for j in range(near.shape[1]):
            closest = np.where(kept[part], among[:, j], -np.inf).max(1)
            kept[part, j] = (near[part, j] >= 0) & (to_row[:, j] > closest) & (kept[part].sum(1) < most)
    return kept


def _before(v: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tiles of (rows, the nearest ``width`` rows before each, nearest first)."""
    for a in range(0, len(v), TILE):
        rows = np.arange(a, min(a + TILE, len(v)))
        score = v[rows] @ v[: rows[-1] + 1].T
        score[np.arange(score.shape[1])[None, :] >= rows[:, None]] = -np.inf
        top = min(width, score.shape[1])
        near = np.argpartition(-score, top - 1, axis=1)[:, :top]
        found = np.take_along_axis(score, near, 1)
        order = np.argsort(-found, axis=1, kind="stable")
        near, found = np.take_along_axis(near, order, 1), np.take_along_axis(found, order, 1)
        yield rows, np.where(np.isfinite(found), near, -1)


def _reach(ends: np.ndarray, links: np.ndarray, begin: np.ndarray, seen: np.ndarray) -> None:
    """Mark in ``seen`` all that can be reached from ``begin``."""
    seen[begin] = True
    while len(begin):
        begin = np.unique(np.concatenate([links[ends[i] : ends[i + 1]] for i in begin]))
        begin = begin[~seen[begin]]
        seen[begin] = True


def _layer(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(ends, links) of a graph over all rows: row i's links are ``links[ends[i]:ends[i + 1]]``."""
    pairs = []
    for rows, near in _before(v, CONSTRUCTION):
        at, place = np.nonzero(_spread(v, rows, near, M))
        pairs.append(np.stack((rows[at], near[at, place])))
    ahead = np.concatenate(pairs, axis=1)
    # A row's nearest one before it links back whatever else it has, so every row is reached from row 0.
    tree = np.full(len(v), -1)
    first = np.unique(ahead[0], return_index=True)[1]
    tree[ahead[0][first]] = ahead[1][first]
    both = np.concatenate((ahead, ahead[::-1]), axis=1)
    score = np.einsum("ij,ij->i", v[both[0]], v[both[1]])
    order = np.lexsort((both[1], -score, both[0]))
    a, b = both[0][order], both[1][order]
    count = np.bincount(a, minlength=len(v))
    rank = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
    # Only the nearest of a hub's many links are compared.
    width = int(min(2 * CONSTRUCTION, count.max(initial=1)))
    near = np.full((len(v), width), -1)
    near[a[rank < width], rank[rank < width]] = b[rank < width]
    at, place = np.nonzero(_spread(v, np.arange(len(v)), near, most))
    own, to = at, near[at, place]
    ends = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(v)))))
    seen = np.zeros(len(v), dtype=bool)
    _reach(ends, to, np.array([0]), seen)
    lost = []
    for i in np.nonzero(~seen)[0]:
        if not seen[i]:  # its nearest row before it has been reached by now
            lost.append((tree[i], i))
            _reach(ends, to, np.array([i]), seen)
    if lost:
        own, to = np.concatenate((own, [x for x, _ in lost])), np.concatenate((to, [x for _, x in lost]))
        to = to[np.argsort(own, kind="stable")]
        ends = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(v)))))
    return ends, to


def _layers(n: int) -> list[int]:
    """Rows of each layer, the lowest first."""
    sizes = [n]
    while sizes[-1] > M:
        sizes.append(ceil(sizes[-1] / M))
    return sizes


def _link(shard: pa.Table) -> pa.Table:
    """One shard's row of the index from its nodes (shard, ids, vector, place)."""
    shard = shard.sort_by("place")
    v = np.array(shard.column("vector").to_pylist(), dtype=np.float64)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    layers, ends, links = _layers(len(v)), [], []
    for i, size in enumerate(layers):
        e, to = _layer(unit[:size], M if i else 2 * M)
        ends.append(e + sum(map(len, links)))
        links.append(to)
    return pa.table(
        {
            "shard": pa.array([shard.column("shard")[0].as_py()], pa.int32()),
            "ids": pa.array([shard.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
            "dimensions": pa.array([v.shape[1]], pa.int32()),
            "vectors": pa.array([unit.tobytes()], pa.binary()),
            "layers": pa.array([layers], pa.list_(pa.int32())),
            "ends": pa.array([np.concatenate(ends)], pa.list_(pa.int32())),
            "links": pa.array([np.concatenate(links)], pa.list_(pa.int32())),
        }
    )


def build(df: DataFrame, id_column: str, vector_column: str, path: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write the index of all rows below ``path`` and read it back: a row a shard.

    Rows whose id or vector is null, or whose vector is zero or holds null,
    infinite or no numbers, take no part. A vector that very many rows share is
    cut to its ``MOST_K`` least ids before the shuffle, so it fills no task.
    Ids that occur again with other vectors are further nodes. An empty table
    gives an index without shards.
    """
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    rows = df.select(F.col(id_column).cast("long").alias("id"), v.alias("vector")).filter("id is not null and vector is not null")
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.coalesce(sound, F.lit(False)) & F.exists("vector", lambda x: x != 0))
    least = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    nodes = rows.distinct().withColumn("_rn", least).filter(F.col("_rn") <= MOST_K).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = persist(nodes.withColumn("place", F.xxhash64(F.lit(SEED), "vector")), "nodes")
    shards = max(1, ceil(nodes.count() / shard_rows))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64(F.lit(SEED + 1), "vector"), F.lit(shards)).cast("int"))
    # A file a shard: tasks then read whole files up to the session's split size.
    dealt.groupBy("shard").applyInArrow(_link, _INDEX).write.option("maxRecordsPerFile", 1).parquet(path)
    discard(nodes)
    return df.sparkSession.read.schema(_INDEX).parquet(path)


def _padded(ends: np.ndarray, links: np.ndarray) -> np.ndarray:
    """A layer's links as one row a node, filled up with -1."""
    count = np.diff(ends)
    out = np.full((len(count), count.max(initial=0)), -1, dtype=np.int32)
    out[np.repeat(np.arange(len(count)), count), np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], count)] = links[ends[0] : ends[-1]]
    return out


def _widen(v: np.ndarray, linked: np.ndarray, q: np.ndarray, begin: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, cosines, cosines computed) of each query's ``ef`` best nodes of one layer, -1 where there are fewer.

    Each step goes on, for all queries at once, from a query's best node that
    it has not gone on from, until it has from all it keeps.
    """
    every = np.arange(len(q))
    nodes, score = np.full((len(q), ef), -1), np.full((len(q), ef), -np.inf)
    done = np.zeros((len(q), ef), dtype=bool)
    seen = np.zeros((len(q), len(v)), dtype=bool)
    nodes[:, 0], score[:, 0], seen[every, begin] = begin, np.einsum("ij,ij->i", v[begin], q), True
    computed = np.ones(len(q), dtype=np.int64)
    while True:
        open_ = np.where(done, -np.inf, score)
        pick = open_.argmax(1)
        rows = np.nonzero(np.isfinite(open_[every, pick]))[0]
        if not len(rows):
            return nodes, score, computed
        done[rows, pick[rows]] = True
        near = linked[nodes[rows, pick[rows]]]
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        at, place = np.nonzero(fresh)
        new = near[at, place]
        seen[rows[at], new] = True
        computed[rows] += fresh.sum(1)
        found = np.full(near.shape, -np.inf)
        found[at, place] = np.einsum("ij,ij->i", v[new], q[rows[at]])
        all_score = np.concatenate((score[rows], found), axis=1)
        keep = np.argpartition(-all_score, ef - 1, axis=1)[:, :ef]
        nodes[rows] = np.take_along_axis(np.concatenate((nodes[rows], near), axis=1), keep, 1)
        done[rows] = np.take_along_axis(np.concatenate((done[rows], np.zeros(near.shape, dtype=bool)), axis=1), keep, 1)
        score[rows] = np.take_along_axis(all_score, keep, 1)


def _beams(v: np.ndarray, layers: list[int], ends: np.ndarray, links: np.ndarray, q: np.ndarray, ef: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(nodes, cosines, cosines computed) for each query: its ``ef`` best nodes that a walk from the top finds."""
    starts = np.cumsum([0] + [size + 1 for size in layers])
    linked = [_padded(ends[starts[i] : starts[i + 1]], links) for i in range(len(layers))]
    for a in range(0, len(q), BEAMS):
        part = q[a : a + BEAMS]
        begin, computed = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64)
        for i in range(len(layers) - 1, -1, -1):
            nodes, score, more = _widen(v[: layers[i]], linked[i], part, begin, 1 if i else ef)
            begin, computed = nodes[:, 0], computed + more
        for j in range(len(part)):
            real = np.isfinite(score[j])
            yield nodes[j, real], score[j, real], int(computed[j])


def search_shards(index: DataFrame, queries: DataFrame, k: int, ef: int | None) -> DataFrame:
    """(query_id, id, score, computed): each shard's k best rows of each query (query_id, query_vector).

    ``ef`` is the beam's width, at least k; None scores every node, which is
    exact. ``computed`` is how many cosines the shard took for that query, on
    the first of its rows, and zero on the others. Queries without a sound
    vector find nothing; equal query ids must have equal vectors.
    """
    if k > MOST_K:
        raise ValueError(f"k is at most {MOST_K}")
    spark = index.sparkSession
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.transform("query_vector", lambda x: x.cast("double")).alias("q"))
    sound = F.forall("q", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    asked = asked.filter(F.coalesce(sound, F.lit(False)) & F.exists("q", lambda x: x != 0)).dropDuplicates(["query_id"])
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("d")).first()
    blocks = max(1, ceil(size["n"] / QUERY_BLOCK))
    block = F.pmod(F.xxhash64(F.lit(SEED), "query_id"), F.lit(blocks)).cast("int")
    packed = asked.groupBy(block.alias("block")).agg(F.collect_list(F.struct("query_id", "q")).alias("asked"))
    tiles = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if size["n"] * ((size["d"] or 0) + 2) * 8 <= BROADCAST_BYTES:
        met = tiles.join(F.broadcast(packed), "block")
    else:
        shards = index.agg(F.max("shard")).first()[0] or 0
        met = tiles.join(packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards)))).hint("shuffle_hash"), ["block", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = {name: column[i] for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                v = np.frombuffer(shard["vectors"].as_py()).reshape(-1, shard["dimensions"].as_py())
                ends, links = shard["ends"].values.to_numpy(), shard["links"].values.to_numpy()
                layers, ids = shard["layers"].as_py(), shard["ids"].as_py()
                out: list[tuple[int, int, float, int]] = []
                asked = shard["asked"].as_py()
                q = np.array([one["q"] for one in asked])
                q /= np.linalg.norm(q, axis=1, keepdims=True)
                every = np.arange(len(v))
                beams = ((every, v @ one, len(v)) for one in q) if ef is None else _beams(v, layers, ends, links, q, max(ef, k))
                for one, (nodes, score, computed) in zip(asked, beams, strict=True):
                    score = np.round(score, 6)
                    # Everything at least as good as the kth, so that ties are settled by id.
                    least = -np.partition(-score, min(k, len(score)) - 1)[min(k, len(score)) - 1]
                    best = sorted((-float(s), x) for s, node in zip(score[score >= least], nodes[score >= least], strict=True) for x in ids[node])[:k]
                    out.extend((one["query_id"], x, -s, 0 if j else computed) for j, (s, x) in enumerate(best))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)

    return met.mapInArrow(run, _FOUND)


_TYPES = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
_NAMES = ("query_id", "id", "score", "computed")


def merge(found: DataFrame, k: int) -> DataFrame:
    """The k best of all shards' rows for each query as (query_id, id, score, rank), ties by id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.select("query_id", "id", "score").withColumn("rank", rank).filter(F.col("rank") <= k)


def topk(index: DataFrame, queries: DataFrame, k: int, ef: int | None) -> DataFrame:
    """The k best rows of every query, as ``semantic.topk_batch`` gives them but for what the beams miss."""
    return merge(search_shards(index, queries, k, ef), k)


def width_for(index: DataFrame, df: DataFrame, id_column: str, vector_column: str, k: int = 10, recall: float = 0.95, sample: int = SAMPLE) -> int | None:
    """The least of the widths k, 1.5k, 2k, 3k, 4k, 6k... that finds ``recall`` of the k nearest rows of some rows taken as queries.

    Measured against an exact search for at most ``sample`` of ``df``'s rows.
    None, an exact search, where a beam would have to be as wide as a shard.
    """
    rows = df.filter(F.col(vector_column).isNotNull()).withColumn("language", F.lit(None).cast("string"))
    asked = rows.orderBy(F.xxhash64(F.lit(SEED), id_column)).limit(sample)
    queries = persist(asked.select(F.col(id_column).cast("long").alias("query_id"), F.col(vector_column).alias("query_vector"), F.col("language").alias("query_language")), "asked")
    truth = persist(topk_batch(rows, queries, k, id_column, vector_column).select("query_id", "id"), "truth")
    wanted, largest = truth.count(), index.agg(F.max(F.element_at("layers", 1))).first()[0] or 0
    widths = sorted({int(k * f * 2**i) for i in range(20) for f in (1, 1.5)})
    ef = next((w for w in widths if w >= largest or topk(index, queries, k, w).join(truth, ["query_id", "id"]).count() >= recall * wanted), None)
    discard(queries)
    discard(truth)
    return None if ef is None or ef >= largest else ef
