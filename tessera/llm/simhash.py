"""Near-duplicates by SimHash and a self-join of binary tries.

Fingerprints are 64-bit majorities over the hashes of word shingles. Texts
link when at most ``BUDGET`` bits of their fingerprints differ.

The join: with ``BUDGET + r`` segments of the 64 bits, two linked fingerprints
agree on at least r segments, so each distinct fingerprint goes to one group
for every choice of r segments. In a group the fingerprints form a binary
trie. It is traversed in pairs of nodes together: the pair of roots first,
then the pairs of their children, adding up the bits in which the two paths
differ, and a pair is dropped as soon as they exceed the budget, or when both
nodes lie wholly in one component, where a link adds nothing. What a group
sends on is a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keep_least, short_batches, with_fields
from tessera.llm.components import Forest, components
from tessera.storage import persist

SHINGLE, BUDGET, SEED = 4, 4, 42
BITS = 64
#: Hashes whose bits are counted at once.
BLOCK = 1 << 15
#: Fingerprints that a group should hold on average, at most.
GROUP = 512
#: A group above both of these is split: a share of all fingerprints, so that
#: there are at most comb(segments, r) / SHARE such groups, and a number.
SHARE, HOT = 0.001, 50_000
#: Node pairs that are expanded at once.
FRONTIER = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The majority of the shingles' hashes, bit by bit; 0 without a word.

    Words are maximal runs of anything but ASCII white space, A-Z lower-cased.
    A text with fewer words than a shingle has its whole sequence as the only
    one; repeated shingles count each time.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest, n = xxhash.xxh64_intdigest, len(words) - size + 1
    return majority(np.fromiter((digest(g, seed) for g in grams), dtype=np.uint64, count=n))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    n, ones = len(hashes), np.zeros(BITS, dtype=np.int64)
    for a in range(0, n, BLOCK):
        ones += np.unpackbits(hashes[a : a + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``'s columns of every row with ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(0).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found.view(np.int64))], [*batch.schema.names[1:], "fp"])

    short_batches(docs.sparkSession)
    rows = docs.select(F.col(text).cast("string").alias("_text"), *keep)
    return rows.mapInArrow(run, with_fields(rows, rows.columns[1:], "fp long"))


def masks(n: int, budget: int = BUDGET) -> list[int]:
    """The bits that each choice of segments fixes, for n distinct fingerprints.

    Takes the fewest segments for which a group is expected to hold at most
    ``GROUP`` of n evenly spread fingerprints.
    """
    for r in range(1, 5):
        cuts = [BITS * i // (budget + r) for i in range(budget + r + 1)]
        segments = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(budget + r)]
        chosen = [sum(c) for c in combinations(segments, r)]
        if n <= GROUP << min(m.bit_count() for m in chosen) or r == 4:
            return chosen
    raise AssertionError


def meet(fp: np.ndarray, starts: np.ndarray, budget: int, needless: Callable[..., np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within each group whose values differ in ``budget`` bits at most.

    ``fp`` holds uint64 values, sorted within each group; group g is
    ``fp[starts[g]:starts[g + 1]]``. The traversal of all groups' tries in
    pairs of nodes; a node is a range of places, and pairs of nodes for which
    ``needless(lo, hi, lo2, hi2)`` holds are dropped with all below them.
    """
    whole = np.flatnonzero(np.diff(starts) > 1)
    stack = [(starts[whole], starts[whole + 1], starts[whole], starts[whole + 1], np.zeros(len(whole), np.int8), np.full(len(whole), BITS - 1, np.int8))]
    while stack:
        alo, ahi, blo, bhi, err, bit = stack.pop()
        if len(alo) > FRONTIER:  # the deep half goes first, so few pairs wait at a time
            half = len(alo) // 2
            stack.append(tuple(x[:half] for x in (alo, ahi, blo, bhi, err, bit)))
            alo, ahi, blo, bhi, err, bit = (x[half:] for x in (alo, ahi, blo, bhi, err, bit))
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            a, b = alo[single], blo[single]
            near = (np.bitwise_count(fp[a] ^ fp[b]) <= budget) & (a != b)
            if near.any():
                yield a[near], b[near]
            alo, ahi, blo, bhi, err, bit = (x[~single] for x in (alo, ahi, blo, bhi, err, bit))
        alike = bit < 0  # equal values: every place of one with every place of the other
        if alike.any():
            yield from _all_pairs(alo[alike], ahi[alike], blo[alike], bhi[alike])
            alo, ahi, blo, bhi, err, bit = (x[~alike] for x in (alo, ahi, blo, bhi, err, bit))
        if not len(alo):
            continue
        amid, bmid = _middle(fp, alo, ahi, bit), _middle(fp, blo, bhi, bit)
        own = alo == blo  # a node with itself: its two halves, and the one with the other
        pairs = (
            (alo, amid, blo, bmid, 0, None),
            (amid, ahi, bmid, bhi, 0, None),
            (alo, amid, bmid, bhi, 1, None),
            (amid, ahi, blo, bmid, 1, ~own),
        )
        made = []
        for lo, hi, lo2, hi2, more, where in pairs:
            e = err + np.int8(more)
            keep = (lo < hi) & (lo2 < hi2) & (e <= budget)
            keep &= ~((lo == lo2) & (hi - lo == 1))
            if where is not None:
                keep &= where
            at = np.flatnonzero(keep)
            at = at[~needless(lo[at], hi[at], lo2[at], hi2[at])]
            made.append((lo[at], hi[at], lo2[at], hi2[at], e[at], bit[at] - np.int8(1)))
        stack.append(tuple(np.concatenate(x) for x in zip(*made, strict=True)))


def _all_pairs(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of places of each pair of ranges, once each where a range meets itself."""
    for a, b, c, d in zip(lo.tolist(), hi.tolist(), lo2.tolist(), hi2.tolist(), strict=True):
        step = max(1, FRONTIER // max(1, d - c))
        for x in range(a, b, step):
            left, right = np.repeat(np.arange(x, min(x + step, b)), d - c), np.tile(np.arange(c, d), min(step, b - x))
            once = left < right if a == c else slice(None)
            yield left[once], right[once]


def link_groups(fp: np.ndarray, starts: np.ndarray, budget: int = BUDGET, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links within each group.

    ``fp`` and ``starts`` as in ``meet``, without repeats in a group. With
    ``side`` (0 or 1 for each value), only pairs with one value of either side
    need be linked.
    """
    n = len(fp)
    forest = Forest(n)
    if n < 2:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    sided = None if side is None else np.concatenate(([0], np.cumsum(side)))
    # Links within one bit first: dense groups join up and later pairs fall away.
    for allowed in (1, budget):
        root = forest.roots()
        change = np.concatenate(([0], np.cumsum(root[1:] != root[:-1])))  # equal ends: one component

        def needless(lo, hi, lo2, hi2, root=root, change=change):
            out = (change[hi - 1] == change[lo]) & (change[hi2 - 1] == change[lo2]) & (root[lo] == root[lo2])
            if sided is not None:
                ones, ones2 = sided[hi] - sided[lo], sided[hi2] - sided[lo2]
                out |= ((ones == 0) & (ones2 == 0)) | ((ones == hi - lo) & (ones2 == hi2 - lo2))
            return out

        for a, b in meet(fp, starts, allowed, needless):
            if side is not None:
                across = side[a] != side[b]
                a, b = a[across], b[across]
            forest.link(a, b)
    root = forest.roots()
    joined = np.flatnonzero(root != np.arange(n))
    return fp[joined], fp[root[joined]]


def _middle(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where the bit turns 1 in each sorted range whose higher bits agree."""
    lo, hi = lo.copy(), hi.copy()
    shift = np.maximum(bit, 0).astype(np.uint64)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        one = (fp[np.minimum(mid, len(fp) - 1)] >> shift & np.uint64(1)).astype(bool)
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def _as_unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def links(distinct: DataFrame, n: int, budget: int = BUDGET) -> DataFrame:
    """(a, b): edges that join all of ``distinct``'s (fp) within ``budget`` bits.

    A group with more than ``HOT`` fingerprints and ``SHARE`` of all of them
    is cut into chunks by a hash, and every two chunks meet in a group of
    their own, where only pairs across them are looked at.
    """
    spark = distinct.sparkSession
    chosen = masks(n, budget)
    keyed = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in chosen))).alias("part", "key"))
    limit = max(HOT, int(SHARE * n))
    hot = keyed.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    # At most len(masks) / SHARE rows by the definition of the limit: the bound of this broadcast.
    hot = F.broadcast(hot.select("part", "key", F.ceil(F.col("n") / limit).cast("int").alias("chunks")))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = keyed.join(hot, ["part", "key"], "left").withColumn("chunk", F.coalesce(own, F.lit(0))).withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    # Chunk c meets c itself and every other chunk: (c, x) for x >= c, (x, c) for x < c.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select(
        "fp",
        F.xxhash64("part", "key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("group"),
        F.when(F.col("chunk") == F.col("other"), F.lit(2)).when(F.col("chunk") < F.col("other"), F.lit(0)).otherwise(F.lit(1)).alias("side"),
    )
    # A group is one sorted run of its partition.
    dealt = dealt.repartition("group").sortWithinPartitions("group", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, group, side in _whole_groups(batches):
            order = np.lexsort((fp, group))
            fp, group, side = fp[order], group[order], side[order]
            starts = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(fp)]))
            crossed = side[starts[:-1]] != 2
            for pick, with_side in ((~crossed, False), (crossed, True)):
                if pick.any():
                    rows = np.repeat(pick, np.diff(starts))
                    sizes = np.concatenate(([0], np.cumsum(np.diff(starts)[pick])))
                    a, b = link_groups(fp[rows], sizes, budget, side[rows].astype(np.int64) if with_side else None)
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(fp, group, side) of at least ``rows`` rows that end with a group."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((_as_unsigned(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()))
        size += batch.num_rows
        if size >= rows:
            fp, group, side = (np.concatenate(x) for x in zip(*held, strict=True))
            end = int(np.flatnonzero(group != group[-1])[-1]) + 1 if (group != group[-1]).any() else 0
            if end:
                yield fp[:end], group[:end], side[:end]
                held, size = [(fp[end:], group[end:], side[end:])], len(fp) - end
            else:
                held = [(fp, group, side)]
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def near_duplicates(docs: DataFrame, budget: int = BUDGET, key: str = "doc_id") -> DataFrame:
    """(key, fp, component): each row's fingerprint and the least key it reaches.

    Rows without a word (null, empty, white space) have fingerprint 0 and are
    linked like any other. A null key is no candidate for the least one.
    Repeated rows come out each, linked with one another. An empty table gives
    an empty result. Other columns are left out. A very long text costs some
    twenty times its size in memory while its shingles are hashed.
    """
    marked = persist(fingerprints(docs.select(F.col("text"), F.col(key)), [key]), "simhash")
    distinct = persist(marked.groupBy("fp").agg(F.min(key).alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), distinct.count(), budget)).withColumnRenamed("node", "fp")
    # Fingerprints without links, most of them, form components of their own.
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of_fp = persist(rooted.join(least, "root").select("fp", "component"), "simhash-components")
    return marked.join(of_fp, "fp").select(key, "fp", "component")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(docs).select("doc_id", digits.alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but for near-duplicates of another; columns unchanged.

    The row with the least (doc_id, hash of its content) of each component
    stays; a component of null ids only keeps one row too.
    """
    return keep_least(docs, lambda texts: near_duplicates(texts, key="k").select("k", "component"))
