"""Near-duplicates by SimHash tries and exact similarity of word shingles.

Texts link when the sets of their shingles of ``SHINGLE`` words have a Jaccard
similarity of at least 4/5. For SimHash that is about ten of 64 bits. Beyond
``BUDGET`` bits a pair isn't looked at, which misses few that are similar: of
pairs at exactly 0.8 one in 10^6 with 4 and 5 shingles, 4 in 10^8 with 13 and
14, one in 10^8 with many. A budget of 64 misses none.
Segments of the fingerprint can't group texts at so many bits, so their
shingles do: with the shingles of every text in one global order, two texts
that link share one among the first fifth of both. In each of these groups
the fingerprints' tries are traversed in pairs of nodes, as in ``simhash``; a
pair of nodes is dropped beyond the budget, or when both lie in one group of
texts known to be linked. Of what is left a pair is dropped when bit maps of
both sets, one or two bits a shingle, show that too few shingles can be shared:
a bit that only one of them has set stands for a shingle that the other lacks,
so no similar pair is dropped. The rest is verified with whole sets.

Order does not change which pairs link, only how many are looked at. Shingles
that a sample of the texts shows often come last, so a common line meets only
where a text has little else. Of a long text whose shingles are nearly all
uncommon, ``FIRST`` are enough: a pair whose first ``FIRST`` shingles are all
among the at most 28 % that the two don't share is one in 10^8; without a
``first`` all of the first fifth meet, which misses none. Each meeting
is first compared with a few of its texts only; texts that are linked through
those need not meet again, so of many copies few pairs are made. What may be
linked beside that is not listed pair by pair, which in a dense group would
grow with its square: a forest of the candidates tells which texts belong to
one group, groups are cut into chunks, and each two chunks of a group meet in
one task that compares whole sets and sends on a forest of the links it found.
A text is sent once for each chunk of its group, and without the bit maps pairs
that only chance brought together would hang ever more unlike texts in one
group. Where sets are sent often all the same, they are sent in rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import gives_back, keep_least, short_batches, split_by, with_fields
from tessera.llm.components import Forest, components, thinned
from tessera.llm.simhash import BITS, majority, meet
from tessera.storage import discard, persist, release

SHINGLE, SEED, BUDGET = 5, 42, 28
#: Shingles of a text that meet others, where at most a tenth of its shingles are common.
FIRST = 16
#: Texts of a meeting that all its others are compared with first.
CENTRES = 4
#: Texts of a chunk of a group of candidates, and shingles of a chunk, about.
CHUNK, CHUNK_SHINGLES = 512, 200_000
#: Bits of a set's map, at most; sets of some 10,000 shingles and more are then seldom told apart by it.
MAP_BITS = 1 << 13
#: Bytes of maps that are compared at once.
MAPS = 1 << 22
#: How often sets are sent in one round on average, at most, and how many sets may be sent in any.
TIMES, SENT = 4, 50_000
#: Texts of the sample, how often a common shingle is in it, and how many are put last.
SAMPLE, COMMON, MOST = 10_000, 3, 200_000


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, none without a word.

    Words are those of ``simhash.fingerprint``; a text with fewer words than a
    shingle has its whole sequence as the only one.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64, count=len(words) - size + 1))


def _node(grams: np.ndarray) -> int:
    """The set's hash as a signed long: texts with the same set are one node."""
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes())).view(np.int64))


def bit_map(grams: np.ndarray) -> bytes:
    """The bits that the set's hashes have modulo a power of two, as many as there are hashes or up to twice that."""
    size = min(max(64, 1 << (len(grams) - 1).bit_length()), MAP_BITS) if len(grams) else 64
    bits = np.zeros(size, dtype=np.uint8)
    bits[(grams & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_link(left: pa.Array, right: pa.Array, x: np.ndarray, y: np.ndarray, i: np.ndarray | None = None, j: np.ndarray | None = None) -> np.ndarray:
    """Whether sets of ``x`` and ``y`` shingles can be similar by their maps, ``left`` and ``right`` (at ``i`` and ``j``).

    False only where they are not. The longer map is folded to the shorter one's length.
    """
    i, j = (np.arange(len(x)) if at is None else at for at in (i, j))
    if not len(i):
        return np.zeros(0, dtype=bool)
    (begin, size, data), (begin2, size2, data2) = _buffers(left), _buffers(right)
    may = np.zeros(len(x), dtype=bool)
    width = size[i] << 32 | size2[j]
    for both in np.unique(width):
        w, w2 = int(both) >> 32, int(both) & (1 << 32) - 1
        step, at = max(1, MAPS // max(w, w2)), np.flatnonzero(width == both)
        for part in (at[k : k + step] for k in range(0, len(at), step)):
            a, b = _folded(data, begin[i[part]], w, min(w, w2)), _folded(data2, begin2[j[part]], w2, min(w, w2))
            only, only2 = (np.bitwise_count(m).sum(axis=1, dtype=np.int64) for m in (a & ~b, b & ~a))
            may[part] = 9 * np.minimum(x[part] - only, y[part] - only2) >= 4 * (x[part] + y[part])
    return may


def _buffers(maps: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and length of each map, and all bytes."""
    maps = maps.cast(pa.binary())
    _, ends, data = maps.buffers()
    ends = np.frombuffer(ends, np.int32)[maps.offset : maps.offset + len(maps) + 1].astype(np.int64)
    return ends[:-1], np.diff(ends), np.frombuffer(data, np.uint8)


def _folded(data: np.ndarray, begin: np.ndarray, width: int, to: int) -> np.ndarray:
    maps = data[begin[:, None] + np.arange(width)].reshape(len(begin), width // to, to)
    return np.bitwise_or.reduce(maps, axis=1).view(np.uint64)


def _lists(values: list[np.ndarray], kind: str) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, kind), *values]).astype(kind)))


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of a sample, sorted, and each one's place in the order."""
    every = max(1, texts.count() // SAMPLE)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], ["gram"])

    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").distinct()
    often = some.mapInArrow(run, "gram long").groupBy("gram").count().filter(F.col("count") >= COMMON)
    got = often.orderBy(F.desc("count"), "gram").limit(MOST).toArrow()
    gram = got.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(gram)
    return gram[order], len(gram) - order


def _prefixes(texts: DataFrame, most: int | None) -> DataFrame:
    """``k`` with node, n (shingles of the set), its bit map and the first fifth of them, in order; of uncommon ones ``most``."""
    common, place = _common(texts)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, marks, sizes, maps, firsts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                grams = shingles(text)
                nodes.append(_node(grams))
                marks.append(int(np.uint64(majority(grams)).view(np.int64)))
                sizes.append(len(grams))
                maps.append(bit_map(grams))
                wanted = len(grams) - -(-4 * len(grams) // 5) + 1
                order = np.zeros(len(grams), np.int64)
                if len(common) and len(grams):
                    at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
                    order = np.where(common[at] == grams, place[at], 0)
                if most is not None and 10 * np.count_nonzero(order) <= len(grams):
                    wanted = min(wanted, most)
                firsts.append(grams[np.argsort(order, kind="stable")][:wanted].view(np.int64))
            columns = [batch.column(0), pa.array(nodes, pa.int64()), pa.array(marks, pa.int64()), pa.array(sizes, pa.int32()), pa.array(maps, pa.binary()), _lists(firsts, "i8")]
            yield pa.RecordBatch.from_arrays(columns, ["k", "node", "fp", "n", "map", "first"])

    return texts.select("k", "text").mapInArrow(run, with_fields(texts, ["k"], "node long, fp long, n int, map binary, first array<long>"))


_MEETING = ["gram", "node", "fp", "n", "at", "label", "map"]


def _groups(rows: DataFrame, schema: str, each) -> DataFrame:
    """``each`` over the columns of whole meetings (equal gram), sorted by gram and, where there is one, label.

    Columns are numpy's arrays, maps one of Arrow's.
    """
    own = [c for c in _MEETING if c in rows.columns]
    least = 50_000 if "map" in own else 200_000

    def joined(held: list[list[np.ndarray | pa.Array]]) -> list[np.ndarray | pa.Array]:
        return [pa.concat_arrays(x) if isinstance(x[0], pa.Array) else np.concatenate(x) for x in zip(*held, strict=True)]

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray | pa.Array]] = []
        size, wanted = 0, least
        for batch in batches:
            held.append([c if name == "map" else c.to_numpy() for name, c in zip(own, batch.columns, strict=True)])
            size += batch.num_rows
            if size >= wanted:
                whole = joined(held)
                end = int(np.searchsorted(whole[0], whole[0][-1]))
                if end:
                    yield from each(*(x[:end] for x in whole))
                held, size = [[x[end:] for x in whole]], size - end
                wanted = max(least, 2 * size)
        if size:
            yield from each(*joined(held))

    order = [c for c in ("gram", "label", "node") if c in own]
    return rows.select(own).repartition("gram").sortWithinPartitions(*order).mapInArrow(run, schema)


_SHARED = "gram long, node long, fp long, n int, at int, centre int, least long, least_fp long, least_n int, least_at int"


def _shared(gram, node, fp, n, at) -> Iterator[pa.RecordBatch]:
    """The rows of meetings of two or more, each with the first ``CENTRES`` nodes of the meeting."""
    starts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    sizes = np.diff(np.append(starts, len(gram)))
    head, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    for centre in range(CENTRES):
        keep = np.flatnonzero((size > 1) & (centre < size))
        to = head[keep] + centre
        columns = [gram[keep], node[keep], fp[keep], n[keep], at[keep], np.full(len(keep), centre, np.int32), node[to], fp[to], n[to], at[to]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split(" ")[0] for x in _SHARED.split(", ")])


def _cross(gram, node, fp, n, at, label, maps: pa.Array | None = None, budget: int = BUDGET) -> Iterator[pa.RecordBatch]:
    """The pairs of each meeting with different labels that may be similar, by a traversal of the meeting's trie and by the maps."""
    fp = fp.view(np.uint64)
    order = np.lexsort((label, fp, gram))
    gram, node, fp, n, at, label = (x[order] for x in (gram, node, fp, n, at, label))
    starts = np.concatenate(([0], np.flatnonzero(gram[1:] != gram[:-1]) + 1, [len(gram)]))
    change = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))

    def linked(lo, hi, lo2, hi2):
        return (change[hi - 1] == change[lo]) & (change[hi2 - 1] == change[lo2]) & (label[lo] == label[lo2])

    for left, right in meet(fp, starts, budget, linked):
        x, y = n[left].astype(np.int64), n[right].astype(np.int64)
        rest = np.minimum(x - at[left], y - at[right])  # shared shingles at most, if this is the first
        near = (9 * rest >= 4 * (x + y)) & (label[left] != label[right])
        left, right, x, y = left[near], right[near], x[near], y[near]
        if maps is not None:
            may = may_link(maps, maps, x, y, order[left], order[right])
            left, right = left[may], right[may]
        u, v = node[left], node[right]
        if len(u):
            pairs = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v))), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what (a, b) do, one for each node but the least of its component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    forest = Forest(len(nodes))
    forest.link(at[: len(a)], at[len(a) :])
    root = nodes[forest.roots()]
    return nodes[root != nodes], root[root != nodes]


def _candidates(gram, node, fp, n, at, label, maps: pa.Array, budget: int = BUDGET) -> Iterator[pa.RecordBatch]:
    """A forest that connects the pairs of ``_cross``: as many rows as there are nodes, at most."""
    a = b = np.empty(0, np.int64)
    for batch in _cross(gram, node, fp, n, at, label, maps, budget):
        a, b = np.concatenate((a, batch.column(0).to_numpy())), np.concatenate((b, batch.column(1).to_numpy()))
        if len(a) > 1_000_000:
            a, b = _forest(a, b)
    if len(a):
        a, b = _forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links_between(node: np.ndarray, label: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs of similar sets with different labels: between two sides, or all if there is one."""
    order = np.lexsort((node, side))
    node, label, side, sets = node[order], label[order], side[order], [sets[i] for i in order]
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    begin = np.concatenate(([0], np.cumsum(size)))
    marks = np.zeros(int(codes.max()) + 1, dtype=np.int32)
    two = int(np.searchsorted(side, side[0], side="right"))
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in range(two if two < len(node) else len(node) - 1):
        right = two if two < len(node) else i + 1
        if (label[right:] == label[i]).all():
            continue
        own = codes[begin[i] : begin[i + 1]]
        marks[own] = 1
        shared = np.add.reduceat(marks[codes[begin[right] :]], begin[right:-1] - begin[right])
        marks[own] = 0
        met = right + np.flatnonzero((9 * shared >= 4 * (size[i] + size[right:])) & (label[right:] != label[i]))
        a.append(np.full(len(met), node[i]))
        b.append(node[met])
    return _forest(np.concatenate(a), np.concatenate(b))


def _rounds(sent: int, sets: int) -> int:
    """Rounds in which ``sent`` copies of so many sets are sent, so that one's shuffle holds ``TIMES`` copies of a set, about."""
    return -(-sent // max(TIMES * sets, SENT)) or 1


def _in_rounds(rows: DataFrame, by: list[str], rounds: int, work: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """What ``work`` makes of ``rows``, dealt by a hash of ``by`` to rounds of which each is written, and its shuffles freed, before the next."""
    of = F.pmod(F.xxhash64(*by), F.lit(rounds))
    parts = [persist(work(rows.filter(of == i) if rounds > 1 else rows), label) for i in range(rounds)]
    return reduce(DataFrame.unionByName, parts)


def _group_links(candidates: DataFrame, labels: DataFrame, sizes: DataFrame, texts: DataFrame, marked: DataFrame) -> DataFrame:
    """Links (a, b) that connect all similar texts with different labels within each component of ``candidates``.

    A text is sent once for each chunk of its group, in rounds where that is
    often. ``labels`` has node and label of all, ``sizes`` node and n.
    """
    spark = texts.sparkSession
    groups = persist(components(candidates), "similar-groups")
    sets = _sets(groups.select("node"), texts, marked)
    sized = groups.join(sizes.select("node", "n"), "node").join(labels.select("node", "label"), "node")
    large = sized.groupBy("root").agg(F.count("*").alias("texts"), F.sum("n").alias("all"))
    chunks = F.greatest(F.ceil(F.col("texts") / CHUNK), F.ceil(F.col("all") / CHUNK_SHINGLES), F.lit(1))
    placed = persist(sized.join(large.select("root", chunks.alias("chunks")), "root").select("root", "node", "label", "chunks"), "similar-placed")
    sent, own = placed.agg(F.coalesce(F.sum("chunks"), F.lit(0)), F.count("*")).first()
    side = F.pmod(F.xxhash64("node"), F.col("chunks")).alias("side")
    rows = placed.select("root", "node", "label", side, F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("with"))
    rows = rows.select("root", F.least("side", "with").alias("low"), F.greatest("side", "with").alias("high"), "node", "label", "side")

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches, 3):
            key = [table.column(i).to_numpy() for i in range(3)]
            change = np.zeros(len(table), dtype=bool)
            change[0] = True
            for k in key:
                change[1:] |= k[1:] != k[:-1]
            ends = np.append(np.flatnonzero(change), len(table))
            node, label, side = (table.column(i).to_numpy() for i in (3, 4, 5))
            grams = table.column(6).combine_chunks()
            offsets, values = np.asarray(grams.offsets), grams.values.to_numpy()
            for x, y in zip(ends[:-1], ends[1:], strict=True):
                if (label[x:y] != label[x]).any():
                    a, b = links_between(node[x:y], label[x:y], side[x:y], [values[offsets[i] : offsets[i + 1]] for i in range(x, y)])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def meet_in_chunks(rows: DataFrame) -> DataFrame:
        full = rows.join(sets, "node").select("root", "low", "high", "node", "label", "side", "grams")
        return full.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "node").mapInArrow(run, "a long, b long")

    out = _in_rounds(rows, ["root", "low", "high"], _rounds(sent, own), meet_in_chunks, "similar-group-links")
    discard(sets)
    discard(groups)
    discard(placed)
    release(spark)
    return out


def _whole_keys(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """Batches sorted by their first ``columns`` columns, dealt anew so that no key lies in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [c[batch.num_rows - 1].as_py() for c in batch.columns[:columns]]
        same = np.ones(batch.num_rows, dtype=bool)
        for c, value in zip(batch.columns, last, strict=False):
            same &= c.to_numpy() == value
        end = int(np.argmax(same))
        if held and end == 0 and [c[0].as_py() for c in held[-1].columns[:columns]] == last:
            held.append(batch)
            continue
        done = pa.Table.from_batches([*held, batch.slice(0, end)])
        if done.num_rows:
            yield done
        held = [batch.slice(end)]
    if held:
        yield pa.Table.from_batches(held)


def _sets(nodes: DataFrame, texts: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, grams) of the distinct ``nodes``; ``marked`` has k and node of ``texts``."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(_node, found)), pa.int64()), _lists([f.view(np.int64) for f in found], "i8")], ["node", "grams"])

    one = persist(marked.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("k").alias("k")).select("k"), "similar-wanted")
    near, _ = split_by(texts.select("k", "text"), one, one.count())
    chosen = near.join(one, "k", "left_semi").dropDuplicates(["k"])
    return persist(chosen.select("text").mapInArrow(run, "node long, grams array<long>"), "similar-sets")


def _by_maps(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs (a, b) that can be similar by ``maps`` (node, n, map)."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_numpy().astype(np.int64) for c in ("_n", "_n2"))
            yield batch.select(["a", "b"]).filter(pa.array(may_link(batch.column("_map"), batch.column("_map2"), x, y)))

    side = lambda name, end: maps.select(F.col("node").alias(name), F.col("n").alias(f"_n{end}"), F.col("map").alias(f"_map{end}"))
    return pairs.join(side("a", ""), "a").join(side("b", "2"), "b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, maps: DataFrame, texts: DataFrame, marked: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar; ``marked`` has k and node of ``texts``."""
    pairs = persist(_by_maps(pairs.distinct(), maps), "similar-pairs")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets(wanted, texts, marked)
    release(texts.sparkSession)
    shared = F.size(F.array_intersect("_x", "_y"))

    def similar(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("_x")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("_y")), "b")
        return both.filter(9 * shared >= 4 * (F.size("_x") + F.size("_y"))).select("a", "b")

    out = _in_rounds(pairs, ["a", "b"], _rounds(2 * pairs.count(), sets.count()), similar, "similar-links")
    discard(sets)
    discard(pairs)
    release(texts.sparkSession)
    return out


def near_duplicates(texts: DataFrame, budget: int = BUDGET, most: int | None = FIRST) -> DataFrame:
    """(k, component): the least k that each row of ``texts`` (k, text) reaches.

    With a ``budget`` of 64 and ``most`` None every similar pair is found.
    """
    spark = texts.sparkSession
    short_batches(spark)
    first = persist(_prefixes(texts, most), "similar-first")
    marked = persist(first.select("k", "node"), "similar")
    distinct = first.groupBy("node").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("first").alias("first"))
    maps = persist(first.groupBy("node").agg(F.min("n").alias("n"), F.min("map").alias("map")), "similar-maps")
    rows = distinct.select("node", "fp", "n", F.posexplode("first").alias("at", "gram"))
    shared = persist(_groups(rows, _SHARED, _shared), "similar-shared")
    discard(first)
    release(spark)
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("least_fp"))) <= budget
    near &= 9 * F.least(F.col("n") - F.col("at"), F.col("least_n") - F.col("least_at")) >= 4 * (F.col("n") + F.col("least_n"))
    pairs = shared.filter((F.col("node") != F.col("least")) & near).select(F.greatest("node", "least").alias("a"), F.least("node", "least").alias("b"))
    stars = _verified(pairs, maps, texts, marked)
    # Two nodes with one label are linked through it; a label's own label stands for both.
    labels = stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_least"))
    for _ in range(2):
        next_ = labels.select(F.col("node").alias("_least"), F.col("_least").alias("_next"))
        labels = labels.join(next_, "_least", "left").select("node", F.coalesce("_next", "_least").alias("_least"))
    labelled = shared.filter("centre = 0").join(labels, "node", "left").withColumn("label", F.coalesce("_least", "node"))
    mapped = labelled.join(maps.select("node", "map"), "node")
    candidates = thinned(_groups(mapped, "a long, b long", partial(_candidates, budget=budget)))
    one = labelled.groupBy("node").agg(F.first("label").alias("label"))
    links = _group_links(candidates, one, maps, texts, marked).unionByName(stars)
    roots = persist(components(thinned(links)), "similar-roots")
    discard(shared)
    discard(maps)
    release(spark)
    rooted = marked.join(roots, "node", "left").select("k", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("k").alias("component"))
    return rooted.join(least, "root").select("k", "component")


def keep_one(docs: DataFrame, exact: bool = False) -> DataFrame:
    """The rows of ``docs`` but for near-duplicates of another; columns unchanged.

    The row with the least (doc_id, hash of its content) of each component
    stays; a component of null ids only keeps one row too. Rows alike are near-
    duplicates like any others. Texts without a word (null, empty, white
    space) are alike. An empty table gives an empty result. Columns of any
    name and type come along. A very long text costs some forty times its
    size in memory. With ``exact`` no similar pair is left out: whole prefixes
    meet, and no pair is dropped by its fingerprints.
    """
    find = partial(near_duplicates, budget=BITS, most=None) if exact else near_duplicates
    return keep_least(docs, find)
