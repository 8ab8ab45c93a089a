"""Substring deduplication by content-defined chunking.

A gear hash rolls over a text's bytes: h becomes 2h + G[byte], in 16 bits, so
it depends on the last 16 bytes only. Of the places where a chunk may begin
(after ASCII white space, or a character of three or more bytes) those become
cuts whose hash is the strict minimum among the ``REACH`` places on either
side. Cuts therefore depend on nearby content alone: an insertion moves them
but changes only those around it, and chunks are a few words long with a
minimum length. A longer stretch without a cut is cut in the same way at any
character, with a reach of ``FAR``, and one that is the same throughout every
``LONGEST`` bytes.

What repeats is a window: the fewest whole chunks from a cut on, or up to a
cut, that make ``MIN_WORDS`` words, or as much text without spaces. A window's
digest decides. Its occurrence with the least (document, position) is the first
and stays; the others are repeats, so every run of chunks of that length which
stands anywhere earlier is found whole, and nothing else is: no window joins
pieces of two places. A text too short for a window is one as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import column, gives_back, row_of, short_batches
from tessera.storage import discard, persist, release

GEAR_SEED, DIGEST_SEED = 7, 0
REACH, FAR, LONGEST = 3, 24, 512
#: Words a window must have. Chance repeats of common words stay below it, and a
#: repeated passage of over 50 words has whole chunks of more than it.
MIN_WORDS = 16
#: Characters that do as well, for text without spaces; one of three bytes or more counts thrice.
MIN_WEIGHT = 128
#: Text of a block that is chunked at once.
BLOCK_BYTES = 4_000_000
#: Rows of a block that are sent at once.
SLICE = 32_768
#: Rows of one digest that one task should hold at most; digests with more are split.
HOT, SPLIT, MOST_HOT = 4096, 64, 10_000


@lru_cache(1)
def _gear() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(GEAR_SEED)).integers(0, 1 << 16, 256, dtype=np.uint16)


@lru_cache(1)
def _space() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling the window."""
    h = _gear()[data]
    for width in (1, 2, 4, 8):
        shifted = h[:-width] << np.uint16(width)
        h = h.copy()
        h[width:] += shifted
    return h


def _minima(h: np.ndarray, reach: int) -> np.ndarray:
    """Which values are less than all others up to ``reach`` places away."""
    least = np.ones(len(h), dtype=bool)
    for d in range(1, min(reach, len(h) - 1) + 1):
        least[d:] &= h[d:] < h[:-d]
        least[:-d] &= h[:-d] < h[d:]
    return least


def cuts(data: bytes) -> np.ndarray:
    """Where chunks of one text begin and the last one ends: 0, ..., len(data)."""
    n = len(data)
    if not n:
        return np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    space = _space()[raw]
    begins = np.zeros(n, dtype=bool)
    begins[1:] = (space[:-1] & ~space[1:]) | (raw[1:] >= 0xE0)
    at = np.flatnonzero(begins)
    h = gear_hashes(raw)
    seen = lambda at: h[np.minimum(at + 7, n - 1)]  # noqa: E731  the next eight bytes and eight before
    edges = np.concatenate(([0], at[_minima(seen(at), REACH)], [n]))
    if (np.diff(edges) > LONGEST).any():
        more = [edges]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > LONGEST:
                place = a + 1 + np.flatnonzero(raw[a + 1 : b] & 0xC0 != 0x80)
                inner = place[_minima(seen(place), FAR)]
                more += [inner, _even(raw, np.concatenate(([a], inner, [b])))]
        edges = np.unique(np.concatenate(more))
    return edges


def _even(raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Cuts every ``LONGEST`` bytes, not within a character, between edges that are further apart."""
    more = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        for x in range(a + LONGEST, b, LONGEST):
            while x > a and raw[x] & 0xC0 == 0x80:
                x -= 1
            more.append(x)
    return np.array(more, dtype=np.int64)


def windows(data: bytes, min_words: int = MIN_WORDS) -> np.ndarray:
    """One row a window of a text: its begin and end, and the words that begin before either.

    The end includes white space that follows.
    """
    edges = cuts(data)
    last = len(edges) - 1
    raw = np.frombuffer(data, dtype=np.uint8)
    space = _space()[raw]
    if space.all():
        return np.empty((0, 4), dtype=np.int64)
    starts = ~space & np.concatenate(([True], space[:-1]))
    words = np.concatenate(([0], np.cumsum(starts)))[edges]
    heavy = np.concatenate(([0], np.cumsum((raw & 0xC0 != 0x80) + 2 * (raw >= 0xE0))))[edges]
    least_weight = MIN_WEIGHT * min_words // MIN_WORDS
    here = np.arange(last)
    # The least end of a window from each chunk on, and the greatest begin of one up to each cut.
    end = np.minimum(np.searchsorted(words, words[:-1] + min_words), np.searchsorted(heavy, heavy[:-1] + least_weight))
    begin = np.maximum(np.searchsorted(words, words[1:] - min_words, side="right"), np.searchsorted(heavy, heavy[1:] - least_weight, side="right")) - 1
    fits, reaches = end <= last, begin >= 0
    pairs = np.unique(np.concatenate((here[fits] * (last + 1) + end[fits], begin[reaches] * (last + 1) + here[reaches] + 1)))
    if not len(pairs):
        pairs = np.array([last])
    begin, end = np.divmod(pairs, last + 1)
    at = edges[begin]
    at[begin == 0] = int(np.argmin(space))  # white space at a text's begin is not in its first chunk
    return np.column_stack((at, edges[end], words[begin], words[end]))


def digests(data: bytes, found: np.ndarray) -> list[int]:
    """A digest of each window, without the white space at its end."""
    raw = np.frombuffer(data, dtype=np.uint8)
    kept = np.maximum.accumulate(np.where(_space()[raw], 0, np.arange(1, len(raw) + 1)))
    digest = xxhash.xxh3_64_intdigest
    return [digest(data[a:b], DIGEST_SEED) for a, b in zip(found[:, 0].tolist(), kept[found[:, 1] - 1].tolist(), strict=True)]


#: ``place`` holds a window's begin and the words before it, ``size`` its length, words and state: the rows that are shuffled stay short.
_WINDOWS = "digest long, block long, doc_id long, text_hash long, place long, size long"
#: States of a window: the only one of its digest in its block, the first of several, another.
_ALONE, _FIRST, _KNOWN = 0, 1, 2


def occurrences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The windows of every text of ``docs`` (doc_id, text).

    Of all occurrences of a digest that a block of texts has, all but the
    first are repeats for certain, so that however often a digest occurs, a
    block sends it once to where digests meet.
    """

    def block(number: int, ids: list[int | None], hashes: list[int], texts: list[str]) -> pa.RecordBatch:
        digest, parts = [], [np.empty((0, 4), dtype=np.int64)]
        for text in texts:
            data = text.encode("utf-8", "surrogatepass")
            parts.append(windows(data, min_words))
            digest += digests(data, parts[-1])
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in parts[1:]])
        found = np.concatenate(parts)
        digest = np.array(digest, dtype=np.uint64).view(np.int64)
        # Texts in order of (doc_id, hash), null ids first, for "least"; rows alike are one text.
        names = [(x is not None, x or 0, h) for x, h in zip(ids, hashes, strict=True)]
        number_of = {name: i for i, name in enumerate(sorted(set(names)))}
        rank = np.fromiter((number_of[x] for x in names), np.int64, len(names))[doc]
        order = np.lexsort((found[:, 0], rank, digest))
        head = np.ones(len(order), dtype=bool)
        head[1:] = digest[order[1:]] != digest[order[:-1]]
        first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        again = (rank[order] == rank[first]) & (found[order, 0] == found[first, 0]) & ~head  # the same place of a repeated row
        state = np.zeros(len(order), dtype=np.int8)
        state[order[~head]] = _KNOWN
        state[first[~head & ~again]] = _FIRST
        keep = np.ones(len(order), dtype=bool)
        keep[order[again]] = False
        doc, found = doc[keep], found[keep]
        id_array = np.array([x or 0 for x in ids], dtype=np.int64)
        null = np.array([x is None for x in ids], dtype=bool)
        columns = [
            pa.array(digest[keep]),
            pa.array(np.full(len(doc), number)),
            pa.array(id_array[doc], mask=null[doc]),
            pa.array(np.array(hashes, dtype=np.int64)[doc]),
            pa.array(found[:, 0] << 32 | found[:, 2]),
            pa.array((found[:, 1] - found[:, 0]) << 32 | (found[:, 3] - found[:, 2]) << 2 | state[keep]),
        ]
        return pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in _WINDOWS.split(", ")])

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, texts, size = [], [], [], 0
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, h, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids.append(doc_id)
                hashes.append(h)
                texts.append(text)
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield from _slices(block(number, ids, hashes, texts))
                    ids, hashes, texts, size = [], [], [], 0
                    number += 1
        if ids:
            yield from _slices(block(number, ids, hashes, texts))

    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.filter("text <> ''").mapInArrow(run, _WINDOWS)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, SLICE):
        yield batch.slice(at, SLICE)


_TEXT = ("doc_id", "text_hash")
_PLACE = (*_TEXT, "place")


def _with_first(rows: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with the least place that each one's digest has.

    A digest has one row a block, so a task holds as many rows as there are
    blocks at most. Where those are more than ``HOT``, digests that a sample
    of the blocks has too often are split: their rows first meet in ``SPLIT``
    parts, and what is least in one of those meets in a second step. The
    sample decides how the work is done, never what comes out.
    """
    place = F.struct(*_PLACE)
    least = lambda df, *by: df.withColumn("first", F.min(place).over(Window.partitionBy("digest", *by)))
    if blocks <= HOT:
        return least(rows)
    every = blocks // HOT
    often = rows.filter(F.pmod(F.xxhash64("block"), F.lit(every)) == 0).groupBy("digest").count().filter(F.col("count") > HOT // 2)
    # At most MOST_HOT rows: small enough to broadcast.
    hot = F.broadcast(persist(often.orderBy(F.desc("count"), "digest").limit(MOST_HOT).select("digest"), "hot-digests"))
    split = rows.join(hot, "digest").withColumn("part", F.pmod(F.xxhash64("block"), F.lit(SPLIT)))
    split = persist(least(split, "part").withColumnRenamed("first", "part_first").drop("part"), "hot-windows")
    # SPLIT rows a digest at most: bounded by MOST_HOT * SPLIT, joined back without a sort of the hot side.
    firsts = split.groupBy("digest").agg(F.min("part_first").alias("first"))
    return least(rows.join(hot, "digest", "left_anti")).unionByName(split.drop("part_first").join(F.broadcast(firsts), "digest").select(*rows.columns, "first"))


def _state() -> Column:
    return F.col("size").bitwiseAND(F.lit(3))


def _repeated(docs: DataFrame, min_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """The windows that stand earlier too, with the least place of each (``first``), and the tables they are read from."""
    found = persist(occurrences(docs, min_words), "windows")
    blocks = found.agg(F.approx_count_distinct("block")).first()[0]
    opened = _with_first(found.filter(_state() < _KNOWN), blocks)
    stay = ~F.struct(*_PLACE).eqNullSafe(F.col("first"))
    opened = persist(opened.filter(stay | (_state() == _FIRST)), "window-firsts")
    # Joined within a block: no digest is hot there.
    of_block = opened.filter(_state() == _FIRST).select("block", "digest", "first")
    known = found.filter(_state() == _KNOWN).join(of_block, ["block", "digest"])
    columns = [*_PLACE, F.shiftright("size", 2).alias("size"), "first"]
    rows = opened.filter(stay).select(columns).unionByName(known.select(columns)).distinct()
    low = lambda name: F.col(name).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    high = lambda col: F.shiftright(col, 32).cast("int")
    words = F.col("size").bitwiseAND(F.lit((1 << 30) - 1)).cast("int")
    rows = rows.select(
        *_TEXT,
        high("place").alias("at"),
        (high("place") + F.shiftright("size", 30).cast("int")).alias("until"),
        low("place").alias("words_at"),
        (low("place") + words).alias("words_until"),
        F.col("first.doc_id").alias("source"),
        F.col("first.text_hash").alias("source_hash"),
        (high("place") - high(F.col("first.place"))).alias("apart"),
    )
    return rows, [found, opened]




def _spans(docs: DataFrame, min_words: int) -> DataFrame:
    """``spans`` of each text that has some: windows joined where they and their sources overlap or touch."""
    rows, tables = _repeated(docs, min_words)
    by = [*_TEXT, "source", "source_hash", "apart"]
    order = Window.partitionBy(*by).orderBy("at", "until")
    begins = (F.col("at") > F.coalesce(F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int")
    joined = rows.withColumn("begins", begins).withColumn("span", F.sum("begins").over(order)).groupBy(*by, "span")
    joined = joined.agg(F.min("at").alias("span_start"), F.max("until").alias("span_end"), F.min("words_at").alias("words_at"), F.max("words_until").alias("words_until"))
    span = F.struct("span_start", "span_end", "words_at", "words_until", F.col("source").alias("first_doc_id"), (F.col("span_start") - F.col("apart")).alias("first_start"))
    texts = persist(joined.groupBy(*_TEXT).agg(F.array_sort(F.collect_list(span)).alias("spans")), "spans")
    for read in tables:
        discard(read)
    release(docs.sparkSession)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = pa.array([_worthwhile(x, min_words) for x in batch.column(2).to_pylist()], batch.column(2).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], spans], batch.schema.names)

    several = texts.filter(F.size("spans") > 1).mapInArrow(run, texts.schema)
    return texts.filter(F.size("spans") == 1).unionByName(several)


def _worthwhile(spans: list[dict], min_words: int) -> list[dict]:
    """The spans that add a window's length to longer ones; a common word after a common passage does not."""
    edges = sorted({(s["span_start"], s["words_at"]) for s in spans} | {(s["span_end"], s["words_until"]) for s in spans})
    place = {at: i for i, (at, _) in enumerate(edges)}
    size, words = np.diff([a for a, _ in edges]), np.diff([w for _, w in edges])
    free = np.ones(len(size), dtype=bool)
    kept = []
    for s in sorted(spans, key=lambda s: (s["words_at"] - s["words_until"], s["span_start"] - s["span_end"], s["span_start"])):
        own = slice(place[s["span_start"]], place[s["span_end"]])
        adds = free[own]
        if adds.all() or words[own][adds].sum() >= min_words or size[own][adds].sum() >= 2 * MIN_WEIGHT:
            kept.append(s)
            free[own] = False
    return sorted(kept, key=lambda s: (s["span_start"], s["span_end"]))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Spans of texts that stand at an earlier place, of ``min_words`` words or more.

    One row a span and source: doc_id, text_hash (xxhash64 of the text),
    span_start and span_end (bytes of the UTF-8 text), n_words, and
    first_doc_id, first_start: the least place where its windows stand, all at
    one distance, so the text there is the same (but for the kind of white
    space between windows and at the span's end). Spans of different sources
    may overlap, but one that adds less than a window to longer ones is left
    out. "Earlier" is by (doc_id, text_hash, byte), null ids first; repeats
    within a text count. Spans of text without spaces may have fewer words,
    and a shorter text that is repeated as a whole is a span too. Rows alike
    in id and text are one document. Null and empty texts have no span; a
    table without repeats gives an empty result. A very long text costs some
    twenty times its size in memory. Other columns are left out.
    """
    return _spans(docs, min_words).select(*_TEXT, F.inline("spans")).select(
        *_TEXT, "span_start", "span_end", (F.col("words_until") - F.col("words_at")).cast("long").alias("n_words"), "first_doc_id", "first_start"
    )


def remove(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with repeated spans cut from ``text``; other columns stay.

    Texts without a span are unchanged, a null text stays null, and a text
    that repeats throughout becomes empty. ``n_chars``, if there, is counted
    anew for texts that were cut.
    """
    names = docs.columns
    cut_list = _spans(docs.select("doc_id", "text"), min_words).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), _merged(F.col("spans")).alias("_spans"))
    row = docs.select(row_of(docs), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_text"))
    joined = row.join(cut_list, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left")
    text = F.when(F.col("_spans").isNull(), F.col("_row.text")).otherwise(_without(F.encode("_row.text", "utf-8"), F.col("_spans")))
    out = joined.select("_row", "_spans", text.alias("_new"))

    def new(name: str) -> Column:
        if name == "text":
            return F.col("_new").alias("text")
        old = column(name, "_row")
        if name == "n_chars":
            kind = next(f.dataType for f in docs.schema.fields if f.name == name)
            return F.when(F.col("_spans").isNull(), old).otherwise(F.length("_new").cast(kind)).alias(name)
        return old.alias(name)

    return out.select(*map(new, names))


def _merged(spans: Column) -> Column:
    """Sorted spans with those that overlap or touch made one."""
    pair = "array<struct<span_start:int,span_end:int>>"

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        one = F.struct(s["span_start"].alias("span_start"), s["span_end"].alias("span_end"))
        joined = F.struct(last["span_start"].alias("span_start"), F.greatest(last["span_end"], s["span_end"]).alias("span_end"))
        apart = (F.size(done) == 0) | (s["span_start"] > last["span_end"])
        return F.when(apart, F.concat(done, F.array(one))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined)))

    return F.when(F.size(spans) == 1, F.transform(spans, lambda s: F.struct(s["span_start"].alias("span_start"), s["span_end"].alias("span_end")))).otherwise(
        F.aggregate(spans, F.array().cast(pair), add)
    )


def _without(data: Column, spans: Column) -> Column:
    """The text of ``data`` (bytes) outside sorted spans: the gaps between them joined."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["span_end"]))
    begins = F.concat(F.transform(spans, lambda s: s["span_start"]), F.array(F.octet_length(data).cast("long")))
    gaps = F.zip_with(ends, begins, lambda a, b: F.decode(F.substring(data, (a + 1).cast("int"), (b - a).cast("int")), "utf-8"))
    return F.array_join(gaps, "")
