"""Scoring texts by prediction with partial matching (PPM).

The model is a trie of byte contexts up to ``ORDER`` bytes with the counts of
the bytes that follow; no context is left out. A byte is predicted in the
longest context that the trie has. With n the context's count and t the number of distinct followers, a
follower seen c times has probability c / (n + t) and the escape to the next
shorter context t / (n + t) (method C); there the followers already seen are
excluded. Below the empty context all bytes not yet excluded are alike. A
text begins after ``ORDER`` bytes 255 and ends with one, which no UTF-8 text
has, so the probabilities of all texts add up to one.

Training is pretrained, not adaptive: counts come from all training texts, so
the probability of each distinct gram (a context of ``ORDER`` bytes and its
follower), escapes and exclusions included, is worked out once and a text's
score is a sum of look-ups. The trie is partitioned by the last two bytes of a
context: all longer contexts that end in them, with all their followers, lie
in one part, and the two lowest orders are at most 65,536 counts.

The baseline is a unigram model over words with additive smoothing. Its counts
are exact. Words and grams are looked up by join: each block of documents asks
once for every distinct one it has.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_remainder, short_batches
from tessera.storage import discard, persist, release

ORDER = 5
#: The bound of ``_least_total``; ``score`` has none.
MAX_CONTEXTS = 65_536
SMOOTHING = 0.1
#: Text of a block, on average.
BLOCK_BYTES = 24_000_000
#: Text whose grams are counted or scored at once, and grams held before they are merged.
PORTION, MERGE_GRAMS = 1_000_000, 3_000_000
END = 255
_GRAM = ORDER + 1


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _layout(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each after ``ORDER`` ends and before one; where each begins."""
    pad = bytes([END]) * ORDER
    data = b"".join(x for t in texts for x in (pad, t.encode("utf-8", "surrogatepass"), pad[:1]))
    sizes = np.fromiter((len(t.encode("utf-8", "surrogatepass")) + _GRAM for t in texts), np.int64, len(texts))
    return np.frombuffer(data, dtype=np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def _keys(data: np.ndarray) -> np.ndarray:
    """Every window of a context and its follower, as one number."""
    key = np.zeros(max(len(data) - ORDER, 0), dtype=np.uint64)
    for j in range(_GRAM):
        key = key << np.uint64(8) | data[j : len(data) - ORDER + j]
    return key


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each context of ``ORDER`` bytes with its follower, as one number, and its count."""
    data, begins = _layout(texts)
    key = _keys(data)
    real = np.ones(len(key), dtype=bool)
    for j in range(1, _GRAM):  # windows that end in the next text's padding
        at = begins[1:-1] - _GRAM + j
        real[at[(at >= 0) & (at < len(key))]] = False
    return np.unique(key[real], return_counts=True)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)


_COUNTS = "kind int, block int, key long, n long"


def _count(dealt: DataFrame) -> DataFrame:
    """Words (kind 0) and byte grams (kind 1) of each block with their training counts there, or 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        others: set[bytes] = set()
        parts = [(np.empty(0, np.uint64), np.empty(0, np.int64))]
        block = 0
        for batch in batches:
            train, held_out = [], []
            for b, held, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                block = b
                if held:
                    others.update(_words(text))
                    held_out.append(text)
                else:
                    words.update(_words(text))
                    train.append(text)
            for seen, texts in ((1, train), (0, held_out)):
                for portion in _portions(texts, PORTION):
                    keys, n = gram_counts(portion)
                    parts.append((keys, n * seen))
                    if sum(len(k) for k, _ in parts) > MERGE_GRAMS:
                        parts = [_merge(parts)]
        grams = _merge(parts)
        others.difference_update(words)
        digest = xxhash.xxh3_64_intdigest
        names = [x.split(" ")[0] for x in _COUNTS.split(", ")]
        for kind, keys, n in (
            (0, np.fromiter(map(digest, words), np.uint64, len(words)), np.fromiter(words.values(), np.int64, len(words))),
            (0, np.fromiter(map(digest, others), np.uint64, len(others)), np.zeros(len(others), np.int64)),
            (1, *grams),
        ):
            for a in range(0, len(keys), 100_000):
                k = keys[a : a + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), kind, np.int32)), pa.array(np.full(len(k), block, np.int32)), pa.array(k.view(np.int64)), pa.array(n[a : a + 100_000])], names
                )

    return dealt.select("block", "held_out", "text").mapInArrow(run, _COUNTS)


class Trie:
    """The contexts and, for each, the logarithms of all followers' probabilities, in memory.

    ``column`` maps bytes to columns; bytes never seen share the last one.
    Contexts of order k are rows ``base[k]`` on of ``log_p``; ``child[k]`` has,
    for an order k - 1 context and a column, the order k context or -1.
    """

    def __init__(self, column: np.ndarray, base: list[int], child: list[np.ndarray], log_p: np.ndarray) -> None:
        self.column, self.base, self.child, self.log_p = column, base, child, log_p

    def score(self, texts: list[str]) -> np.ndarray:
        """log10 of the probability of each text."""
        data, begins = _layout(texts)
        if not texts:
            return np.zeros(0)
        width = self.log_p.shape[1]
        c = self.column[data].astype(np.int64)
        # node[i]: the context of the current order that ends before i, -1 for none.
        node = np.zeros(len(c) + 1, dtype=np.int64)
        row = np.zeros(len(c), dtype=np.int64)
        for k in range(1, len(self.child)):
            step = np.full(len(c) + 1, -1, dtype=np.int64)
            known = node[:-1] >= 0
            step[1:] = np.where(known, self.child[k][np.where(known, node[:-1], 0) * width + c], -1)
            node = step
            found = node[:-1] >= 0
            row = np.where(found, self.base[k] + node[:-1], row)
        p = self.log_p.reshape(-1)[row * width + c].astype(np.float64)
        total = np.concatenate(([0.0], np.cumsum(p)))
        skipped = begins[:-1] + ORDER
        return total[begins[1:]] - total[skipped]


def build(grams: list[tuple[np.ndarray, np.ndarray]]) -> Trie:
    """The trie of (context and follower, count) arrays, one pair for each order from 0."""
    symbols = np.unique(grams[0][0] & np.uint64(255)).astype(np.int64) if len(grams) else np.empty(0, np.int64)
    unseen = len(symbols) < 256
    width = len(symbols) + unseen
    column = np.full(256, width - 1, dtype=np.uint8)
    column[symbols] = np.arange(len(symbols))
    alike = np.ones(width)  # bytes in a column
    if unseen:
        alike[-1] = 256 - len(symbols)
    children, base, counts, parents = [np.empty(0, np.int32)], [0], [np.zeros((1, width))], [np.zeros(1, np.int64)]
    known = [np.zeros(1, np.uint64)]  # sorted contexts of each order
    if len(grams):
        np.add.at(counts[0], (0, column[(grams[0][0] & np.uint64(255)).astype(np.int64)]), grams[0][1])
    for k in range(1, len(grams)):
        keys, n = grams[k]
        contexts = np.unique(keys >> np.uint64(8))
        suffix, prefix = contexts & np.uint64((1 << 8 * (k - 1)) - 1), contexts >> np.uint64(8)
        have = np.isin(suffix, known[-1]) & np.isin(prefix, known[-1])  # its shorter forms may have been left out
        contexts, suffix, prefix = contexts[have], suffix[have], prefix[have]
        child = np.full(max(len(known[-1]), 1) * width, -1, dtype=np.int32)
        at = np.searchsorted(known[-1], prefix).astype(np.int64) * width + column[(contexts & np.uint64(255)).astype(np.int64)]
        child[at] = np.arange(len(contexts))
        dense = np.zeros((len(contexts), width), dtype=np.float32)
        own = np.isin(keys >> np.uint64(8), contexts)
        dense[np.searchsorted(contexts, keys[own] >> np.uint64(8)), column[(keys[own] & np.uint64(255)).astype(np.int64)]] = n[own]
        base.append(base[-1] + len(known[-1]))
        children.append(child)
        counts.append(dense)
        parents.append(np.searchsorted(known[-1], suffix).astype(np.int64))
        known.append(contexts)
    log_p = np.empty((base[-1] + len(known[-1]), width), dtype=np.float32)
    for k in range(len(counts)):
        for a in range(0, len(counts[k]), 4096):
            rows = np.arange(a, min(a + 4096, len(counts[k])))
            log_p[base[k] + rows] = np.log10(_distribution(k, rows, counts, parents, alike))
    return Trie(column, base, children, log_p)


def _distribution(order: int, rows: np.ndarray, counts: list[np.ndarray], parents: list[np.ndarray], alike: np.ndarray) -> np.ndarray:
    """Probabilities of one byte of each column after the contexts ``rows`` of an order."""
    p = np.zeros((len(rows), len(alike)))
    left = np.ones((len(rows), 1))  # probability of having escaped so far
    out = np.zeros(p.shape, dtype=bool)  # excluded
    for k in range(order, -1, -1):
        c = np.where(out, 0.0, counts[k][rows])
        seen = c > 0
        n, t = c.sum(1, keepdims=True), seen.sum(1, keepdims=True)
        total = np.where(t > 0, n + t, 1.0)
        p += np.where(seen, left * c / total, 0.0)
        left = left * np.where(t > 0, t / total, 1.0)
        out |= seen
        rows = parents[k][rows]
    rest = np.where(out, 0.0, alike).sum(1, keepdims=True)
    return p + np.where(out, 0.0, left / np.maximum(rest, 1.0))


def _least_total(totals: DataFrame) -> int:
    """The count a context needs so that no more than ``MAX_CONTEXTS`` have it.

    From a histogram of counts in steps of a sixteenth of a doubling, a few
    hundred rows at most, so no order over all contexts is made.
    """
    step = F.floor(F.log2("total") * 16).cast("int").alias("step")
    room, least = MAX_CONTEXTS, 1 << 62
    for r in sorted(totals.groupBy(step).agg(F.count("*").alias("n"), F.min("total").alias("least")).collect(), reverse=True):
        room -= r["n"]
        if room < 0:
            break
        least = r["least"]
    return least


def low_orders(grams: DataFrame) -> np.ndarray:
    """How often each byte (column) follows each byte (row): 65,536 counts."""
    out = np.zeros((256, 256), dtype=np.int64)
    for r in grams.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("key")).agg(F.sum("n").alias("n")).collect():
        out[r["key"] >> 8, r["key"] & 255] = r["n"]
    return out


def gram_scores(keys: np.ndarray, n: np.ndarray, low: np.ndarray) -> np.ndarray:
    """log10 of the probability of each gram's last byte after the others.

    ``keys`` are distinct, with all grams of the training texts that share
    the last two bytes of a context; n is the training count, maybe 0. The
    followers of a context also follow its shorter forms, so at each order
    those excluded are the followers of the context one byte longer.
    """
    score, left = np.zeros(len(keys)), np.ones(len(keys), dtype=bool)
    above_seen = np.zeros(len(keys))  # followers of the context one byte longer
    gram, count, back = keys, n, np.arange(len(keys))
    for k in range(ORDER, -1, -1):
        # Distinct grams of this order with their counts; ``back`` leads from keys to them.
        if k < ORDER:
            longer, longer_count, longer_back = gram, count, back
            gram, up = np.unique(longer & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            back = up[longer_back]
            if k >= 2:
                count = np.bincount(up, longer_count).astype(np.int64)
            else:
                pairs = low if k else low.sum(0, keepdims=True)
                count = pairs[(gram >> np.uint64(8)).astype(np.int64), (gram & np.uint64(255)).astype(np.int64)]
        if k >= 2:
            _, at = np.unique(gram >> np.uint64(8), return_inverse=True)
            total, seen = np.bincount(at, count)[at][back], np.bincount(at, count > 0)[at][back]
        else:
            row = (gram >> np.uint64(8)).astype(np.int64)
            total, seen = pairs.sum(1)[row][back].astype(float), (pairs > 0).sum(1)[row][back].astype(float)
        if k == ORDER:
            taken = np.zeros(len(keys))
        elif k >= 1:  # counts here of what follows the longer context
            _, at = np.unique(longer >> np.uint64(8), return_inverse=True)
            taken = np.bincount(at, np.where(longer_count > 0, count[up], 0))[at][longer_back]
        else:
            taken = ((low > 0) * low.sum(0)).sum(1)[(longer >> np.uint64(8)).astype(np.int64)][longer_back].astype(float)
        t, c = seen - above_seen, count[back]
        whole = np.where(t > 0, total - taken + t, 1.0)
        here = left & (c > 0)
        score[here] += np.log10(c[here] / whole[here])
        left &= ~here
        escape = left & (t > 0)
        score[escape] += np.log10(t[escape] / whole[escape])
        above_seen = seen
    score[left] -= np.log10(np.maximum(256 - above_seen[left], 1))
    return score


def train(counted: DataFrame) -> DataFrame:
    """(key, p): every gram of ``counted`` and the logarithm of its probability."""
    grams = persist(counted.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n")), "grams")
    low = low_orders(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _whole_suffixes(batches):
            p = gram_scores(keys, n, low)
            for a in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000].view(np.int64)), pa.array(p[a : a + 100_000])], ["key", "p"])

    suffix = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)).alias("suffix")
    parts = grams.select(suffix, "key", "n").repartition("suffix").sortWithinPartitions("suffix")
    out = persist(parts.mapInArrow(run, "key long, p double"), "lm-grams")
    discard(grams)
    return out


def _whole_suffixes(batches: Iterator[pa.RecordBatch], rows: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of about ``rows`` grams or more that end with a suffix."""
    held: list[tuple[np.ndarray, ...]] = []
    size, wanted = 0, rows
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy() for i in range(3)))
        size += batch.num_rows
        if size >= wanted:
            suffix, key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            end = int(np.searchsorted(suffix, suffix[-1]))
            if end:
                yield key[:end].view(np.uint64), n[:end]
            held, size = [(suffix[end:], key[end:], n[end:])], len(key) - end
            wanted = max(rows, 2 * size)
    if size:
        _, key, n = (np.concatenate(x) for x in zip(*held, strict=True))
        yield key.view(np.uint64), n


def text_scores(texts: list[str], index: pd.Index, p: np.ndarray) -> np.ndarray:
    """log10 of the probability of each text, by its grams' places in ``index``."""
    data, begins = _layout(texts)
    if not texts:
        return np.zeros(0)
    total = np.concatenate(([0.0], np.cumsum(p[index.get_indexer(_keys(data).view(np.int64))])))
    return total[begins[1:] - ORDER] - total[begins[:-1]]


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, folds: int = 10, held_out: int = 0) -> DataFrame:
    """Both models' scores of every row of ``docs`` (doc_id, text), learnt from the other folds.

    A row is held out when crc32 of its id modulo ``folds`` is ``held_out``;
    rows with a null id are not. A null text counts as an empty one, which is
    one token, the end. Repeated rows count and are scored each. With nothing
    to learn from, every byte is equally likely; an empty table gives an empty
    result. A very long text costs some sixty times its size in memory, in the
    block of ``BLOCK_BYTES`` or more that it is dealt to. Other columns are
    left out.
    """
    spark = docs.sparkSession
    short_batches(spark)
    is_out = F.coalesce(id_remainder("doc_id", folds) == held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), is_out.alias("held_out"))
    about = rows.agg(F.sum(F.octet_length("text")).alias("size"), F.count_if(~F.col("held_out")).alias("train")).first()
    blocks, train_docs = max(1, math.ceil((about["size"] or 0) / BLOCK_BYTES)), about["train"]
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(blocks)).cast("int"))
    counted = persist(_count(dealt.repartitionById(blocks, F.col("block"))), "lm-counts")
    release(spark)
    predicted = train(counted)
    gram_answer = counted.filter("kind = 1").select("block", "key").join(predicted, "key").select("block", F.lit(0).alias("kind"), "key", F.col("p").alias("value"))
    gram_answer = persist(gram_answer, "lm-block-grams")
    discard(predicted)
    # A word has one row a block at most; they are summed before they meet, and a word that every block has splits in the join.
    words = counted.filter("kind = 0")
    totals = persist(words.groupBy("key").agg(F.sum("n").alias("c")).filter("c > 0"), "lm-word-totals")
    asked = persist(words.select("block", "key").join(totals, "key").select("block", "key", "c"), "lm-words")
    discard(counted)
    release(spark)
    sums = totals.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    discard(totals)
    total, distinct = (sums["n"] or 0) + train_docs, sums["v"] + (train_docs > 0)
    bottom = math.log10(total + SMOOTHING * (distinct + 1))
    missed, ended = math.log10(SMOOTHING) - bottom, math.log10(train_docs + SMOOTHING) - bottom

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        counts: dict[int, int] = {}
        cache: dict[bytes, float] = {}
        grams: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))]
        index = None
        for batch in batches:
            predicted, answers, asks = (batch.filter(pa.compute.equal(batch.column(0), k)) for k in range(3))
            if predicted.num_rows:
                grams.append((predicted.column(1).to_numpy(), predicted.column(2).to_numpy()))
            counts.update(zip(answers.column(1).to_numpy().view(np.uint64).tolist(), map(int, answers.column(2).to_pylist()), strict=True))
            if not asks.num_rows:
                continue
            if index is None:
                index, p = pd.Index(np.concatenate([k for k, _ in grams])), np.concatenate([x for _, x in grams])
                grams.clear()
            ids, texts, held = (asks.column(i).to_pylist() for i in (3, 4, 5))
            tokens, known, base = [], [], []
            for text in texts:
                words = _words(text)
                values = list(map(cache.get, words))
                for i, v in enumerate(values):
                    if v is None:
                        w = words[i]
                        c = counts.get(digest(w), 0)
                        values[i] = cache[w] = math.log10(c + SMOOTHING) - bottom if c else missed
                tokens.append(len(words) + 1)
                known.append(len(words) - values.count(missed) + (train_docs > 0))
                base.append(sum(values) + ended)
            scores = np.concatenate([np.zeros(0), *(text_scores(x, index, p) for x in _portions(texts))])
            columns = [ids, held, tokens, known, [total] * len(ids), base, scores]
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split(" ")[0] for x in _SCORES.split(", ")])

    nothing = (F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("held_out"))
    words = asked.select("block", F.lit(1).alias("kind"), "key", F.col("c").cast("double").alias("value"))
    ask = dealt.select("block", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("double").alias("value"), "doc_id", "text", "held_out")
    both = gram_answer.unionByName(words).select("*", *nothing).unionByName(ask).repartitionById(blocks, F.col("block")).sortWithinPartitions("kind")
    return both.select("kind", "key", "value", "doc_id", "text", "held_out").mapInArrow(run, _SCORES)


def _portions(texts: list[str], size: int = PORTION) -> Iterator[list[str]]:
    held, total = [], 0
    for t in texts:
        held.append(t)
        total += len(t)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held
