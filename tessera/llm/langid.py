"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its
letters: their vectors, the first rolled by two places and the second by one,
are multiplied element by element. A document's vector bundles (adds) those of
its trigrams, a language's prototype those of all its training documents, and
a document gets the language whose prototype has the greatest cosine with it.

Non-letters are word boundaries, which count as one letter of their own at a
word's two ends. Letters beyond a-z share the other codes by a hash of their
code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import gives_back, id_remainder, short_batches, with_fields

DIMENSIONS = 1024
SEED = 20_241
#: Prototypes are held by every worker, so their number is checked.
MAX_LANGUAGES = 4096
#: A block of documents that is counted and multiplied at once.
BLOCK_DOCS, BLOCK_CHARS = 128, 1_000_000
#: Rows of the cache of trigram vectors (4 kB each); it starts anew when full.
CACHE_ROWS = 8192
_CODES = 128
#: The share of the median score of its length that a text must reach: in a language it scores over 0.2 of it but for a few, random letters about 0.1.
OF_MEDIAN = 0.17


@lru_cache(1)
def _code_table() -> np.ndarray:
    """Code point -> 0 (no letter) or 1..127."""
    points = np.arange(0x110000, dtype=np.uint32)
    letters = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
    table = (27 + (points * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(_CODES - 27)).astype(np.uint8)
    table[~letters] = 0
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter vectors as the first, second and third of a trigram."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    v = rng.integers(0, 2, (_CODES, DIMENSIONS), dtype=np.int8) * np.int8(2) - np.int8(1)
    return np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v


class _Trigrams:
    """Vectors of the trigrams met so far, as rows of one matrix."""

    def __init__(self) -> None:
        self.row = np.full(_CODES**3, -1, dtype=np.int32)
        self.rows = np.empty((CACHE_ROWS, DIMENSIONS), dtype=np.float32)
        self.n = 0

    def of(self, grams: np.ndarray) -> np.ndarray:
        if len(grams) > CACHE_ROWS:
            return self._bind(grams)
        new = grams[self.row[grams] < 0]
        if self.n + len(new) > CACHE_ROWS:
            self.row.fill(-1)
            self.n, new = 0, grams
        self.rows[self.n : self.n + len(new)] = self._bind(new)
        self.row[new] = np.arange(self.n, self.n + len(new))
        self.n += len(new)
        return self.rows[self.row[grams]]

    @staticmethod
    def _bind(grams: np.ndarray) -> np.ndarray:
        first, second, third = _letters()
        return (first[grams >> 14] * second[grams >> 7 & 127] * third[grams & 127]).astype(np.float32)


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, document of each trigram, trigram) for runs of documents."""
    table = _code_table()
    at = 0
    while at < len(texts):
        parts, end, size = [], at, 0
        while end < len(texts) and end - at < BLOCK_DOCS and (size < BLOCK_CHARS or end == at):
            parts.append((texts[end] or "").lower())
            size += len(parts[-1]) + 1
            end += 1
        lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        joined = "\n" + "\n".join(parts) + "\n"
        codes = table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        docs = np.repeat(np.arange(len(parts), dtype=np.int32), np.concatenate(([lengths[0] + 1], lengths[1:])))
        keep = codes != 0
        keep[1:] |= codes[:-1] != 0
        codes, docs = codes[keep].astype(np.int32), docs[keep]
        if len(codes) and codes[0]:
            codes, docs = np.concatenate((np.zeros(1, np.int32), codes)), np.concatenate((docs[:1], docs))
        grams = codes[:-2] << 14 | codes[1:-1] << 7 | codes[2:]
        inner = codes[1:-1] != 0
        yield at, end, docs[1:-1][inner], grams[inner]
        at = end


def bundles(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, dim, value): the bundled vector of each language.

    Each task bundles its own documents and sends ``DIMENSIONS`` numbers a
    language, however large its share of the rows is.
    """

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names = sorted(set(langs))
            number = {x: i for i, x in enumerate(names)}
            of_doc = np.fromiter((number[x] for x in langs), np.int64, len(langs))
            for at, _, doc, gram in _blocks(texts):
                keys, n = np.unique(of_doc[at + doc] << 21 | gram, return_counts=True)
                for i in np.unique(keys >> 21):
                    own = keys >> 21 == i
                    old = counts.get(names[i], (np.empty(0, np.int64), np.empty(0, np.int64)))
                    both, where = np.unique(np.concatenate((old[0], keys[own] & (2**21 - 1))), return_inverse=True)
                    counts[names[i]] = both, np.bincount(where, np.concatenate((old[1], n[own]))).astype(np.int64)
        vectors = _Trigrams()
        for name, (grams, n) in sorted(counts.items()):
            total = np.zeros(DIMENSIONS)
            for a in range(0, len(grams), CACHE_ROWS):
                total += n[a : a + CACHE_ROWS] @ vectors.of(grams[a : a + CACHE_ROWS]).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(total.round().astype(np.int64))],
                ["lang", "dim", "value"],
            )

    short_batches(docs.sparkSession)
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    return rows.mapInArrow(run, "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes, learnt from all of ``docs``.

    What reaches the driver is one vector a language; more than
    ``MAX_LANGUAGES`` of them is an error. Rows with a null text or language
    teach nothing. With no rows left, both results are empty.
    """
    rows = bundles(docs, text, lang).filter(F.col("value") != 0)
    got = rows.limit(MAX_LANGUAGES * DIMENSIONS + 1).toArrow()
    if got.num_rows > MAX_LANGUAGES * DIMENSIONS:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(set(got.column("lang").to_pylist()))
    number = {x: i for i, x in enumerate(names)}
    prototypes = np.zeros((len(names), DIMENSIONS))
    at = np.fromiter((number[x] for x in got.column("lang").to_pylist()), np.int64, got.num_rows)
    prototypes[at, got.column("dim").to_numpy()] = got.column("value").to_numpy()
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
    return names, prototypes.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], text: str = "text") -> DataFrame:
    """``keep``'s columns of every row, with ``lang_pred`` and ``score``.

    ``score`` is the greatest cosine, at least 0. ``lang_pred`` is ``und`` and
    the score 0 where the text is null, empty or without a letter, or where no
    language was learnt; of equal cosines the first language by name wins.
    Columns of ``docs`` that ``keep`` doesn't list are left out, so their
    names can't clash. Repeated rows are labelled each; an empty table gives
    an empty result. A very long text is counted in one piece and costs some
    thirty times its size in memory.
    """
    names, prototypes = model

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _Trigrams()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            best, score = np.full(len(texts), -1), np.zeros(len(texts))
            for at, end, doc, gram in _blocks(texts) if names else ():
                if not len(gram):
                    continue
                grams, where = np.unique(gram, return_inverse=True)
                counts = np.bincount(doc * len(grams) + where, minlength=(end - at) * len(grams))
                bundle = counts.reshape(end - at, len(grams)).astype(np.float32) @ vectors.of(grams)
                cosine = bundle @ prototypes.T / np.maximum(np.linalg.norm(bundle, axis=1, keepdims=True), 1e-12)
                seen = np.bincount(doc, minlength=end - at) > 0
                best[at:end] = np.where(seen, cosine.argmax(1), -1)
                score[at:end] = np.where(seen, cosine.max(1).clip(0, 1), 0)
            chosen = pa.array([names[i] if i >= 0 else "und" for i in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], chosen, pa.array(score)], [*batch.schema.names[1:], "lang_pred", "score"])

    short_batches(docs.sparkSession)
    rows = docs.select(F.col(text).cast("string").alias("_text"), *keep)
    return rows.mapInArrow(run, with_fields(rows, rows.columns[1:], "lang_pred string, score double"))


def least_scores(scored: DataFrame, text: str = "text", size: str = "") -> Column:
    """The score below which a text is taken to be in none of the languages, by its length.

    It is ``OF_MEDIAN`` of the median score of all rows of ``scored`` (text,
    score) of about that length, between two powers of two, as short texts
    score low whatever their language. Texts in other languages or of random
    letters don't lower it much while they are less than half. At most 32 rows
    reach the driver. ``size`` is a column of ``scored`` with the length of
    the text, where it lacks the text itself.
    """
    of = lambda size: F.floor(F.log2(size + 1)).cast("int")
    length = of(F.length(text))
    found = scored.filter("score > 0").groupBy(of(F.col(size) if size else F.length(text)).alias("length")).agg(F.percentile_approx("score", 0.5, 10_000).alias("median")).collect()
    limit = F.lit(0.0)
    for r in found:
        limit = F.when(length == r["length"], OF_MEDIAN * r["median"]).otherwise(limit)
    return limit


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Learn from the rows outside one fold of ``doc_id`` and label every row.

    A row is held out when crc32 of its id modulo ``folds`` is ``held_out``;
    rows with a null id are not. Repeated rows are labelled each, nulls and
    empty tables as in ``predict``.
    """
    is_out = F.coalesce(id_remainder("doc_id", folds) == held_out, F.lit(False))
    model = fit(docs.filter(~is_out))
    return predict(docs.withColumn("held_out", is_out), model, ["doc_id", "held_out"])
