"""Document fingerprints from prefix polynomial hashes.

For a text c_0 ... c_(n-1) of code points the prefix array S_i is the sum of
(c_j + 1) B^j over j < i, modulo the prime 2^31 - 1, for two bases B. From it
the hash of any span follows in one step: (S_(i+l) - S_i) B^(-i). Spans of two
texts are equal when their hashes are, and the longest common extension from
two places is found by binary search over span lengths.

A fingerprint holds the length, the hash of the whole text and sketches: of
the hashes of all spans of ``WIDTH`` code points, the least in each of
``BINS`` bins, and for texts shorter than ``SHORT`` the same for spans of
``NARROW``. Two fingerprints are as alike as the share of bins that agree, in
the narrow sketch where both have one, else in the wide one.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import partitions, repeated, short_batches

PRIME = (1 << 31) - 1
BASES = (1_000_003, 998_244_353)
WIDTH, BINS = 32, 64
#: A text has a narrow sketch below this length, and a wide one from twice ``WIDTH`` on.
SHORT, NARROW = 1024, 8
_EMPTY = "----"
_P, _S31 = np.uint64(PRIME), np.uint64(31)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2^62: folds replace the division."""
    x = (x & _P) + (x >> _S31)
    x = (x & _P) + (x >> _S31)
    return np.where(x >= _P, x - _P, x)


class _Powers:
    """B^j and B^(-j) for one base, as far as the longest text so far needs."""

    def __init__(self, base: int) -> None:
        self.steps = (base, pow(base, -1, PRIME))
        self.tables = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]

    def upto(self, n: int) -> list[np.ndarray]:
        for k, step in enumerate(self.steps):
            table = self.tables[k]
            while len(table) < n:
                table = np.concatenate((table, _mod(table * np.uint64(pow(step, len(table), PRIME)))))
            self.tables[k] = table
        return [t[:n] for t in self.tables]


_POWERS = [_Powers(b) for b in BASES]


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.sums, self.back = [], []
        for powers in _POWERS:
            up, down = powers.upto(self.n + 1)
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(_mod(points * up[: self.n]), out=sums[1:])
            self.sums.append(_mod(sums))
            self.back.append(down)

    def span(self, at: int, length: int) -> tuple[int, int]:
        """The hash of ``length`` code points from ``at``, wherever they stand."""
        return tuple((int(s[at + length]) - int(s[at])) % PRIME * int(b[at]) % PRIME for s, b in zip(self.sums, self.back, strict=True))

    def spans(self, width: int) -> np.ndarray:
        """The hashes of all spans of one width, both bases in 62 bits."""
        last = self.n - width + 1
        one, two = (_mod(_mod(s[width:] + _P - s[:last]) * b[:last]) for s, b in zip(self.sums, self.back, strict=True))
        return one << _S31 | two

    def sketch(self, width: int) -> str:
        mixed = self.spans(min(width, self.n)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        least = np.full(BINS, 1 << 58, dtype=np.uint64)
        np.minimum.at(least, (mixed >> np.uint64(58)).astype(np.intp), mixed & np.uint64((1 << 58) - 1))
        return "".join(_EMPTY if x >> 58 else f"{x & 0xFFFF:04x}" for x in least.tolist())

    def fingerprint(self) -> str:
        whole = "".join(f"{x:08x}" for x in self.span(0, self.n))
        wide = self.sketch(WIDTH) if self.n >= 2 * WIDTH else ""
        narrow = self.sketch(NARROW) if 0 < self.n < SHORT else ""
        return f"{self.n:x}.{whole}.{wide}.{narrow}"


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """How many code points from ``i`` in a and ``j`` in b agree."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(i, middle) == b.span(j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def likeness(one: str, two: str) -> float:
    """Of the bins that either sketch fills, the share in which both agree; 1 for equal ones."""
    if one == two:
        return 1.0
    *_, wide, narrow = one.split(".")
    *_, other_wide, other_narrow = two.split(".")
    a, b = (narrow, other_narrow) if narrow and other_narrow else (wide, other_wide)
    size = len(_EMPTY)
    pairs = [(a[k : k + size], b[k : k + size]) for k in range(0, BINS * size, size)] if a and b else []
    filled = [(x, y) for x, y in pairs if x != _EMPTY or y != _EMPTY]
    return sum(x == y for x, y in filled) / len(filled) if filled else 0.0


def edited(text: str, following: str) -> str:
    """The text, its last half (rounded down) replaced by as much of another's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
)


def _ranges(rows: DataFrame, wanted: int) -> tuple[DataFrame, int]:
    """``rows`` (doc_id, text, h) with ``times`` and ``part``, and the greatest ``times``.

    Parts' numbers follow the order of (doc_id, h), null ids last.
    Parts are ranges of ids between quantiles. An id that is a quantile more
    than once has that many parts of its own, as have null ids, by ranges of
    h; of these rows, those alike in id and text are counted and sent once.
    """
    spark = rows.sparkSession
    quantiles = F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)] or [0.5], 10 * max(wanted, 1000)).alias("cut")
    about = rows.agg(quantiles, F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("null")).first()
    cut = Counter(about["cut"] or [0])
    # A range for each distinct quantile, for ids below them all, and for null ids: (first id, parts by h of that id, first part).
    bounds = [(0, None, 0), *((i, x, cut[x] if cut[x] > 1 else 0) for i, x in enumerate(sorted(cut), 1))]
    bounds.append((len(bounds), None, max(1, -(-wanted * about["null"] // max(about["n"], 1)))))
    table, part = [], 0
    for i, x, split in bounds:
        table.append((i, x, split, part))
        part += split if i == len(bounds) - 1 else split + 1
    # One row a partition: small enough to broadcast.
    ranges = F.broadcast(spark.createDataFrame(table, "_range int, _id long, _split int, _first int"))
    splits = [float("-inf"), *(float(x) for _, x, _ in bounds[1:-1]), float("inf")]
    marked = rows.withColumn("_double", F.col("doc_id").cast("double"))
    marked = Bucketizer(splits=splits, inputCol="_double", outputCol="_range", handleInvalid="keep").transform(marked).drop("_double")
    marked = marked.withColumn("_range", F.when(F.col("doc_id").isNull(), len(bounds) - 1).otherwise(F.col("_range").cast("int"))).join(ranges, "_range")
    own = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * F.col("_split")).cast("int")
    own = F.least(F.greatest(own, F.lit(0)), F.col("_split") - 1)
    by_hash = (F.col("_split") > 0) & F.col("doc_id").eqNullSafe(F.col("_id"))
    # Numbers that are one as doubles share a range: those below its first id belong to the part before.
    place = F.when(by_hash, own).when(F.col("doc_id") < F.col("_id"), -1).otherwise(F.col("_split"))
    marked = marked.withColumn("part", F.col("_first") + place).select("doc_id", "text", "h", by_hash.alias("_hot"), "part")
    columns = ["doc_id", "text", "h", "part", "times"]
    plain = marked.withColumn("times", F.lit(1).cast("long"))
    if not any(split for *_, split in bounds[:-1]) and not about["null"]:
        return plain.select(columns), 1
    alike = marked.filter("_hot").groupBy("doc_id", "h", "part").agg(F.first("text").alias("text"), F.count("*").alias("times"))
    most = alike.agg(F.max("times")).first()[0] or 1
    return plain.filter("not _hot").select(columns).unionByName(alike.select(columns)), most


def neighbours(docs: DataFrame) -> DataFrame:
    """Every row with the fingerprints of its text, of an edited text and of the next row's.

    The next row is that with the next greater (doc_id, xxhash64 of the text),
    null ids last, and the first row's after the last; a single row is its
    own. A null text counts as an empty one. Repeated rows follow one another.
    An empty table gives an empty result. Other columns are left out. A very
    long text costs some eighty times its size in memory. Rows are dealt by
    ranges, and each range also gets the first row of the next one, so no
    order over all rows is ever made in one task.
    """
    spark = docs.sparkSession
    short_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    rows, most = _ranges(rows, partitions(docs))
    # One row a range, the least of each: as many as there are partitions.
    least = sorted(tuple(r) for r in rows.groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("first")).select("part", "first.doc_id", "first.h").collect())
    if not least:
        return spark.createDataFrame([], _OUT)
    firsts = F.broadcast(spark.createDataFrame([(*x, least[i - 1][0]) for i, x in enumerate(least)], "part int, first_id long, first_h long, previous int"))
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("tail"))
    copy = F.struct(F.col("previous").alias("part"), F.lit(1).alias("tail"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    dealt = rows.join(firsts, "part").select("doc_id", "text", "h", "times", F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own))).alias("_to"))
    dealt = dealt.select(F.col("_to.part").alias("part"), F.col("_to.tail").alias("tail"), "doc_id", "text", "h", "times").repartitionById(least[-1][0] + 1, F.col("part"))
    ordered = dealt.sortWithinPartitions("part", "tail", F.col("doc_id").asc_nulls_last(), "h").select("tail", "doc_id", "text", "times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for batch in batches:
            for tail, doc_id, value, times in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held is None:
                    if tail:
                        continue  # a second copy of a repeated first row
                    held = (doc_id, value, PrefixHash(value))
                    held += (held[2].fingerprint(),)
                else:
                    following = (doc_id, value, held[2], held[3]) if value == held[1] else (doc_id, value, found := PrefixHash(value), found.fingerprint())
                    rows.append((*_compare(held, following), 1))
                    held = None if tail else following
                if held and times > 1:  # all but the last of rows alike are followed by one like them
                    rows.append((*_compare(held, held), times - 1))
            if len(rows) >= 500:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return repeated(ordered.mapInArrow(run, f"{_OUT}, _times long"), "_times", "_i", most).drop("_times", "_i")


def _compare(held: tuple, following: tuple) -> tuple:
    doc_id, text, own, mark = held
    changed = edited(text, following[1])
    other = own if changed == text else PrefixHash(changed)
    other_mark = other.fingerprint()
    return (
        doc_id,
        own.n,
        hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
        mark,
        other_mark,
        likeness(mark, other_mark),
        likeness(mark, following[3]),
        common_extension(own, 0, other, 0),
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    fields = [*(x.split(" ") for x in _OUT.split(", ")), ["_times", "long"]]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])
