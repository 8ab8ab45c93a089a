"""Whitening of vectors from their exact scatter matrix, by residue numbers.

Vectors become integers. Each task multiplies its rows' residues modulo some
primes as matrices of doubles: with primes below 2^20 and 4,096 rows at once
every sum stays below 2^53, so the products are exact in any order. Residues
are summed over the tasks, and the Chinese remainder theorem gives the sums
and the scatter of all rows as whole integers, however large. The covariance
is centred in integers and only then rounded, once an entry; its eigenvectors
are taken in doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import column, short_batches, with_fields

#: Entries are multiplied by SCALE, rounded down and moved by OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Rows of one exact product, the bound of the primes, and the components returned at most.
CHUNK, BELOW, COMPONENTS = 4096, 1 << 20, 32
#: Integers beyond this are cut to it; a float of 32 bits comes so far only above 7 * 10^16.
LIMIT = 1 << 62
#: An eigenvalue below this share of the largest is zero as far as doubles can tell.
NEGLIGIBLE = 1e-13


def primes(bound: int) -> list[int]:
    """The largest primes below ``BELOW`` whose product exceeds ``bound``."""
    out, p = [], BELOW - 1
    while prod(out) <= bound:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
        p -= 2
    return out


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(64 * c) + 1,000,000 of each entry."""
    return np.clip(np.floor(SCALE * vectors.astype(np.float64)), -LIMIT, LIMIT - 2 * OFFSET).astype(np.int64) + OFFSET


def usable(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows of ``df`` whose vector has finite entries only and the commonest length, and that length (0: no rows).

    Of lengths equally common the greater counts; empty vectors are left out.
    """
    v = column(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = df.filter(v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)))
    common = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows.filter(F.size(v) == common["d"]), common["d"]) if common else (rows, 0)


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _gram(x: np.ndarray, moduli: list[int], sums: np.ndarray) -> None:
    """Add the products of the columns of ``x``, and of a column of ones, to ``sums`` modulo each prime."""
    for a in range(0, len(x), CHUNK):
        for k, p in enumerate(moduli):
            r = np.ones((len(x[a : a + CHUNK]), x.shape[1] + 1))
            r[:, :-1] = x[a : a + CHUNK] % p
            sums[k] = (sums[k] + (r.T @ r).astype(np.int64)) % p


def _combine(residues: list[int], moduli: list[int]) -> int:
    """The integer nearest zero with these residues."""
    whole = prod(moduli)
    x = sum(r * (whole // p) * pow(whole // p, -1, p) for r, p in zip(residues, moduli, strict=True)) % whole
    return x - whole if 2 * x > whole else x


@dataclass
class Whitening:
    """What is learnt: the number of rows, the integer sums, and components by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    primes: list[int] = field(default_factory=list)

    def used(self) -> np.ndarray:
        """Which components have an eigenvalue that isn't zero."""
        return (self.values > 0) & (self.values > NEGLIGIBLE * self.values.max(initial=0.0))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n in doubles; the difference is taken in integers where these fit."""
        if self.n * 2 * int(np.abs(x).max(initial=0)) < 1 << 62 and max(map(abs, self.sums)) < 1 << 62:
            return (self.n * x - np.array(self.sums, dtype=np.int64)) / self.n
        return np.array([[(self.n * int(c) - s) / self.n for c, s in zip(row, self.sums, strict=True)] for row in x.tolist()]).reshape(x.shape)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """The rows ``x`` on the components, each with variance 1; nan where the variance is zero."""
        used = self.used()
        return (self.centred(x) @ self.components) * np.where(used, 1 / np.sqrt(np.where(used, self.values, 1.0)), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum((n * x - S)^2) of each row, exactly; null where a long can't hold it."""
        about = self.n * np.abs(self.centred(x))
        if (about**2).sum(axis=1).max(initial=0.0) < 1 << 62 and self.n * int(np.abs(x).max(initial=0)) < 1 << 62:
            return ((self.n * x - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        whole = [sum((self.n * c - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [w if w < 1 << 63 else None for w in whole]


def fit(rows: DataFrame, vector: str, d: int, components: int = COMPONENTS) -> Whitening:
    """Learn from all ``rows``, whose vectors have ``d`` finite entries (``usable``).

    What reaches the driver is one number a cell of a matrix of d + 1 columns
    for each prime: it depends on the length of the vectors, not on the rows.
    """
    v = column(vector)
    size = rows.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform(v, lambda c: F.abs(c.cast("double"))))).alias("top")).first()
    if not size["n"]:
        return Whitening(0, [0] * d, np.zeros((d, min(components, d))), np.zeros(min(components, d)), 0.0)
    top = min(LIMIT, int(SCALE * size["top"]) + 1) + OFFSET
    moduli = primes(2 * size["n"] * top * top + 1)
    low, high = np.triu_indices(d + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(moduli), d + 1, d + 1), np.int64)
        for batch in batches:
            _gram(integers(_matrix(batch.column(0), d)), moduli, sums)
        cells = [pa.array(np.arange(len(low), dtype=np.int32)), *(pa.array(s[low, high]) for s in sums)]
        yield pa.RecordBatch.from_arrays(cells, ["cell", *(f"r{k}" for k in range(len(moduli)))])

    names = [f"r{k}" for k in range(len(moduli))]
    made = rows.select(v.alias("v")).mapInArrow(run, ", ".join(["cell int", *(f"{r} long" for r in names)]))
    got = made.groupBy("cell").agg(*(F.sum(r).alias(r) for r in names)).collect()
    whole = np.zeros((d + 1, d + 1), dtype=object)
    for row in got:
        i, j = int(low[row["cell"]]), int(high[row["cell"]])
        whole[i, j] = whole[j, i] = _combine([row[r] % p for r, p in zip(names, moduli, strict=True)], moduli)
    n, sums = int(whole[d, d]), [int(s) for s in whole[d, :d]]
    covariance = np.array([[(n * whole[i, j] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)], dtype=np.float64)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    trace = sum(n * whole[i, i] - sums[i] ** 2 for i in range(d)) / (n * n)
    return Whitening(n, sums, vectors[:, :components].copy(), values[:components].copy(), trace, moduli)


def identity_error(rows: DataFrame, vector: str, d: int, model: Whitening) -> float | None:
    """The largest entry, by size, of the whitened rows' covariance minus the identity; null without a component.

    Each task centres its rows at their own mean before it multiplies; the
    tasks' means are brought in where they are summed.
    """
    used = np.flatnonzero(model.used())
    c = len(used)
    if not c:
        return None
    low, high = np.triu_indices(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, moment = 0, np.zeros(c), np.zeros((c, c))
        for batch in batches:
            w = model.whiten(integers(_matrix(batch.column(0), d)))[:, used]
            if len(w):
                own = w.mean(axis=0)
                shift, rest = own - mean, w - own
                moment += rest.T @ rest + np.outer(shift, shift) * (n * len(w) / (n + len(w)))
                mean += shift * (len(w) / (n + len(w)))
                n += len(w)
        if n:
            columns = [pa.array(np.arange(len(low), dtype=np.int32)), pa.array(moment[low, high]), pa.array(n * mean[low] * mean[high]), pa.array(n * mean[low]), pa.array(n * mean[high])]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "moment", "between", "a", "b"])

    made = rows.select(column(vector).alias("v")).mapInArrow(run, "cell int, moment double, between double, a double, b double")
    got = made.groupBy("cell").agg(*(F.sum(x).alias(x) for x in ("moment", "between", "a", "b"))).collect()
    n = model.n
    return max(abs((r["moment"] + r["between"] - r["a"] * r["b"] / n) / n - (low[r["cell"]] == high[r["cell"]])) for r in got)


def whiten(df: DataFrame, vector: str, names: list[str], components: int = COMPONENTS) -> DataFrame:
    """Columns ``names`` of ``df`` with n, deviation, whitened and explained (arrays by component) and identity_error.

    Rows whose vector is null, empty, of another length than the commonest or
    with null or non-finite entries are left out. Repeated rows count each.
    ``explained`` is a component's share of the whole variance. A component
    without variance (fewer rows than dimensions, a constant entry) has null
    values; with no variance at all ``explained`` is null too. Components of
    equal variance are any basis of their space, the same for all rows. No
    rows give no rows.
    """
    short_batches(df.sparkSession)
    rows, d = usable(df, vector)
    model = fit(rows, vector, d, components)
    error = identity_error(rows, vector, d, model) if model.n else None
    explained = (model.values / model.trace).tolist() if model.trace else [None] * len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(_matrix(batch.column(batch.num_columns - 1), d)) if batch.num_rows else np.zeros((0, d), np.int64)
            w = model.whiten(x)
            k = w.shape[1]
            ends = pa.array(np.arange(0, (len(w) + 1) * k, k or 1, dtype=np.int32)[: len(w) + 1] if k else np.zeros(len(w) + 1, np.int32))
            values = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            shares = pa.array([explained] * len(w), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.full(len(w), model.n)), pa.array(model.deviations(x), pa.int64()), pa.ListArray.from_arrays(ends, values), shares, pa.array([error] * len(w), pa.float64())],
                [*batch.schema.names[:-1], *_ADDED],
            )

    schema: StructType = with_fields(df, names, ", ".join(f"{n} {t}" for n, t in _ADDED.items()))
    return rows.select(*map(column, names), column(vector).alias("_vector")).mapInArrow(run, schema)


_ADDED = {"n": "long", "deviation": "long", "whitened": "array<double>", "explained": "array<double>", "identity_error": "double"}


def components_of(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each row and component (from 1): id, component, n, deviation, whitened, explained, identity_error."""
    made = whiten(df.select(column(id_column), column(vector)), vector, [id_column], components)
    each = made.select(column(id_column), "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("_at", "_c"))
    return each.select(column(id_column), (F.col("_at") + 1).cast("int").alias("component"), "n", "deviation", F.col("_c.whitened").alias("whitened"), F.col("_c.explained").alias("explained"), "identity_error")
