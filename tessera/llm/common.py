"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.storage import discard, persist

#: Bytes of an Arrow batch, whatever its number of rows; one longer row is a batch of its own.
BATCH_BYTES = 2 << 20
#: Bytes of an input, as its files hold it, for each partition of its shuffles.
PARTITION_BYTES = 32 << 20
#: Keys whose hashes are broadcast, at most (8 bytes each).
BROADCAST_KEYS = 1_000_000
#: Sizes from here on are Spark's word for "not known".
_UNKNOWN = 1 << 60


def short_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts holds on the executors.

    The bound is in bytes, so very long texts make batches of few rows. It is
    a setting of the session that plans read when they run, after the
    operator has returned, so it is only ever lowered and not set back.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def gives_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; when its task ends, what the task has freed goes back to the system.

    A worker serves task after task. Its allocators would hold the most that
    one of them took throughout later stages, where the JVM beside it needs
    that memory.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return task


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError, TypeError):  # glibc has it, other C libraries don't
        ctypes.CDLL(None).malloc_trim(0)


def partitions(df: DataFrame) -> int:
    """Shuffle partitions for the files that ``df`` reads: the session's number, or more for much data."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, -(-size // PARTITION_BYTES)) if size < _UNKNOWN else usual


def column(name: str, of: str = "") -> Column:
    """The column of exactly that name, or that field of the struct ``of``."""
    quoted = name.replace("`", "``")
    return F.col(f"{of}.`{quoted}`" if of else f"`{quoted}`")


def row_of(df: DataFrame) -> Column:
    """All columns of ``df``, whatever their names, as one struct ``_row``."""
    return F.struct(*map(column, df.columns)).alias("_row")


def with_fields(df: DataFrame, names: list[str], more: str) -> StructType:
    """The fields ``names`` of ``df``, whatever their names and types, and those of the DDL text ``more``."""
    own = {f.name: f for f in df.schema.fields}
    return StructType([*(StructField(n, own[n].dataType) for n in names), *StructType.fromDDL(more).fields])


def content_hash(df: DataFrame, names: list[str]) -> Column:
    """A hash of the columns ``names``; maps, which have no hash, count as their sorted entries."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.xxhash64(*(_hashable(column(n), kinds[n].simpleString()) for n in names))


def _hashable(col: Column, kind: str) -> Column:
    return F.to_json(F.struct(col.alias("x"))) if "map<" in kind or "variant" in kind else col


def id_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(col.cast("string")), F.lit(modulus))


def repeated(df: DataFrame, times: str, name: str, most: int, at_once: int = 100_000) -> DataFrame:
    """Each row of ``df`` ``times`` (long, ``most`` at most) times, numbered by ``name`` from 1.

    Only where a row is repeated more than ``at_once`` times are its repeats
    dealt to several tasks; the table is then written first, as it is read twice.
    """
    upto = F.sequence(F.lit(1).cast("long"), F.col(times))
    if most <= at_once:
        return df.withColumn(name, F.explode(upto))
    df = persist(df, "repeated")
    few = df.filter(F.col(times) <= at_once).withColumn(name, F.explode(upto))
    many = df.filter(F.col(times) > at_once).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(at_once).cast("long"))))
    many = many.repartition(F.col("_from"), F.col(times))
    upto = F.sequence(F.col("_from") + 1, F.least(F.col(times), F.col("_from") + at_once))
    return few.unionByName(many.withColumn(name, F.explode(upto)).drop("_from"))


def split_by(rows: DataFrame, keys: DataFrame, count: int, key: str = "k") -> tuple[DataFrame, DataFrame | None]:
    """``rows`` that may have a key of ``keys``, and those that have none.

    A broadcast of the keys' hashes tells them apart, so that only the first
    need be shuffled; rows of other keys with an equal hash are among them.
    Of more than ``BROADCAST_KEYS`` keys (``count``) no broadcast is made: all
    rows are the first, and the second are None.
    """
    if count > BROADCAST_KEYS:
        return rows, None
    # At most BROADCAST_KEYS rows of one long.
    hashes = F.broadcast(keys.select(F.xxhash64(key).alias("_hash_of_key")).distinct())
    met = F.xxhash64(key) == F.col("_hash_of_key")
    return rows.join(hashes, met, "left_semi"), rows.join(hashes, met, "left_anti")


def keep_least(docs: DataFrame, near_duplicates: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` whose name is the least of their component, one of each name.

    A row is named by doc_id, nulls last, and by a hash of all it holds;
    ``near_duplicates`` gives (k, component) for a table (k, text).
    """
    names = docs.columns
    name = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), content_hash(docs, names).alias("h"))
    ranked = docs.select(name.alias("k"), F.col("text").cast("string").alias("text"), row_of(docs))
    marked = persist(near_duplicates(ranked.select("k", "text")), "marked")
    counts = marked.groupBy("k").agg(F.count("*").alias("rows"), F.min("component").alias("component"))
    # Most rows stay and are the only ones of their name: the list of the others decides, and is short.
    other = persist(counts.filter((F.col("rows") > 1) | (F.col("k") != F.col("component"))), "others")
    discard(marked)
    repeated = other.filter(F.col("k") == F.col("component")).select("k")
    near, far = split_by(ranked, other, other.count())
    one = near.join(repeated, "k", "left_semi").groupBy("k").agg(F.first("_row").alias("_row"))
    kept = near.join(other, "k", "left_anti").select("_row.*").unionByName(one.select("_row.*"))
    return kept if far is None else kept.unionByName(far.select("_row.*"))
