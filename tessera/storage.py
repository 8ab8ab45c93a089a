"""Intermediate tables in the folder that driver and executors share.

The folder is the one the session names in ``spark.checkpoint.dir``. Only where
a session on one machine names none (tests, a laptop) is a temporary folder
made and set; on a cluster that is an error, as executors would not share it.
"""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Spark deletes the shuffle files of an execution when that ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
#: Paths of persisted tables that are still there, in order.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI or path, without a trailing slash."""
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError(f"{_SETTING} names no folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """A table that is written in here leaves no shuffle files: they go when its write ends.

    For what is written once and reread; a plan that ran in here would make
    its shuffles anew if it ran again.
    """
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def persist(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and reread it: lineage ends there.

    The files outlive any executor, so a lost one costs no recomputation.
    """
    path = new_path(df.sparkSession, label)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    _made.append(path)
    return out


def persist_only(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """Persist what ``make`` gives, and delete the tables that were persisted on the way to it."""
    begin = len(_made)
    out = persist(make(), label)
    for path in _made[begin:-1]:
        _delete(out.sparkSession, path)
    del _made[begin:-1]
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a table that ``persist`` made and nothing needs now."""
    path = getattr(df, "_tessera_path", None)
    if path:
        _delete(df.sparkSession, path)
        if path in _made:
            _made.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now, not when the driver next collects garbage.

    Between the phases of a long job that keeps the disk at the need of one phase.
    """
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.5)  # the cleaner runs beside


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
