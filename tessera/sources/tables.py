"""Reading and writing tables: CSV, JSON documents, versions, exports."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SONGS = "id long, artist string, featured_artists string, title string, year int, genre string, tier string, genius_id int, lyrics string, lyrics_source string, created_at timestamp"
PASSAGES = "id long, song_id long, passage_text string, start_line int, end_line int, embedding array<float>, created_at timestamp, language string, embedding_multi array<float>"
SEED = "artist string, featured_artists string, title string, year int, decade string, genre string, original_year int, genius_id int, source string, source_rank double, tier string"


def read_csv_text(spark: SparkSession, path: str, columns: list[str], **labels: str) -> DataFrame:
    """A CSV file with a header, all columns strings, in the given columns.

    Columns the file lacks are null; labels are added as constants.
    """
    found = spark.read.csv(path, header=True, multiLine=True, escape='"')
    picked = [F.col(f"`{c}`").cast("string") if c in found.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return found.select(*picked, *(F.lit(v).alias(k) for k, v in labels.items()))


def read_csv_typed(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """A CSV file by a schema; on request a missing file is an empty table. Nulls stay null."""
    try:
        return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')
    except AnalysisException:
        if not missing_ok:
            raise
        return spark.createDataFrame([], schema)


FAILURES = "artist string, title string, tier string, year string, reason string"


def replace(df: DataFrame, path: str, kind: str, **options: object) -> None:
    """Write a new version of a folder beside the old one and put it in its place when it is whole.

    A job that fails leaves the old version as it was; what reads ``path``
    itself may be written to it. Only the two renames are not one step: a
    driver lost between them leaves the old version under ``.old``, which the
    next call brings back first.
    """
    spark, aside = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, new, old = hadoop(path), hadoop(aside), hadoop(f"{path}.old")
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(old) and not store.exists(target):
        store.rename(old, target)
    try:
        df.write.format(kind).options(**options).save(aside)
    except Exception:
        store.delete(new, True)
        raise
    store.delete(old, True)
    if store.exists(target):
        store.rename(target, old)
    store.rename(new, target)
    store.delete(old, True)


def write_csv(df: DataFrame, path: str) -> None:
    """S3: a CSV folder with headers, replaced as a whole."""
    replace(df, path, "csv", header=True, escape='"')


def append_failures(df: DataFrame, path: str) -> None:
    """Add to the log of failures; its columns are fixed and its values are strings.

    Each part has a header, which ``read_csv_typed`` with ``FAILURES`` skips.
    """
    names = [f.split(" ")[0] for f in FAILURES.split(", ")]
    known = set(df.columns)
    rows = df.select(*((F.coalesce(F.col(n).cast("string"), F.lit("")) if n in known else F.lit("")).alias(n) for n in names))
    rows.write.mode("append").csv(path, header=True, escape='"')


def read_document(spark: SparkSession, path: str, schema: str | T.StructType, items: str | None = None, strict: bool = False, lines: bool = False) -> DataFrame:
    """JSON documents, one a file or one a line, on request the rows of one of their arrays.

    A corrupt one has no rows, or is an error if ``strict``.
    """
    found = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path, multiLine=not lines)
    return found.select(F.inline(F.col(items))) if items else found


def write_document(df: DataFrame, path: str) -> None:
    """JSON lines, replaced as a whole."""
    replace(df, path, "json")


def create_table(spark: SparkSession, name: str, schema: str) -> bool:
    """Make a table unless it is there; whether it was made."""
    made = not spark.catalog.tableExists(name)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")
    return made


def append(df: DataFrame, path: str) -> None:
    """Add rows to a table, all of them or none."""
    df.write.mode("append").parquet(path)


def regenerate(df: DataFrame, path: str) -> None:
    """Replace a table's rows by new ones."""
    replace(df, path, "parquet")


def cascade(parents: DataFrame, children: DataFrame, parent_id: str, child_id: str) -> DataFrame:
    """The children whose parent is still there; those without a parent's id stay, as a null refers to nothing."""
    known = parents.select(F.col(parent_id).alias(child_id)).distinct()
    return children.filter(F.col(child_id).isNull()).unionByName(children.join(known, child_id, "left_semi").select(*children.columns))


def export(df: DataFrame, path: str, with_multi: bool = False, with_fts: bool = False, plain: bool = False) -> int:
    """Write passages without the columns a lean copy doesn't need; the bytes written.

    ``plain`` writes JSON lines, which any reader opens, instead of Parquet.
    """
    dropped = ([] if with_multi else ["embedding_multi"]) + ([] if with_fts else ["passage_tsv"])
    replace(df.drop(*dropped), path, "json" if plain else "parquet")
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def collect_sources(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """All sources one after another, with ``source`` and ``seq``, their order of arrival.

    Within a source rows keep their own ``seq``; it must not exceed 2^40.
    """
    labelled = [df.withColumn("source", F.lit(name)).withColumn("seq", F.col("seq") + F.lit(i << 40)) for i, (name, df) in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def first_with_rows(candidates: list[DataFrame]) -> DataFrame:
    """The first source that has a row, else the last."""
    return next((df for df in candidates[:-1] if not df.isEmpty()), candidates[-1])


def sniff(df: DataFrame, names: dict[str, list[str]], rows: int = 50_000) -> DataFrame:
    """The first rows of a source, of any number, under known names."""
    return unify_columns(df.limit(rows), names)


def unify_columns(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """One column for each name from whichever of its aliases the table has, the first first."""
    low = {c.lower(): c for c in df.columns}
    out = []
    for name, aliases in names.items():
        have = [F.col(f"`{low[a.lower()]}`").cast("string") for a in aliases if a.lower() in low]
        out.append((F.coalesce(*have) if have else F.lit(None).cast("string")).alias(name))
    return df.select(*out)
