"""Adding to tables: what is new, what is missing, who may fill it in.

Tables are immutable; an update is a new version derived by a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.dedup import keep_first


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The incoming rows that are new to the target, the first of each key."""
    return keep_first(incoming, keys, order).join(target.select(*keys).distinct(), keys, "left_anti")


def missing_children(parents: DataFrame, children: DataFrame, parent_id: str, child_id: str) -> DataFrame:
    """The parents no child points to."""
    return parents.join(children.select(F.col(child_id).alias(parent_id)).distinct(), parent_id, "left_anti")


def update_column(target: DataFrame, changes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The target with a column's new values where there are some."""
    new = changes.select(*keys, F.col(column).alias("_new"))
    joined = target.join(new, keys, "left")
    return joined.select(*(F.coalesce("_new", column).alias(c) if c == column else F.col(c) for c in target.columns))


def lookup_lyrics(seed: DataFrame, source: DataFrame, order: list[Column]) -> DataFrame:
    """Seed rows with the cleaned lyrics of the first source row of their key, or null."""
    cleaned = F.nullif(text.clean_lyrics(F.col("lyrics")), F.lit(""))
    first = keep_first(source, ["key"], order).select("key", cleaned.alias("found"))
    return seed.join(first, "key", "left")


def waterfall(items: DataFrame, sources: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """Each item's value from the first source that has one, and that source's name."""
    joined = items
    for i, (_, df) in enumerate(sources):
        joined = joined.join(df.select(key, F.col(value).alias(f"_v{i}")), key, "left")
    found = [F.nullif(F.col(f"_v{i}"), F.lit("")) for i in range(len(sources))]
    label = reduce(lambda other, x: F.when(found[x].isNotNull(), F.lit(sources[x][0])).otherwise(other), reversed(range(len(sources))), F.lit(None).cast("string"))
    return joined.select(*items.columns, F.coalesce(*found).alias(value), label.alias("value_source"))


def coverage(df: DataFrame, group: str, have: Column) -> DataFrame:
    """Rows and rows that have something, by group, with the percentage."""
    out = df.groupBy(group).agg(F.count("*").alias("total"), F.count_if(have).alias("found"))
    return out.withColumn("pct", F.round(F.lit(100.0) * F.col("found") / F.col("total"), 1))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of each column, in one pass."""
    counts = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns)))
    return counts.select("_n", pairs.alias("p")).select("p.column", "p.nulls", F.round(F.try_divide(F.lit(100.0) * F.col("p.nulls"), F.col("_n")), 1).alias("pct"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value and their share."""
    out = df.groupBy(column).agg(F.count("*").alias("n"))
    return out.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def source_hits(keys: DataFrame, source: DataFrame, examples: int = 5) -> DataFrame:
    """How many keys a source has and misses, with the first examples of the latter."""
    known = source.select("key").distinct().withColumn("hit", F.lit(True))
    marked = keys.select("key").distinct().join(known, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    counts = marked.agg(F.count("*").alias("keys"), F.count_if("hit").alias("hits"))
    missed = marked.filter("not hit").orderBy("key").limit(examples).agg(F.sort_array(F.collect_list("key")).alias("missed"))
    return counts.crossJoin(missed)


def lengths(df: DataFrame, column: str, source: str | None = None, source_column: str = "lyrics_source") -> DataFrame:
    """How many texts there are, have one (from ``source``) and have none, and their average length."""
    have = F.col(column).isNotNull() & (F.lit(True) if source is None else F.col(source_column) == source)
    length = F.round(F.avg(F.when(have, F.length(column))), 4)
    return df.agg(F.count("*").alias("total"), F.count_if(have).alias("found"), F.count_if(F.col(column).isNull()).alias("missing"), length.alias("avg_length"))


def outcomes(df: DataFrame, value: str = "lyrics", reason: str = "reason") -> DataFrame:
    """How many tries succeeded, found nothing or failed."""
    kind = F.when(F.coalesce(F.col(value), F.lit("")) != "", "success").when(F.col(reason) == "no_results", "no_results").otherwise("error")
    return df.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def merged_counts(df: DataFrame, group: str, gap: int = 3) -> DataFrame:
    """By group the songs, those of several sources, with featured artists, and from the back catalogue."""
    old = F.col("year") - F.col("original_year") > gap
    return df.groupBy(group).agg(
        F.count("*").alias("songs"), F.count_if(F.contains("source", F.lit(","))).alias("multi_source"),
        F.count_if(F.col("featured_artists").isNotNull()).alias("featured"), F.count_if(old).alias("back_catalogue"),
    )


def language_mismatches(df: DataFrame, declared: str, detected: str) -> DataFrame:
    """rows whose detected language, null if none was, isn't the declared one."""
    return df.filter(~F.col(detected).eqNullSafe(F.col(declared)))


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """K8: the first n rows in order, a work list."""
    return df.orderBy(*order).limit(n)


def random_rows(df: DataFrame, columns: list[str], n: int, seed: int = 0) -> DataFrame:
    """K6: n rows in an order that looks random and that the rows and the seed alone decide."""
    return df.orderBy(F.xxhash64(F.lit(seed), *columns), *columns).limit(n)
