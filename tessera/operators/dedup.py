"""Keeping one record of each song, and leaving out what other sets have.

Order decides ties everywhere, so every function takes the columns of a total
order; partitions never do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Nulls form a key like any value.

    Keys may be long texts: rows are grouped and sorted by a hash first, and
    by the keys only where hashes agree.
    """
    w = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_seen(df: DataFrame, value: str, order: list[Column]) -> DataFrame:
    """The first row of each value, upper and lower case alike."""
    return keep_first(df.withColumn("_fold", F.lower(value)), ["_fold"], order).drop("_fold")


def exclude_prior(df: DataFrame, priors: list[tuple[str, DataFrame]], key: str = "key") -> DataFrame:
    """The rows whose key no earlier set has."""
    if not priors:
        return df
    keys = reduce(DataFrame.unionByName, (p.select(key) for _, p in priors)).distinct()
    return df.join(keys, key, "left_anti")


def exclusion_counts(df: DataFrame, priors: list[tuple[str, DataFrame]], key: str = "key") -> DataFrame:
    """(set, removed): the rows each earlier set removes, counted for the first that has them."""
    sets = [p.select(key).withColumn("_set", F.lit(i)) for i, (_, p) in enumerate(priors)]
    first = reduce(DataFrame.unionByName, sets).groupBy(key).agg(F.min("_set").alias("_set"))
    names = F.array(*(F.lit(n) for n, _ in priors))
    hit = df.join(first, key).groupBy("_set").agg(F.count("*").alias("removed"))
    return hit.select(F.get(names, F.col("_set")).alias("set"), "removed")


def drop_variants(df: DataFrame, is_variant: Column, artist_key: str = "artist_key", title: str = "title", key: str = "key") -> DataFrame:
    """Without variants whose base title stands among the others.

    A variant's base is its title less one bracket at the end, by the same
    artist; variants without one stay.
    """
    base_key = F.concat(F.col(artist_key), F.lit("|||"), text.normalize_key(text.strip_bracket(F.col(title))))
    marked = df.withColumn("_alt", F.coalesce(is_variant, F.lit(False))).withColumn("_base", F.when(F.col("_alt"), base_key))
    bases = marked.filter(~F.col("_alt")).select(F.col(key).alias("_base")).distinct()
    # Rows that are no variant have no base to look for and always stay.
    return marked.join(bases, "_base", "left_anti").select(*df.columns)


def merge_seed(tiers: list[tuple[str, DataFrame]], columns: list[str], key: str = "key") -> DataFrame:
    """All tiers one after another, the first row of each key; missing columns null."""
    labelled = [df.withColumn("tier", F.lit(name)).withColumn("_tier", F.lit(i)) for i, (name, df) in enumerate(tiers)]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)
    for c in columns:
        if c not in merged.columns:
            merged = merged.withColumn(c, F.lit(None).cast("string"))
    return keep_first(merged, [key], [F.col("_tier"), F.col("seq")]).select(*columns, "tier", key)
