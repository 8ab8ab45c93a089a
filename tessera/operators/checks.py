"""Acceptance checks as rows (check, ok, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checks(df: DataFrame, key: str, group: str, rows: tuple[int, int], floor: int, required: list[str], prior: DataFrame | None = None) -> DataFrame:
    """Row count in range, no key twice, enough rows in every group, required values there, nothing of an earlier set."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(required)]
    total = df.agg(F.count("*").alias("n"), *nulls)
    keys = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("twice"))
    groups = df.groupBy(group).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") < floor).alias("below"))
    one = total.crossJoin(keys).crossJoin(groups)  # one row each
    if prior is not None:
        one = one.crossJoin(df.join(prior.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("shared")))
    missing = sum((F.col(f"_{i}") for i in range(len(required))), F.lit(0))
    found = [
        ("row_count", F.col("n").between(*rows), F.col("n")),
        ("no_duplicates", F.col("twice") == 0, F.col("twice")),
        ("group_floor", F.col("below") == 0, F.col("below")),
        ("required_values", missing == 0, missing),
    ]
    if prior is not None:
        found.append(("no_overlap", F.col("shared") == 0, F.col("shared")))
    structs = [F.struct(F.lit(n).alias("check"), ok.alias("ok"), d.cast("long").alias("detail")) for n, ok, d in found]
    return one.select(F.inline(F.array(*structs)))
