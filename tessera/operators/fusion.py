"""Combining ranked lists, and the search modes built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.constants import RRF_K, RRF_TOP


def rrf(lists: list[tuple[str, DataFrame]], k: int = RRF_K, top: int | None = RRF_TOP, by: list[str] | None = None) -> DataFrame:
    """Σ 1/(k + rank) of each id over lists (id, rank), for each value of ``by``.

    Ties go to the id of the earlier list, then of the better rank there. The
    result has the id's rank in each list, null where it has none.
    """
    by = by or []
    tagged = [df.select(*by, "id", "rank", F.lit(i).alias("_list")) for i, (_, df) in enumerate(lists)]
    union = reduce(DataFrame.unionByName, tagged)
    ranks = [F.min(F.when(F.col("_list") == i, F.col("rank"))).alias(f"{name}_rank") for i, (name, _) in enumerate(lists)]
    score = F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 9).alias("score")
    fused = union.groupBy(*by, "id").agg(score, F.min(F.struct("_list", "rank")).alias("_first"), *ranks)
    order = [F.desc("score"), F.col("_first._list"), F.col("_first.rank"), F.col("id")]
    window = Window.partitionBy(*by).orderBy(*order) if by else None
    if top is None:
        return fused.drop("_first")
    if window is None:
        fused = fused.orderBy(*order).limit(top)
        window = Window.orderBy(*order)
    return fused.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= top).drop("_first")


def dominance(fused: DataFrame, first: str, second: str) -> DataFrame:
    """Which list an id came from."""
    has, other = F.col(f"{first}_rank").isNotNull(), F.col(f"{second}_rank").isNotNull()
    return fused.withColumn("dominance", F.when(has & other, "both").when(has, first).when(other, second))


def with_rank(ranked: DataFrame) -> DataFrame:
    """Ranks 1 to n for the outcome of a top-k search, at most ``LIST_DEPTH`` rows."""
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def search(mode: str, semantic: DataFrame, lexical: DataFrame, top: int = RRF_TOP) -> DataFrame:
    """V13: "vibe" and "twin" rank by vector alone, "find" fuses both lists."""
    if mode in ("vibe", "twin"):
        return semantic.filter(F.col("rank") <= top)
    if mode == "find":
        return dominance(rrf([("semantic", semantic), ("lexical", lexical)], top=top), "semantic", "lexical")
    raise ValueError(f"no such mode: {mode}")
