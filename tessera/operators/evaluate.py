"""Quality of rankings and agreement of graders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.constants import MAX_GRADE, NDCG_AT, RECALL_AT, RELEVANT, SMALL_SLICE

_NAN = float("nan")


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1.0)


def per_query(df: DataFrame, by: list[str], relevant: int = RELEVANT, at: int = NDCG_AT) -> DataFrame:
    """recall@k (1 if any hit), reciprocal rank, DCG and NDCG of rows (query_id, rank, grade).

    The ideal order is that of the query's own grades; without gain NDCG is 0.
    """
    keys = ["query_id", *by]
    ideal = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("grade"), "rank"))
    hit = F.col("grade") >= relevant
    recalls = [F.max(F.when((F.col("rank") <= k) & hit, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in RECALL_AT]
    grouped = df.withColumn("_ideal", ideal).groupBy(*keys).agg(
        *recalls,
        F.coalesce(F.lit(1.0) / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.sum(F.when(F.col("rank") <= at, _gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("_ideal") <= at, _gain(F.col("grade"), F.col("_ideal"))).otherwise(0.0)).alias("idcg"),
    )
    ndcg = F.when(F.col("idcg") > 0, F.try_divide("dcg", "idcg")).otherwise(0.0)
    return grouped.withColumn("ndcg", ndcg)


def summarize(scores: DataFrame, slice_column: str) -> DataFrame:
    """Means over all queries (slice null) and over each slice; F19: small slices are flagged."""
    means = [F.round(F.avg(c), 9).alias(c) for c in (*(f"recall_{k}" for k in RECALL_AT), "rr", "ndcg")]
    out = scores.groupingSets([[], [F.col(slice_column)]], slice_column).agg(F.count("*").alias("n"), *means)
    return out.withColumn("small", F.col("n") < SMALL_SLICE)


def confusion(df: DataFrame, a: str, b: str, classes: int = MAX_GRADE + 1) -> DataFrame:
    """(a, b, n) for every pair of classes, 0 where there is none."""
    grades = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("g"))
    cells = grades.select(F.col("g").alias("a")).crossJoin(grades.select(F.col("g").alias("b")))  # classes squared
    counts = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b")).agg(F.count("*").alias("n"))
    return cells.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def agreement(df: DataFrame, a: str, b: str, by: list[str], classes: int = MAX_GRADE + 1) -> DataFrame:
    """Quadratic kappa, exact and within-one rates of two graders, by group.

    The expected disagreement follows from the marginal sums alone: the mean
    of (x - y)² over independent x and y is E x² - 2 E x E y + E y². NaN where
    it is 0. Rows with a null grade don't count.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    out = pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((x - y) * (x - y)).alias("_o"), F.avg(x).alias("_x"), F.avg(y).alias("_y"), F.avg(x * x).alias("_xx"), F.avg(y * y).alias("_yy"),
        F.round(F.avg((x == y).cast("double")), 9).alias("exact"), F.round(F.avg((F.abs(x - y) <= 1).cast("double")), 9).alias("within_one"),
    )
    expected = F.col("_xx") - 2 * F.col("_x") * F.col("_y") + F.col("_yy")
    kappa = F.when(expected > 1e-12, F.round(1 - F.try_divide(F.col("_o"), expected), 9)).otherwise(F.lit(_NAN))
    return out.select(*by, "n", kappa.alias("kappa"), "exact", "within_one")


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Pearson's r over average ranks, by group; NaN where a side is constant.

    Ranks come from counts of values: with few distinct grades no window has
    to hold all rows of a group.
    """
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_n"))

    def ranks(value: str, rank: str) -> DataFrame:
        sums = pairs.groupBy(*by, value).agg(F.sum("_n").alias("_m"))
        w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        return sums.select(*by, value, (F.sum("_m").over(w) - (F.col("_m") - 1) / F.lit(2.0)).alias(rank))

    joined = pairs.join(ranks("_a", "_ra"), [*by, "_a"]).join(ranks("_b", "_rb"), [*by, "_b"])
    n, w = F.sum("_n"), F.col("_n").cast("double")
    out = joined.groupBy(*by).agg(
        n.alias("n"), F.sum(w * F.col("_ra")).alias("_sa"), F.sum(w * F.col("_rb")).alias("_sb"), F.sum(w * F.col("_ra") * F.col("_rb")).alias("_sab"),
        F.sum(w * F.col("_ra") * F.col("_ra")).alias("_saa"), F.sum(w * F.col("_rb") * F.col("_rb")).alias("_sbb"),
    )
    va, vb = (F.col("_saa") - F.col("_sa") * F.col("_sa") / F.col("n")), (F.col("_sbb") - F.col("_sb") * F.col("_sb") / F.col("n"))
    cov = F.col("_sab") - F.col("_sa") * F.col("_sb") / F.col("n")
    rho = F.when((va > 1e-9) & (vb > 1e-9), F.round(F.try_divide(cov, F.sqrt(F.abs(va * vb))), 9)).otherwise(F.lit(_NAN))
    return out.select(*by, "n", rho.alias("spearman"))


def grade_distribution(df: DataFrame, grade: str, batch: str) -> DataFrame:
    """How often each grade was given and their mean, by batch and, if there are several, pooled (batch null)."""
    counts = [F.count_if(F.col(grade) == g).alias(f"n_{g}") for g in range(MAX_GRADE + 1)]
    out = df.filter(F.col(grade).isNotNull()).rollup(batch).agg(*counts, F.count("*").alias("n"), F.round(F.avg(grade), 9).alias("mean_grade"), F.grouping(batch).alias("_all"), F.countDistinct(batch).alias("_batches"))
    return out.filter((F.col("_all") == 0) | (F.col("_batches") > 1)).drop("_all", "_batches")


def disagreements(df: DataFrame, a: str, b: str, gap: int = 2) -> DataFrame:
    """pairs at least ``gap`` grades apart, the widest first."""
    return df.withColumn("gap", F.abs(F.col(a) - F.col(b))).filter(F.col("gap") >= gap).orderBy(F.desc("gap"))


def kappa_change(df: DataFrame, judge: str, first: str, second: str, by: list[str]) -> DataFrame:
    """How a grader's kappa differs between a human's first and second round."""
    both = df.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    one = agreement(both, judge, first, by).select(*by, F.col("kappa").alias("first_kappa"))
    two = agreement(both, judge, second, by).select(*by, F.col("kappa").alias("second_kappa"))
    return one.join(two, by).withColumn("change", F.col("second_kappa") - F.col("first_kappa"))


def report(results: DataFrame, grades: DataFrame) -> DataFrame:
    """Each query's graded results in order; a missing grade is an error."""
    joined = results.join(grades, ["query_id", "passage_id"], "left")
    checked = joined.withColumn("grade", F.coalesce("grade", F.raise_error(F.concat(F.lit("no grade for "), F.concat_ws("|", "query_id", "passage_id"))).cast("int")))
    return checked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "passage_id", "grade"))).alias("results"))
