"""Scores of songs over many charts, and the best of each group.

Records carry ``seq``, their order of arrival: "first" always means the least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.storage import persist


def lookup(value: Column, table: dict[str, float], default: float) -> Column:
    """A fixed table as an expression."""
    items = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*items), value), F.lit(default))


def first_of(value: str | Column, seq: str = "seq") -> Column:
    """The value of the first row that has one."""
    c = F.col(value) if isinstance(value, str) else value
    return F.min_by(c, F.when(c.isNotNull(), F.col(seq)))


def _union(scored: DataFrame, by: list[str], firsts: dict[str, str | Column], *more: tuple[Column, Column]) -> DataFrame:
    """Records of each ``by`` as one: scores summed, first values, sources in order of first arrival.

    Records are first summed up for each source, so however many a song has,
    only one row a source is gathered. ``firsts`` are taken from the first
    record that has a value; ``more`` are pairs of aggregates for either step.
    """
    first = lambda c: F.min(F.when(c.isNotNull(), F.struct(F.col("seq").alias("s"), c.alias("v"))))
    columns = {name: F.col(c) if isinstance(c, str) else c for name, c in firsts.items()}
    each = scored.groupBy(*by, "source").agg(
        F.sum("score").alias("_score"), F.min("seq").alias("_seq"), *(first(c).alias(f"_{name}") for name, c in columns.items()), *(one for one, _ in more)
    )
    order = F.array_sort(F.collect_list(F.struct(F.col("_seq").alias("s"), F.col("source").alias("v"))))
    return each.groupBy(*by).agg(
        F.sum("_score").alias("combined_score"),
        *(F.min(f"_{name}")["v"].alias(name) for name in columns),
        F.concat_ws(", ", F.transform(order, lambda p: p["v"])).alias("source"),
        F.min("_seq").alias("seq"),
        *(other for _, other in more),
    )


def running_count(df: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """``df`` with ``place``: 1, 2, ... within each ``by`` in order.

    Rows are dealt by ranges of (by, order), so a group of any size lies in
    many partitions; a row's place is its place in its partition plus the
    group's rows in the partitions before, one number a partition.
    """
    ranged = persist(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_part").alias("_of"), before.alias("_before"))
    same = F.col("_part") == F.col("_of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    own = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    return ranged.withColumn("_own", own).join(base, same).withColumn("place", F.col("_own") + F.col("_before")).select(*df.columns, "place")


def merge_canonical(df: DataFrame, preferred: str, order: tuple[str, ...], key: str = "key") -> DataFrame:
    """A1: one row a key: names as the preferred source has them, the longest list of featured
    artists, the first year, the sources in a fixed order and the best rank."""
    names = F.struct("artist", "title")
    longest = F.max_by("featured_artists", F.when(F.col("featured_artists").isNotNull(), F.struct(F.length("featured_artists"), -F.col("seq"))))
    present = F.collect_set("source")
    return df.groupBy(key).agg(
        F.min_by(names, F.struct((F.col("source") != preferred).alias("other"), "seq")).alias("n"),
        longest.alias("featured_artists"),
        first_of("year").alias("year"),
        F.concat_ws(", ", F.filter(F.array(*(F.lit(s) for s in order)), lambda s: F.array_contains(present, s))).alias("source"),
        F.min("source_rank").alias("source_rank"),
    ).select(key, "n.artist", "n.title", "featured_artists", "year", "source", "source_rank")


def decade_points(df: DataFrame, key: str = "key") -> DataFrame:
    """A2: the points of each song in each decade, its names from its best rank."""
    best = F.min_by(F.struct("artist", "featured_artists", "title", "year"), F.struct("rank", "seq"))
    grouped = df.withColumn("decade", text.decade(F.col("year"))).groupBy("decade", key)
    return grouped.agg(F.sum(text.chart_points(F.col("rank"))).alias("decade_score"), best.alias("b")).select("decade", key, "decade_score", "b.*")


def top_per_group(df: DataFrame, group: str, order: list[Column], targets: dict[str, int]) -> DataFrame:
    """The first rows of each group, as many as its target; groups without one give none.

    The constant limit first lets Spark cut each group before the shuffle.
    """
    w = Window.partitionBy(group).orderBy(*order)
    ranked = df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max(targets.values(), default=0))
    return ranked.filter(F.col("rn") <= lookup(F.col(group), {k: float(v) for k, v in targets.items()}, 0.0))


def top_n_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """K4, K5: the first n rows of each group."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rn") <= n)


def year_union(df: DataFrame, weights: dict[str, float], default: float, n: int, group: str = "year", key: str = "key") -> DataFrame:
    """A3, K4: weighted rank scores summed over sources; the best n songs of each year.

    A record's score is relative to the number of records its source has in
    the year. A source may add up twice but is listed once.
    """
    sizes = df.groupBy(F.col("source").alias("_of"), F.col(group).alias("_in")).agg(F.count("*").alias("_size"))
    sized = df.join(sizes, F.col("source").eqNullSafe(F.col("_of")) & F.col(group).eqNullSafe(F.col("_in")))
    scored = sized.withColumn("score", text.rank_score(F.col("rank"), F.col("_size")) * lookup(F.col("source"), weights, default))
    merged = _union(scored, [group, key], {c: c for c in ("artist", "title", "featured_artists")})
    return top_n_per_group(merged, group, [F.desc(F.round("combined_score", 9)), F.col("seq")], n)


def genre_union(df: DataFrame, weights: dict[str, float], default: float, key: str = "key") -> DataFrame:
    """As ``year_union`` without years; records without a rank score by their place.

    That place counts the unranked records of a source and genre in order of
    arrival. Genre and year are the first ones.
    """
    valid = df.filter(F.col(key) != "|||")
    ranked = valid.filter("rank is not null").withColumn("score", text.rank_score(F.col("rank"), F.col("list_length")))
    placed = running_count(valid.filter("rank is null"), ["source", "genre"], ["seq"])
    placed = placed.withColumn("score", text.implicit_score(F.col("place"))).drop("place")
    scored = ranked.unionByName(placed).withColumn("score", F.col("score") * lookup(F.col("source"), weights, default))
    return _union(scored, [key], {c: c for c in ("artist", "title", "featured_artists", "genre", "year")}).drop("seq")


def viral_union(df: DataFrame, weights: dict[str, float], priority: dict[str, int], default: float, key: str = "key") -> DataFrame:
    """A5: as ``genre_union``, the year from the source of the highest priority.

    The first record holds its source's priority even without a year; a later
    one replaces the year only with a year and a strictly higher priority. The
    original year is the first there is, and none where it equals the year.
    """
    p = lookup(F.col("source"), {k: float(v) for k, v in priority.items()}, 0.0)
    scored = df.withColumn("_p", p).withColumn("score", F.coalesce("norm_score", F.lit(0.5)) * lookup(F.col("source"), weights, default))
    held = F.struct(F.col("seq").alias("s"), F.col("_p").alias("p"), F.col("year").alias("y"))
    best = F.when(F.col("year").isNotNull(), F.struct(F.col("_p").alias("p"), (-F.col("seq")).alias("s"), F.col("year").alias("y")))
    merged = _union(
        scored, [key], {c: c for c in ("artist", "title", "featured_artists", "original_year")},
        (F.min(held).alias("_held"), F.min("_held").alias("_held")), (F.max(best).alias("_best"), F.max("_best").alias("_best")),
    )
    merged = merged.withColumn("year", F.when(F.col("_best.p") > F.col("_held.p"), F.col("_best.y")).otherwise(F.col("_held.y")))
    original = F.when(~F.col("original_year").eqNullSafe(F.col("year")), F.col("original_year"))
    return merged.select(key, "combined_score", "artist", "title", "featured_artists", "year", original.alias("original_year"), "source")


def weeks_at_top(df: DataFrame, group: str, key: str = "key", least: int = 5) -> DataFrame:
    """Rank songs by how often they were listed; groups with fewer than ``least`` songs drop out."""
    counted = df.groupBy(group, key).agg(F.count("*").alias("weeks"), F.min("seq").alias("seq"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("weeks"), "seq")))
    enough = counted.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_songs")).filter(F.col("_songs") >= least)
    return ranked.join(enough, F.col(group).eqNullSafe(F.col("_g")), "left_semi").select(group, key, "weeks", "rank")


def average_rank(df: DataFrame, group: str, value: str) -> DataFrame:
    """Ranks by ascending value; ties share the mean of theirs.

    Ranks come from counts of distinct values, so no window holds a group's rows.
    """
    counts = df.groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_g").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranks = counts.select("_g", "_v", (upto - (F.col("_n") - 1) / F.lit(2.0)).alias("avg_rank"))
    return df.join(ranks, F.col(group).eqNullSafe(F.col("_g")) & F.col(value).eqNullSafe(F.col("_v"))).drop("_g", "_v")


def forward_fill(df: DataFrame, group: str, order: list[str], value: Column) -> DataFrame:
    """The last value seen so far in each group."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("filled", F.last(value, ignorenulls=True).over(w))


def carry_spans(df: DataFrame, by: list[str], place: str, value: str, span: str, header: str) -> DataFrame:
    """``df`` with ``carried``: the value of a cell that spans the rows from its own on.

    ``place`` numbers the rows of each ``by``; a cell with a ``value`` counts
    for ``span`` places, its own among them (null: 1), until another value or
    a row where ``header`` is true, which has none itself. After a cell's last
    place nothing is carried: an earlier, longer cell doesn't come back.

    What a stretch of rows hands on is its last cell or header, if it has one,
    else what it was handed: that combines in any grouping, so rows are dealt
    by ranges of (by, place) and a page of any length lies in many tasks.
    """
    is_header = F.coalesce(F.col(header), F.lit(False))
    until = F.when(is_header, F.col(place)).otherwise(F.col(place) + F.coalesce(F.col(span), F.lit(1)))
    cell = F.when(is_header | F.col(value).isNotNull(), F.struct(until.cast("long").alias("until"), F.when(~is_header, F.col(value)).alias("value")))
    ranged = persist(df.repartitionByRange(*by, place).withColumns({"_part": F.spark_partition_id(), "_cell": cell}), "ranges")
    ends = ranged.groupBy(*by, "_part").agg(F.max_by("_cell", F.when(F.col("_cell").isNotNull(), F.col(place))).alias("_end"))
    earlier = F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    handed = ends.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_part").alias("_of"), earlier.alias("_handed")).filter("_handed is not null")
    same = F.col("_part") == F.col("_of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    own = F.last("_cell", ignorenulls=True).over(Window.partitionBy("_part", *by).orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    held = ranged.withColumn("_own", own).join(handed, same, "left").withColumn("_held", F.coalesce("_own", "_handed"))
    return held.select(*df.columns, F.when(F.col(place) < F.col("_held.until"), F.col("_held.value")).alias("carried"))


def rerank(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Ranks 1 to n of what is left."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
