"""Importance resampling towards a target distribution, on hashed word n-grams.

A position table holds one row for each place of a word in a text. Window
functions over a text's places put the following words beside each, so a row
has the n-grams of every order that begin there, as buckets of a hash. A
bucket's gain is the logarithm of its share of the target's n-grams over its
share of all; a text's weight is the mean gain of its n-grams. Weights with
Gumbel noise are ranked: the best of them are a draw without replacement in
proportion to the exponents of the weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import column, repeated
from tessera.storage import discard, persist, release

#: What stands between words, after A-Z are lower-cased: every ASCII character but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDERS, BUCKETS, SCALE, SEED, LEAST_WORDS, PERCENT = 2, 10_000, 1000, 7, 20, 25


def words(text: Column) -> Column:
    """The words of a text as an array; none for a null text."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def positions(texts: DataFrame, key: list[str], carry: tuple[str, ...] = (), orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """The position table of ``texts`` (key columns, text): key, carry and b1, b2, ..., the buckets of the n-grams that begin there.

    A bucket is null where the text ends before the n-gram does; a text
    without a word has one row of nulls. ``key`` must be unique, as the words
    of equal keys would be mixed. Where ``texts`` are already dealt by their
    key, only a sort within each partition is left to do.
    """
    placed = texts.select(*key, *carry, F.posexplode_outer(words(F.col("text"))).alias("_at", "_word"))
    of_text = Window.partitionBy(*key).orderBy("_at")
    ahead = placed.withColumns({f"_next{n}": F.lead("_word", n).over(of_text) for n in range(1, orders)})
    gram, found = F.col("_word"), []
    for n in range(orders):
        gram = F.concat(gram, F.lit(" "), F.col(f"_next{n}")) if n else gram
        found.append(F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets)).cast("int").alias(f"b{n + 1}"))
    return ahead.select(*key, *carry, *found)


def counts(table: DataFrame, times: Column | None = None, orders: int = ORDERS) -> DataFrame:
    """(bucket, n): how often each bucket stands in a position table, each row ``times`` over."""
    each = table.select((F.lit(1) if times is None else times).cast("long").alias("_times"), F.explode(F.array(*(f"b{n + 1}" for n in range(orders)))).alias("bucket"))
    return each.filter("bucket is not null").groupBy("bucket").agg(F.sum("_times").alias("n"))


def gains(tally: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket, from (bucket, s, t): how often it stands in all texts and in the target's.

    Both are smoothed by one a bucket, so an empty table on either side counts
    as evenly spread. The result has ``buckets`` rows, no more.
    """
    sums = tally.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    every = tally.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    s, t = (F.coalesce(F.col(name), F.lit(0)).cast("double") for name in "st")
    ratio = (t + 1) * F.lit(float((sums["S"] or 0) + buckets)) / ((s + 1) * F.lit(float((sums["T"] or 0) + buckets)))
    return every.join(tally, "bucket", "left").select("bucket", F.floor(F.lit(float(SCALE)) * F.ln(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise times 1000, rounded down, from the id alone; a null id counts as an empty one."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(float(-SCALE)) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


_KEY = ["doc_id", "_h", "_g"]


def weigh(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, _h, _g, rows, n_words, n_features, weight) for each distinct (doc_id, text) of ``docs``.

    ``_h`` and ``_g`` are 128 bits of hash of the text; a null text is an
    empty one. Rows alike are counted in ``rows`` before the texts are dealt
    out, so a row repeated very often is split into words once. ``target``
    needs a column text. The position table is written once and read twice;
    texts are shuffled, their words are not.
    """
    named = docs.select(column("doc_id").alias("doc_id"), F.coalesce(column("text").cast("string"), F.lit("")).alias("text"))
    hashed = named.withColumns({"_h": F.xxhash64("text"), "_g": F.xxhash64(F.lit(SEED), "text")})
    distinct = hashed.groupBy(*_KEY).agg(F.first("text").alias("text"), F.count("*").alias("rows"))
    table = persist(positions(distinct, _KEY, ("rows",), orders, buckets), "positions")
    release(docs.sparkSession)
    aims = target.select(F.monotonically_increasing_id().alias("_key"), column("text").alias("text"))
    own, theirs = counts(table, F.col("rows"), orders), counts(positions(aims, ["_key"], (), orders, buckets), None, orders)
    both = own.withColumnsRenamed({"n": "s"}).withColumn("t", F.lit(0).cast("long")).unionByName(theirs.withColumnsRenamed({"n": "t"}).withColumn("s", F.lit(0).cast("long")))
    tally = persist(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "tally")
    gain = gains(tally, buckets)
    met = table
    for n in range(1, orders + 1):
        met = met.join(F.broadcast(gain.select(F.col("bucket").alias(f"b{n}"), F.col("gain").alias(f"_g{n}"))), f"b{n}", "left")
    here = [F.col(f"_g{n}") for n in range(1, orders + 1)]
    found = sum((F.when(g.isNotNull(), 1).otherwise(0) for g in here), F.lit(0).cast("long"))
    total = sum((F.coalesce(g, F.lit(0)) for g in here), F.lit(0).cast("long"))
    sums = met.groupBy(*_KEY, "rows").agg(F.count("b1").alias("n_words"), F.sum(found).alias("n_features"), F.sum(total).alias("_sum"))
    # Rounded down in integers: the remainder goes first.
    floor = F.expr("(_sum - pmod(_sum, n_features)) div n_features")
    out = persist(sums.withColumn("weight", F.when(F.col("n_features") > 0, floor).otherwise(F.lit(0).cast("long"))).drop("_sum"), "weights")
    discard(table)
    discard(tally)
    return out


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs``; the drawn ones have a rank.

    Of the N rows with ``least_words`` or more, those with the floor(percent *
    N / 100) best scores are drawn; ties go to the lesser doc_id, null last,
    then to a hash of the text. Null and empty texts have no n-grams, weight 0,
    and are never drawn. Rows alike in id and text take consecutive ranks.
    Extra columns are not read. An empty table gives an empty result; with an
    empty target all gains come from the documents alone.

    Rows are ranked in ranges of (score, doc_id), a rank being the place in
    the range plus the rows of the ranges before: one number a partition.
    """
    scored = weigh(docs, target, orders, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    enough = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_h"), F.asc("_g")]
    ranged = persist(scored.filter(enough).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "score-ranges")
    sizes = dict(ranged.groupBy("_part").agg(F.sum("rows").alias("n")).collect())
    drawn, before, begins = percent * sum(sizes.values()) // 100, 0, []
    for part in sorted(sizes):
        begins.append((part, before))
        before += sizes[part]
    base = docs.sparkSession.createDataFrame(begins, "_part int, _before long")
    own = F.sum("rows").over(Window.partitionBy("_part").orderBy(*order)) - F.col("rows")
    ranked = ranged.withColumn("_own", own).join(F.broadcast(base), "_part").withColumn("_begin", F.col("_own") + F.col("_before"))
    rest = scored.filter(~enough).withColumn("_begin", F.lit(drawn).cast("long"))
    both = ranked.select(*scored.columns, "_begin").unionByName(rest)
    most = both.agg(F.max("rows")).first()[0] or 0
    rank = F.col("_begin") + F.col("_copy")
    out = repeated(both, "rows", "_copy", most).select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
    return out
