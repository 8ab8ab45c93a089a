"""Sessions of keys over a list, replayed: answers, undo, quitting and resuming.

Someone works through a list and presses a key for each item: an answer moves
on, "u" takes the session's last answer back, "q" ends the session; other keys
do nothing, and neither does "u" where the session has nothing to take back. A
later session goes on with the first open item. So the answers are a stack, and
its height after each key says which item an answer is for. That height is the
running sum of steps less its running minimum below zero, and an answer lasts if
the height never falls below its own later. Both are scans whose parts combine,
so no session and no list has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sampling import shuffle_key
from tessera.operators.scoring import running_count
from tessera.storage import persist

KEEP_OR_DROP = ("k", "d")
GRADES = ("0", "1", "2", "3")
UNDO, QUIT = "u", "q"


def _same(names: list[str], prefix: str = "_") -> Column:
    out = F.lit(True)
    for n in names:
        out &= F.col(n).eqNullSafe(F.col(f"{prefix}{n}"))
    return out


def _renamed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumnsRenamed({n: f"_{n}" for n in names})


def _steps(log: DataFrame, by: list[str], answers: tuple[str, ...]) -> DataFrame:
    """(by, session, seq, key, step) of the keys that count: one a (by, session, seq), none from a session's first quit on."""
    key = F.lower("key")
    known = log.filter("session is not null and seq is not null").select(*by, "session", "seq", key.alias("key")).filter(F.col("key").isin(*answers, UNDO, QUIT))
    once = known.groupBy(*by, "session", "seq").agg(F.min("key").alias("key"))
    quits = _renamed(once.filter(F.col("key") == QUIT).groupBy(*by, "session").agg(F.min("seq").alias("_end")), [*by, "session"])
    left = once.join(quits, _same([*by, "session"]), "left").filter((F.col("key") != QUIT) & (F.col("_end").isNull() | (F.col("seq") < F.col("_end"))))
    return left.select(*by, "session", "seq", "key", F.when(F.col("key") == UNDO, -1).otherwise(1).cast("long").alias("step"))


def heights(steps: DataFrame, by: list[str], order: str) -> DataFrame:
    """``steps`` with ``height`` of the stack after each, never below 0, and ``_part``, the range a row lies in.

    Rows are dealt by ranges of (by, order). A range gives two numbers for each
    ``by`` it has, its sum and its least running sum; those before a range
    shift its own.
    """
    ranged = persist(steps.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()), "steps")
    running = Window.partitionBy("_part", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumn("_sum", F.sum("step").over(running)).withColumn("_low", F.min("_sum").over(running))
    parts = own.groupBy(*by, "_part").agg(F.sum("step").alias("_total"), F.min("_sum").alias("_least"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    parts = parts.withColumn("_floor", F.min(F.col("_before") + F.col("_least")).over(earlier)).drop("_total", "_least")
    placed = own.join(_renamed(parts, [*by, "_part"]), _same([*by, "_part"]))
    total = F.col("_before") + F.col("_sum")
    low = F.least(F.lit(0), F.col("_before") + F.col("_low"), F.col("_floor"))  # least skips nulls
    return placed.select(*steps.columns, "_part", (total - low).alias("height"))


def lasting(placed: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of rows with ``height`` and ``_part`` the answers that no later row of their ``by`` takes back."""
    backwards = Window.partitionBy("_part", *by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn("_later", F.min("height").over(backwards))
    parts = placed.groupBy(*by, "_part").agg(F.min("height").alias("_least"))
    parts = parts.withColumn("_beyond", F.min("_least").over(Window.partitionBy(*by).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1))).drop("_least")
    least = F.least("_later", "_beyond", "height")
    kept = own.join(_renamed(parts, [*by, "_part"]), _same([*by, "_part"])).filter((F.col("step") > 0) & (least >= F.col("height")))
    return kept.select(*placed.columns)


def replay(log: DataFrame, items: DataFrame, by: list[str], order: list[Column | str], answers: tuple[str, ...] = KEEP_OR_DROP, decided: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """The items that have an answer in the end, with ``session``, ``seq`` and ``key`` of it.

    ``log`` has ``by`` (whose list it is), session, seq and key; ``items`` are
    worked through in ``order``, without those that ``decided`` has by ``on``.
    Sessions follow one another by their number. Once nothing is open, later
    keys do nothing, not even "u".

    A key without a session, seq or text is none; of several with one (by,
    session, seq) the least counts. Null in ``by`` is a list of its own. Ties in
    ``order`` are for the caller to avoid. An empty log or list gives no rows.
    """
    open_ = items.join(decided.select(*on).distinct(), on, "left_anti") if decided is not None else items
    names = open_.columns
    listed = persist(running_count(open_, by, order), "open-items")
    sessions = [*by, "session"]
    placed = persist(heights(_steps(log, by, answers), sessions, "seq"), "heights")

    ends = placed.groupBy(*sessions).agg(F.max_by("height", "seq").alias("_final"))
    earlier = Window.partitionBy(*by).orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.withColumn("_base", F.coalesce(F.sum("_final").over(earlier), F.lit(0))).drop("_final")
    placed = placed.join(_renamed(base, sessions), _same(sessions)).select(*placed.columns, F.col("_base"))

    size = _renamed(listed.groupBy(*by).agg(F.count("*").alias("_size")), by)
    sized = placed.join(size, _same(by)).select(*placed.columns, "_size")
    full = F.col("_base") + F.col("height") >= F.col("_size")
    at = F.struct("session", "seq")
    stop = _renamed(sized.filter(full).groupBy(*by).agg(F.min(at).alias("_stop")), by)
    before_stop = sized.join(stop, _same(by), "left").filter(F.col("_stop").isNull() | (at <= F.col("_stop"))).select(*placed.columns)

    answered = lasting(before_stop, sessions, "seq").withColumn("_place", F.col("_base") + F.col("height"))
    answered = _renamed(answered.select(*by, "_place", "session", "seq", "key"), by)
    return listed.join(answered, _same(by) & (F.col("place") == F.col("_place"))).select(*names, "session", "seq", "key")


def first_round(pairs: DataFrame, log: DataFrame, by: str, order: list[Column | str]) -> DataFrame:
    """``pairs`` with ``grade`` from a session log, null where none lasts; ``by`` is the batch and (by, order) a pair."""
    return _graded(pairs, replay(log, pairs, [by], order, GRADES), "grade", [by, *(c for c in order if isinstance(c, str))])


def second_round(graded: DataFrame, log: DataFrame, by: str, identity: str, seed: int = 0, order: Column | None = None) -> DataFrame:
    """The blind second round: ``graded`` with ``regrade``, for batches whose pairs all have a first grade.

    Pairs come in an order made from a seed and their identity alone, so it
    shows nothing of the first one. Keys for other batches do nothing.
    """
    whole = _renamed(graded.groupBy(by).agg(F.min(F.col("grade").isNotNull()).alias("_whole")).filter("_whole").drop("_whole"), [by])
    ready = graded.join(whole, _same([by]), "left_semi")
    again = replay(log, ready.select(by, identity), [by], [order if order is not None else shuffle_key(seed, identity), F.col(identity)], GRADES)
    return _graded(graded, again, "regrade", [by, identity])


def _graded(pairs: DataFrame, answers: DataFrame, name: str, on: list[str]) -> DataFrame:
    given = _renamed(answers.select(*on, F.col("key").cast("int").alias(name)), on)
    return pairs.join(given, _same(on), "left").select(*pairs.columns, name)
