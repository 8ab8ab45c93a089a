"""Mixing sources to target weights by pivotal dependent rounding.

A source with target T and size S (in words) wants every document T/S times:
the fraction is a probability of one more copy. Documents with fractional
copies are paired and a mass of words moves from one to the other, in a
direction drawn so that neither expectation changes, until one has a whole
number of copies. Mass is counted in words, so a source's expected total is
kept exactly by every pair.

The largest open document is settled first. It is paired with all smaller ones
at once: one draw gives the direction of all those moves, and each of the
smaller takes a share in proportion to its room. So a large document's words
are carried into smaller ones, never the other way, and the last open document
of a source, which is rounded on its own, is a small one. A document too large
for the smaller ones to make up for goes the way they can make up for, so that
the source stays near its target; that holds for the last few of a leaf too,
so their chances are near their fractions and those of all others equal to them.

Pairing runs in leaves, groups of documents that are fixed by the rows alone,
and each leaf leaves at most one open document. Those meet in a reduction
tree with a constant fan-in until one is left for each source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import content_hash, repeated, row_of
from tessera.storage import discard, persist

WEIGHTS = (5.0, 2.0, 1.0)
#: No source is repeated more often than this.
MAX_REPEATS = 3
#: Documents of a leaf on average, and open documents of a node of the tree.
LEAF_DOCS, FAN_IN = 2048, 64
#: Rows that one row is repeated into at once.
REPEAT_ROWS = 100_000
WORDS = r"[^\x20\x09-\x0D]+"
_ROOM = 1e-9

_DECIDED = "row_key string, source string, words long, copies double, most long, slot long"


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, repeats: float = MAX_REPEATS) -> dict[str | None, float]:
    """Words each source should give; together as many as there are.

    Sources in order of code point, null last, get the weights in turn. A
    share above ``repeats`` times its source is cut there and the rest dealt
    out by weight again, until none is above. ``with_targets`` does the same
    to a table.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    cap = {s: float(repeats * sizes[s]) for s in order}
    out: dict[str | None, float] = {}
    open_, left = list(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        above = [s for s in open_ if share[s] > cap[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = cap[s]
            left -= cap[s]
        open_ = [s for s in open_ if s not in out]
    return out


def with_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: float = MAX_REPEATS) -> DataFrame:
    """``sources`` (source, size, distinct) with target, however many sources there are.

    A source's place in the order, which gives its weight, is the number of
    rows in the sorted partitions before plus its place in its own. A target
    is the lesser of the source's cap and its weight times a level; each round
    raises the level by what the sources capped so far leave, and the rounds
    end when no further source is capped. What reaches the driver is one row a
    partition and one a round.
    """
    spark = sources.sparkSession
    marked = sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_id", F.monotonically_increasing_id())
    marked = persist(marked.withColumn("_part", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))), "mix-sources")
    before, bases = 0, [(-1, 0)]
    for r in sorted(marked.groupBy("_part").count().collect()):
        bases.append((r["_part"], before % len(weights)))
        before += r["count"]
    # One row a partition.
    base = F.broadcast(spark.createDataFrame(bases, "_part long, _base long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_base") + F.col("_place"), F.lit(len(weights))) + 1).cast("int"))
    weighed = persist(marked.join(base, "_part").select(*sources.columns, weight.alias("_weight"), (repeats * F.col("size")).cast("double").alias("_cap")), "mix-weights")
    discard(marked)
    total = float(weighed.agg(F.sum("size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        above = F.col("_weight") * level > F.col("_cap")
        open_ = F.when(~above, F.col("_weight"))
        r = weighed.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col("_cap"))).alias("caps"), F.sum(open_).alias("open")).first()
        if r["n"] == capped or not r["open"]:
            break
        level, capped = (total - (r["caps"] or 0.0)) / r["open"], r["n"]
    return weighed.select(*sources.columns, F.least("_cap", F.col("_weight") * level).alias("target"))


def _draw(seed: int, *what: object) -> float:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, what)).encode(), seed) / 2**64


def pair_off(rows: list[tuple[str, float, int]], seed: int, most: np.ndarray | None = None) -> np.ndarray:
    """Expected copies of ``(key, copies, words)``, largest first, after pairing; one at most stays open.

    With u the words that would complete a copy and d those of the part there
    is, a smaller document with c copies, w words and room for m copies takes
    a share of at most min(c w / u, (m - c) w / d) of the move: then it stays
    within 0 and m whichever way is drawn, and no expectation changes. Where
    the smaller ones can make up for one way only, that one is taken; where
    for neither, they give what they have and the document waits for a pair.
    """
    copies = np.array([x[1] for x in rows], dtype=np.float64)
    words = np.array([x[2] for x in rows], dtype=np.float64)
    most = np.ones(len(rows)) if most is None else most
    copies[words <= 0] = np.round(copies[words <= 0])
    copies = _snap(copies)
    stuck = -1
    for i, (key, _, _) in enumerate(rows):
        if copies[i] == np.floor(copies[i]):
            continue
        if stuck >= 0:
            _swap(copies, words, stuck, i, _draw(seed, rows[stuck][0], key, stuck, i))
            if copies[i] == np.floor(copies[i]):
                continue
            stuck = -1
        if not _move(copies, words, most, i, _draw(seed, key, i)):
            stuck = i
    return copies


def _snap(copies: np.ndarray) -> np.ndarray:
    """Whole numbers where only rounding errors are missing."""
    near = np.round(copies)
    return np.where(np.abs(copies - near) < _ROOM, near, copies)


def _swap(copies: np.ndarray, words: np.ndarray, i: int, j: int, draw: float) -> None:
    """Pair two documents: words move until one of the two is settled, whichever has less room."""
    part = copies[[i, j]] - np.floor(copies[[i, j]])
    up = min((1 - part[0]) * words[i], part[1] * words[j])
    down = min(part[0] * words[i], (1 - part[1]) * words[j])
    by = up if draw * (up + down) < down else -down
    copies[[i, j]] = _snap(copies[[i, j]] + np.array([by, -by]) / words[[i, j]])


def _move(copies: np.ndarray, words: np.ndarray, most: np.ndarray, i: int, draw: float) -> bool:
    """Pair document i with all after it; whether that settles it."""
    part = copies[i] - np.floor(copies[i])
    up, down = (1 - part) * words[i], part * words[i]
    mass, c, w = words[i], copies[i + 1 :], words[i + 1 :]
    has, room = c * w, (most[i + 1 :] - c) * w
    share = np.minimum(has / up, room / down)
    rises, falls = has.sum() >= up, room.sum() >= down
    if (total := share.sum()) >= 1:
        rise, share = draw < part, share / total
    elif rises or falls:
        rise = draw < part if rises and falls else rises
        share = has / has.sum() if rise else room / room.sum()
    else:
        rise = draw < part
    by = np.where(share > 0, share * (up if rise else -down) / np.maximum(w, 1), 0.0)
    copies[i] = _snap(copies[i] + (share.sum() * (up if rise else -down)) / mass)
    copies[i + 1 :] = _snap(np.clip(c - by, 0, most[i + 1 :]))
    return bool(copies[i] == np.floor(copies[i]))


def _node(seed: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["words", "row_key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        copies = pair_off(list(zip(pdf["row_key"], pdf["copies"], pdf["words"], strict=True)), seed, pdf["most"].to_numpy(np.float64))
        if last:
            whole = np.floor(copies)
            copies = whole + np.array([_draw(seed, "last", k) < x for k, x in zip(pdf["row_key"], copies - whole, strict=True)], dtype=np.float64)
        pdf["copies"] = copies
        return pdf

    return run


def row_key() -> Column:
    """A name for a row by its content: rows alike in id, source and text share it."""
    parts = [F.hex(F.xxhash64(F.col(c).isNull(), F.col(c).cast("string"))) for c in ("source", "text")]
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), *parts)


def measure(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, source, size): the words of every row, 0 for a null text."""
    return docs.select(
        row_key().alias("row_key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
    )


def mix_groups(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = MAX_REPEATS, seed: int = 9) -> tuple[DataFrame, int]:
    """How often the mix takes each group of rows alike in id, source and text.

    Returns row_key, doc_id, source, size, rows (how many are alike), copies
    (of all of them together), source_size and target. Rows alike are counted
    before anything else, so a row that is repeated often is one group.
    """
    sized = measure(docs).groupBy("row_key", "doc_id", "source", "size").agg(F.count("*").alias("rows"))
    sized = persist(sized, "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("size"), F.count("*").alias("groups"))
    plan = persist(with_targets(sources, weights, repeats), "mix-targets")
    plan = plan.select(F.col("source").alias("plan_source"), F.col("size").alias("source_size"), "target", F.ceil(F.col("groups") / LEAF_DOCS).alias("leaves"))
    same = F.col("source").eqNullSafe(F.col("plan_source"))
    want = F.when(F.col("size") > 0, F.col("rows") * F.col("target") / F.col("source_size")).otherwise(0.0)
    most = F.when(F.col("size") > 0, repeats * F.col("rows")).otherwise(0)
    open_ = sized.join(plan, same).select(
        "row_key", "source", F.col("size").alias("words"), want.alias("copies"), most.cast("long").alias("most"), F.pmod(F.xxhash64("row_key"), F.col("leaves")).alias("slot")
    )
    slots, done = plan.agg(F.max("leaves")).first()[0] or 1, []
    level = persist(open_.groupBy("source", "slot").applyInPandas(_node(seed, slots == 1), _DECIDED), "mix-leaves")
    while True:
        closed = F.col("copies") == F.floor("copies")
        done.append(level.filter(closed))
        if slots == 1:
            break
        slots = -(-slots // FAN_IN)
        up = level.filter(~closed).withColumn("slot", F.floor(F.col("slot") / FAN_IN).cast("long"))
        level = persist(up.groupBy("source", "slot").applyInPandas(_node(seed + slots, slots == 1), _DECIDED), "mix-node")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = out.select("row_key", F.col("copies").cast("long").alias("copies"))
    out = sized.join(copies, "row_key").join(plan, same).select("row_key", "doc_id", "source", "size", "rows", "copies", "source_size", "target")
    return out, sized.agg(F.max("rows")).first()[0] or 0


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = MAX_REPEATS, seed: int = 9) -> DataFrame:
    """How often the mix takes each row of ``docs`` (doc_id, source, text).

    Returns row_key, doc_id, source, size, copies, taken (copies times size),
    source_size and target, one row for each row of ``docs``. Nulls in source
    form a source of their own; null and empty texts have size 0 and are taken
    0 times, as are sources without a word. Rows alike are rounded together
    and their copies dealt out evenly. An empty table gives an empty result.
    Very long texts are only counted. The outcome depends on the rows and
    ``seed`` alone, not on partitions. Other columns are left out.
    """
    groups, most = mix_groups(docs, weights, repeats, seed)
    rows = repeated(groups, "rows", "_row", most, REPEAT_ROWS)
    copies = F.floor(F.col("copies") / F.col("rows")) + (F.col("_row") <= F.pmod("copies", "rows")).cast("long")
    return rows.withColumn("copies", copies).select("row_key", "doc_id", "source", "size", "copies", (F.col("copies") * F.col("size")).alias("taken"), "source_size", "target")


def apply_mix(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, columns unchanged.

    Rows of one key are told apart by a hash of all their columns, and equal
    ones are counted, so which of them are repeated once more doesn't depend
    on their order. Nulls, empty texts and tables, ties and repeated rows are
    as in ``mix``; extra columns, whatever their names and types, come along.
    """
    names = docs.columns
    groups, most = mix_groups(docs, **options)
    groups = groups.filter("copies > 0").select("row_key", "rows", "copies")
    joined = docs.select(row_of(docs), row_key().alias("row_key"), content_hash(docs, names).alias("_hash")).join(persist(groups, "mix-groups"), "row_key")
    single = joined.filter("rows = 1").select("row_key", "_row", F.col("copies").alias("_times"))
    alike = joined.filter("rows > 1").groupBy("row_key", "_hash", "rows", "copies").agg(F.count("*").alias("_n"), F.first("_row").alias("_row"))
    upto = F.sum("_n").over(Window.partitionBy("row_key").orderBy("_hash"))
    more = F.greatest(F.least(F.pmod("copies", "rows") - (upto - F.col("_n")), F.col("_n")), F.lit(0))
    shared = alike.withColumn("_times", F.col("_n") * F.floor(F.col("copies") / F.col("rows")) + more).filter("_times > 0").select("row_key", "_row", "_times")
    return repeated(single.unionByName(shared), "_times", "_i", most * options.get("repeats", MAX_REPEATS), REPEAT_ROWS).select("_row.*")
