"""Passages of consecutive lines, as one array expression without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.constants import MIN_CHARS, MIN_LAST_LINES, STEP_LINES, WINDOW_LINES


def _filled(line: Column) -> Column:
    return line.rlike(r"[^\s\u0085   -     　\x1c-\x1f]")


def windows(lines: Column) -> Column:
    """array<struct<start,end>>: a window every 6 lines, its end (exclusive) at the first blank
    line from its sixth on, else after 8; a last one with few lines joins the one before."""
    n = F.size(lines)

    def window(start: Column) -> Column:
        default = F.least(start + WINDOW_LINES, n)
        places = F.sequence(start + STEP_LINES - 1, start + WINDOW_LINES - 1)
        blank = F.filter(places, lambda j: (j < n) & ~_filled(F.get(lines, j)))
        return F.struct(start.alias("start"), F.coalesce(F.get(blank, F.lit(0)), default).alias("end"))

    raw = F.transform(F.sequence(F.lit(0), n - 1, F.lit(STEP_LINES)), window)
    size = F.size(raw)
    last, before = F.get(raw, size - 1), F.get(raw, size - 2)
    few = F.size(F.filter(F.slice(lines, last["start"] + 1, F.greatest(last["end"] - last["start"], F.lit(0))), _filled)) < MIN_LAST_LINES
    merged = F.concat(F.slice(raw, F.lit(1), F.greatest(size - 2, F.lit(0))), F.array(F.struct(before["start"].alias("start"), last["end"].alias("end"))))
    return F.when((size >= 2) & few, merged).otherwise(raw)


def chunk_passages(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, passage_text, start_line, end_line) of every text; passages under 50 characters drop out.

    Null texts have no passage. Blank lines are left out of passages.
    """
    lines = F.split(F.regexp_replace(text_column, "\n{3,}", "\n\n"), "\n", -1)
    cut = df.filter(F.col(text_column).isNotNull()).select(F.col(id_column), lines.alias("_lines")).withColumn("_w", F.explode(windows(F.col("_lines"))))
    inside = F.slice("_lines", F.col("_w.start") + 1, F.greatest(F.col("_w.end") - F.col("_w.start"), F.lit(0)))
    passage = F.array_join(F.filter(inside, _filled), "\n")
    out = cut.select(id_column, passage.alias("passage_text"), F.col("_w.start").alias("start_line"), F.col("_w.end").alias("end_line"))
    return out.filter(F.length("passage_text") >= MIN_CHARS)


def chunk_stats(texts: DataFrame, passages: DataFrame, id_column: str) -> DataFrame:
    """A10: texts, passages, passages a text (those without count as 0) and passage lengths."""
    per_text = passages.groupBy(id_column).agg(F.count("*").alias("n"), F.sum(F.length("passage_text")).alias("chars"), F.min(F.length("passage_text")).alias("low"), F.max(F.length("passage_text")).alias("high"))
    joined = texts.select(id_column).join(per_text, id_column, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.agg(
        F.count("*").alias("texts"), F.sum("n").alias("passages"), F.round(F.avg("n"), 4).alias("avg_passages"), F.min("n").alias("min_passages"), F.max("n").alias("max_passages"),
        F.round(F.try_divide(F.sum("chars"), F.sum("n")), 4).alias("avg_chars"), F.min("low").alias("min_chars"), F.max("high").alias("max_chars"),
        F.count_if(F.col("n") == 0).alias("without"),
    )
