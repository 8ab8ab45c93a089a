"""Charts from pages and lists: all-time lists, top tens, genre lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import dedup, scoring


def all_time(rows: DataFrame) -> DataFrame:
    """(rank, title, artist_raw, year) of a table (cells: rank, song, artist, streams, release date).

    Rows with fewer cells, without a rank, a title, an artist or a year of
    this century drop out.
    """
    cell = lambda i: text.clean_cell(F.get("cells", F.lit(i)))
    year = F.regexp_extract(cell(4), r"\b(20\d{2})\b", 1).try_cast("int")
    found = rows.filter(F.size("cells") >= 5).select(cell(0).try_cast("int").alias("rank"), cell(1).alias("title"), cell(2).alias("artist_raw"), year.alias("year"))
    return found.filter("rank is not null and year is not null and title <> '' and artist_raw <> ''")


def of_years(listed: DataFrame, first: int, last: int) -> DataFrame:
    """An all-time list cut by year of release, ranked anew within each year."""
    return scoring.rerank(listed.filter(F.col("year").between(first, last)), "year", [F.col("rank"), F.col("title"), F.col("artist_raw")])


def quoted_title(raw: Column) -> Column:
    """What stands in quotation marks, else the text without its marks and remarks."""
    quoted = F.regexp_extract(raw, "[\"“”](.+?)[\"“”]", 1)
    return text.strip(F.when(quoted != "", quoted).otherwise(F.regexp_replace(raw, r"[‡♦†].*$|\(#\d+\)", "")))


def top_ten(rows: DataFrame, order: list[str]) -> DataFrame:
    """(year, rank, title, artist_raw) of rows of cells with their ``year``: songs by their peak.

    Seven cells are date, weeks, title, artist, peak and two more; six lack
    the first. A peak outside 1 to 10 drops the row, and of a song listed
    twice in a year the first row by ``order`` stays.
    """
    n = F.size("cells")
    cell = lambda i: F.get("cells", F.when(n == 7, F.lit(i)).otherwise(F.lit(i - 1)))
    peak = F.regexp_replace(text.clean_cell(cell(4)), r"\D", "").try_cast("int")
    title = quoted_title(text.strip(F.regexp_replace(cell(2), r"\[.*?\]", "")))
    found = rows.filter(n.isin(6, 7)).select("year", *order, peak.alias("rank"), title.alias("title"), text.clean_cell(cell(3)).alias("artist_raw"))
    found = found.filter(F.col("rank").between(1, 10) & (F.col("title") != "") & (F.col("artist_raw") != ""))
    key = F.concat(text.normalize_key(F.col("artist_raw")), F.lit("|||"), text.normalize_key(F.col("title")))
    return dedup.keep_first(found.withColumn("_key", key), ["year", "_key"], [F.col(c) for c in order]).select("year", "rank", "title", "artist_raw")


def with_genre(records: DataFrame, lists: DataFrame) -> DataFrame:
    """``records`` (url, ...) with the genre and source that a table (url, genre, source) binds their list to.

    Lists are a configuration of some dozens of rows; records of others drop out.
    """
    return records.join(lists.select("url", "genre", "source"), "url")


def with_artist_genre(records: DataFrame, genres: DataFrame) -> DataFrame:
    """``records`` (artist_raw, ...) with their artist's genre; artists of none drop out.

    Names are normalised on both sides. Of names that become equal the last by
    the column ``seq`` counts, if ``genres`` has one, else the least genre.
    """
    last = F.max_by("genre", F.struct("seq", "genre")) if "seq" in genres.columns else F.min("genre")
    known = genres.groupBy(text.normalize_key(F.col("artist")).alias("_artist")).agg(last.alias("genre"))
    keyed = records.withColumn("_artist", text.normalize_key(F.col("artist_raw")))
    return keyed.join(known, "_artist").select(*records.columns, "genre")


def carry(rows: DataFrame, group: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each of ``columns`` from the last row of its group that has it."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*(F.last(c, ignorenulls=True).over(w).alias(c) if c in columns else F.col(c) for c in rows.columns))


def viral_songs(pages: DataFrame) -> DataFrame:
    """(title, artist_raw, year, original_year) of articles (page_title, intro) that say a song went viral.

    Pages that name no artist or no viral year drop out.
    """
    intro = F.col("intro")
    found = pages.select(
        text.page_song(F.col("page_title")).alias("title"), text.intro_artist(intro).alias("artist_raw"), text.viral_year(intro).alias("year"), text.release_year(intro).alias("original_year")
    )
    return found.filter("artist_raw is not null and year is not null and title <> ''")
