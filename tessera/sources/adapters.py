"""External services behind one interface, so that all of it runs offline.

A fetcher takes a request and returns (status, body), or (status, body, wait)
where the service says how long to wait. The default reads from a table of
landed responses; a real one does HTTP. Fetching is bounded: one request at a
time in each partition, at a given pace, with retries that back off.
"""

from __future__ import annotations

import csv
import io
import json
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tessera.functions import text

Fetcher = Callable[[str], tuple]

# The service client's pace and patience.
PER_MINUTE, RETRIES, BACKOFF, JITTER, LONGEST = 28, 4, 2.0, 0.5, 30.0


def wait_time(attempt: int, retry_after: float | None = None, draw: Callable[[], float] = random.random) -> float:
    """What the service asks for, else an exponential time with jitter, 30 s at most."""
    return retry_after if retry_after is not None else min(LONGEST, BACKOFF * 2**attempt + JITTER * draw())


def with_retries(fetch: Fetcher, request: str, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep) -> tuple[int, str]:
    """Repeat while the service is busy or fails."""
    for attempt in range(retries + 1):
        status, body, *wait = fetch(request)
        if status not in (429, 500, 502, 503, 504) or attempt == retries:
            break
        sleep(wait_time(attempt, *wait))
    return status, body


def paced(fetch: Fetcher, per_minute: float = PER_MINUTE, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> Fetcher:
    """A fetcher that asks no more often than that; each of n partitions should get an nth of a service's limit."""
    last = -60.0 / per_minute

    def ask(request: str) -> tuple:
        nonlocal last
        due = last + 60.0 / per_minute
        if (now := clock()) < due:
            sleep(due - now)
        last = max(now, due)
        return fetch(request)

    return ask


def with_token(fetch: Fetcher, token_request: str) -> Fetcher:
    """A fetcher that first asks for a token, adds it to every request and renews it when it is refused."""
    token = None

    def ask(request: str) -> tuple:
        nonlocal token
        for _ in range(2):
            if token is None:
                status, body, *_ = fetch(token_request)
                if status != 200:
                    return status, body
                token = json.loads(body)["access_token"]
            got = fetch(f"{request}#{token}")
            if got[0] != 401:
                return got
            token = None
        return got

    return ask


def fetch_all(requests: DataFrame, make_fetcher: Callable[[], Fetcher], partitions: int = 5) -> DataFrame:
    """Adds status and body to rows with ``request``; ``partitions`` at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = make_fetcher()
        for pdf in batches:
            got = [with_retries(fetch, r) for r in pdf["request"]]
            yield pdf.assign(status=[s for s, _ in got], body=[b for _, b in got])

    schema = StructType([*requests.schema.fields, StructField("status", IntegerType()), StructField("body", StringType())])
    return requests.repartition(partitions).mapInPandas(run, schema)


def csv_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of CSV replies with a header, as strings in the given columns; one that is missing is null."""
    wanted = list(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for request, status, body in zip(pdf["request"], pdf["status"], pdf["body"], strict=True):
                rows = csv.DictReader(io.StringIO(body or "")) if status == 200 else ()
                yield pd.DataFrame([(request, *(r.get(c) for c in wanted)) for r in rows], columns=["request", *wanted], dtype=object)

    schema = StructType([StructField(c, StringType()) for c in ("request", *wanted)])
    return df.select("request", "status", "body").mapInPandas(run, schema)


def landed(responses: dict[str, tuple[int, str]]) -> Callable[[], Fetcher]:
    """Answers from a table of landed responses; 404 for any other request."""
    return lambda: lambda request: responses.get(request, (404, ""))


def lyrics_of(df: DataFrame) -> DataFrame:
    """Lyrics and a reason where there are none, from replies: JSON arrays of
    {plainLyrics, syncedLyrics}; plain ones first, else synced ones without timestamps."""
    replies = F.from_json("body", "array<struct<plainLyrics:string,syncedLyrics:string>>")
    plain = F.get(F.filter(replies, lambda r: F.coalesce(F.trim(r["plainLyrics"]), F.lit("")) != ""), F.lit(0))["plainLyrics"]
    synced = text.strip_timestamps(F.get(F.filter(replies, lambda r: F.coalesce(F.trim(r["syncedLyrics"]), F.lit("")) != ""), F.lit(0))["syncedLyrics"])
    found = F.nullif(text.clean_lyrics(F.coalesce(plain, synced)), F.lit(""))
    reason = F.when(F.col("status") == 404, "not_found").when(F.col("status") >= 400, F.concat(F.lit("http_"), F.col("status").cast("string"))).when(found.isNull(), "no_results")
    return df.withColumn("lyrics", F.when(F.col("status") < 400, found)).withColumn("reason", reason)


def match_artist(name: str, found: list[dict]) -> dict | None:
    """The artist of exactly that name, else the first whose name contains it."""
    low = name.lower()
    exact = [a for a in found if a["name"].lower() == low]
    return next(iter(exact or [a for a in found if low in a["name"].lower()]), None)


def songs_of(songs: list[dict], artist_id: int) -> list[dict]:
    """Of an artist's listed songs those that are by that artist first of all."""
    return [s for s in songs if s.get("primary_artist", {}).get("id") == artist_id]


def pages(fetch: Fetcher, request: Callable[[int], str], items: str, most: int = 1000) -> list[dict]:
    """Items of numbered pages until one is empty."""
    out: list[dict] = []
    for page in range(1, most + 1):
        status, body = with_retries(fetch, request(page))
        got = json.loads(body).get(items, []) if status == 200 else []
        if not got:
            break
        out += got
    return out
