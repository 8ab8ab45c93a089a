import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ann, charts, encode, html, ingest, scoring, semantic, serve
from tessera.sources import adapters, tables
from tessera.storage import new_path


@pytest.fixture(scope="module")
def vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    return table.select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("language")).cache()


def nearest(vectors, k):
    rows = [(r.id, r.embedding) for r in vectors.collect() if r.embedding is not None]
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], dtype=np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return {i: set(ids[np.lexsort((ids, -np.round(v @ x, 6)))[:k]].tolist()) for i, x in zip(ids.tolist(), v, strict=True) if i % 20 == 0}


def test_index_finds_nine_in_ten_and_has_every_row(spark, vectors):
    """Recall over all ids divisible by 20, against brute force, with the share of lists that the query reads."""
    path = new_path(spark, "index")
    centres = ann.build(vectors, "embedding", path)
    index = spark.read.parquet(path).cache()
    assert index.count() == vectors.filter("embedding is not null").count()
    truth, hits = nearest(vectors, 10), 0
    share = ann.share_for(index, centres, "id", "embedding", sample=40)
    queries = {r.id: r.embedding for r in vectors.filter("id % 20 = 0 and embedding is not null").collect()}
    for i, wanted in truth.items():
        got = {r.id for r in ann.topk(index, centres, queries[i], 10, "id", "embedding", share).collect()}
        hits += len(got & wanted)
        assert i in got
    assert hits >= 0.9 * 10 * len(truth)
    some = next(iter(truth))
    assert {r.id for r in ann.topk(index, centres, queries[some], 10, "id", "embedding", share=1.0).collect()} == truth[some]
    groups = spark.range(400).select("id", F.array(*(F.when(F.col("id") % 8 == j, 9.0).otherwise(F.rand(j)).cast("float") for j in range(8))).alias("embedding"))
    path = new_path(spark, "index")
    centres = ann.build(groups, "embedding", path, 8)
    assert ann.share_for(spark.read.parquet(path), centres, "id", "embedding", k=5) <= 0.5  # clear groups need few lists
    none = vectors.limit(0)
    empty = new_path(spark, "index")
    assert len(ann.build(none, "embedding", empty)) == 1


def test_batch_search_in_small_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(semantic, "QUERY_BLOCK", 7)
    monkeypatch.setattr(semantic, "TILE", 3)
    odd = vectors.unionByName(spark.createDataFrame([(10**6, None, "1"), (10**6 + 1, [0.0] * 64, "1")], "id long, embedding array<float>, language string"))
    queries = vectors.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"), F.lit(None).cast("string").alias("query_language"))
    got = {}
    for r in semantic.topk_batch(odd.repartition(5), queries, 10, "id", "embedding").collect():
        got.setdefault(r.query_id, set()).add(r.id)
    assert got == nearest(vectors, 10)


def test_vibe_search_routes_and_groups(spark):
    passages = spark.createDataFrame(
        [(1, 1, "la la love", "en"), (2, 1, "love and love", "en"), (3, 2, "rain on love", "de"), (4, 3, "nothing", "en"), (5, 9, "love of no song", "en")],
        "id long, song_id long, passage_text string, language string",
    )
    passages = encode.embed(passages, "passage_text").withColumn("embedding_multi", F.col("embedding"))
    songs = spark.createDataFrame([(1, "A", "One", 1990), (2, "B", "Two", None), (3, "C", "Three", 2000)], "id long, artist string, title string, year int")
    label, found = serve.vibe_search(passages, songs, "love", 2, detect=lambda t: "de")
    rows = found.collect()
    assert label == "de" and [r.rank for r in rows] == [1, 2] and {r.title for r in rows} <= {"One", "Two", "Three"}
    assert serve.vibe_search(passages, songs, "love", 99)[1].count() == 3
    assert serve.vibe_search(passages, songs, "love", detect=lambda t: None)[0] == "unknown"
    with pytest.raises(ValueError):
        serve.vibe_search(passages, songs, "  ")
    find = serve.search(passages, "loved raining", "find").collect()
    assert find[0].dominance in ("both", "lexical", "semantic") and {r.id for r in find if r.lexical_rank is not None} == {1, 2, 3, 5}
    with pytest.raises(ValueError):
        serve.search(passages, "love", "other")


def test_settings(monkeypatch):
    assert serve.config_description(note="run 2").endswith("no reranker | run 2") and "pl/de/es" in serve.config_description()
    monkeypatch.delenv("GIT_COMMIT", raising=False)
    assert serve.running_commit() == "unknown"
    monkeypatch.setenv("GIT_COMMIT", " 0123456789abcdef ")
    assert serve.running_commit() == "0123456789ab"
    monkeypatch.setenv("SWITCH", "Off")
    assert not serve.flag("SWITCH") and serve.flag("NO_SUCH_SWITCH")


def test_failed_write_leaves_the_old_version(spark, tmp_path):
    path = f"{tmp_path}/t"
    tables.regenerate(spark.range(5), path)
    bad = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        tables.regenerate(bad, path)
    assert spark.read.parquet(path).count() == 5
    tables.regenerate(spark.read.parquet(path).filter("id > 1"), path)  # reads what it replaces
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3, 4]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_service_says_how_long_to_wait():
    waits, replies = [], iter([(429, "", 7.0), (503, ""), (200, "ok")])
    assert adapters.with_retries(lambda r: next(replies), "x", sleep=waits.append) == (200, "ok")
    assert waits[0] == 7.0 and waits[1] != 7.0
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    ask = adapters.paced(lambda r: (200, r), per_minute=30, sleep=sleep, clock=lambda: now[0])
    assert [ask(x)[1] for x in "abc"] == ["a", "b", "c"] and slept == [2.0, 2.0]
    tokens = iter(["t1", "t2"])
    seen = []

    def service(request):
        seen.append(request)
        if request == "token":
            return 200, f'{{"access_token": "{next(tokens)}"}}'
        return (401, "") if request.endswith("#t1") else (200, "fine")

    assert adapters.with_token(service, "token")("song") == (200, "fine")
    assert seen == ["token", "song#t1", "token", "song#t2"]
    assert adapters.songs_of([{"id": 1, "primary_artist": {"id": 5}}, {"id": 2, "primary_artist": {"id": 6}}, {"id": 3}], 5) == [{"id": 1, "primary_artist": {"id": 5}}]


def test_csv_replies(spark):
    replies = spark.createDataFrame([("a", 200, 'Rank,Title,Artist\n1,"One, two",X\n2,Three,Y\n'), ("b", 404, ""), ("c", 200, "")], "request string, status int, body string")
    got = [tuple(r) for r in adapters.csv_of(replies, ["Title", "Rank", "Year"]).orderBy("Rank").collect()]
    assert got == [("a", "One, two", "1", None), ("a", "Three", "2", None)]


def test_running_count_over_many_partitions(spark):
    df = spark.range(2000).select((F.col("id") % 2).cast("string").alias("g"), (F.col("id") * 7919 % 2003).alias("seq")).withColumn("g", F.when(F.col("g") == "1", F.col("g")))
    con = duckdb.connect()
    pdf = df.toPandas()  # noqa: F841
    want = con.execute("select g, seq, row_number() over (partition by g order by seq) as place from pdf").fetchall()
    got = [tuple(r) for r in scoring.running_count(df.repartition(9), ["g"], ["seq"]).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_items_of_odd_lists():
    page = '<ul class="x"><li id=1>one <b>bold</b> &amp; two<li>three<ul><li>inner</ul> more</li></ul><li>stray</li><p>text'
    assert html.parse_items(page) == ["one bold &amp; two", "three more", "inner", "stray"]
    assert html.parse_items(None) == []


def test_counts_and_lists(spark):
    df = spark.createDataFrame([(1, "a", 2000, 1990), (2, "a, b", 2000, None), (3, None, None, 1990)], "id long, source string, year int, original_year int").withColumn("featured_artists", F.lit(None).cast("string"))
    got = {r.year: tuple(r)[1:] for r in ingest.merged_counts(df, "year").collect()}
    assert got == {2000: (2, 1, 0, 1), None: (1, 0, 0, 0)}
    assert ingest.random_rows(df, ["id"], 2).count() == 2
    assert [r.id for r in ingest.random_rows(df.repartition(3), ["id"], 2).collect()] == [r.id for r in ingest.random_rows(df, ["id"], 2).collect()]
    rows = spark.createDataFrame([(["x"], 1), ([], 2), (None, 3)], "cells array<string>, year int").withColumn("seq", F.col("year"))
    assert charts.top_ten(rows, ["seq"]).count() == 0 and charts.all_time(rows).count() == 0
