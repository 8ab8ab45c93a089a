import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.constants import VIRAL_UNION_WEIGHTS, VIRAL_YEAR_PRIORITY
from tessera.operators import chunk, dedup, evaluate, fusion, html, ingest, judge, sampling, scoring, semantic
from tessera.sources import adapters, tables
from tessera.streaming import incremental


def plain_chunks(text):
    import re

    lines = re.sub(r"\n{3,}", "\n\n", text).split("\n")
    spans = []
    for s in range(0, len(lines), 6):
        stop = min(s + 8, len(lines))
        spans.append([s, next((j for j in range(s + 5, stop) if not lines[j].strip()), stop)])
    if len(spans) > 1 and sum(bool(x.strip()) for x in lines[slice(*spans[-1])]) < 4:
        last = spans.pop()
        spans[-1][1] = last[1]
    out = [("\n".join(x for x in lines[a:b] if x.strip()), a, b) for a, b in spans]
    return [x for x in out if len(x[0]) >= 50]


def test_chunks(spark):
    line = "some words of a line"
    texts = ["\n".join("" if i in blank else f"{line} {i}" for i in range(n)) for n in (1, 3, 7, 8, 9, 12, 14, 20, 21) for blank in ((), (5,), (6, 13), (5, 6, 7), (7,), (1, 2, 3))]
    texts += ["", "short", " \n \n", line + "\n\n\n\n\n" + "\n".join([line] * 9)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "id int, t string")
    got = {}
    for r in chunk.chunk_passages(df, "id", "t").orderBy("id", "start_line").collect():
        got.setdefault(r.id, []).append((r.passage_text, r.start_line, r.end_line))
    assert got == {i: c for i, t in enumerate(texts) if (c := plain_chunks(t))}
    twenty = "\n".join("" if i in (6, 13) else line for i in range(20))
    assert [x[1:] for x in plain_chunks(twenty)] == [(0, 6), (6, 13), (12, 20)]


GRADES = [[3, 0, 2, 0, 0, 0, 0, 0, 0, 0], [0, 1, 2, 3, 0, 0, 0, 0, 0, 0], [0] * 10]


def test_ranking_metrics(spark):
    rows = [(q, r, g, "en") for q, grades in enumerate(GRADES) for r, g in enumerate(grades, 1)]
    df = spark.createDataFrame(rows, "query_id int, rank int, grade int, language string")
    scores = evaluate.per_query(df, ["language"])
    by_query = {r.query_id: r for r in scores.collect()}
    assert by_query[0].dcg == pytest.approx(8.5)
    assert [by_query[i].ndcg for i in range(3)] == pytest.approx([0.9558305893, 0.5478314819, 0.0])
    whole = [r for r in evaluate.summarize(scores, "language").collect() if r.language is None][0]
    assert (whole.recall_1, whole.recall_5, whole.recall_10, whole.rr, whole.ndcg) == pytest.approx((1 / 3, 2 / 3, 2 / 3, 4 / 9, 0.5012206904), abs=1e-8)
    assert whole.small


def graders(spark, a, b):
    return spark.createDataFrame([("x", *p) for p in zip(a, b, strict=True)], "g string, a int, b int")


def test_agreement(spark):
    a, b = [3, 3, 2, 2, 1, 1, 0, 0], [3, 2, 2, 1, 1, 0, 0, 0]
    r = evaluate.agreement(graders(spark, a, b), "a", "b", ["g"]).first()
    assert (r.kappa, r.exact, r.within_one) == pytest.approx((0.85, 5 / 8, 1.0))
    assert evaluate.spearman(graders(spark, a, b), "a", "b", ["g"]).first().spearman == pytest.approx(0.911465, abs=1e-6)
    cells = {(r.a, r.b): r.n for r in evaluate.confusion(graders(spark, a, b), "a", "b").collect()}
    assert [[cells[i, j] for j in range(4)] for i in range(4)] == [[2, 0, 0, 0], [1, 1, 0, 0], [0, 1, 1, 0], [0, 0, 1, 1]]
    assert evaluate.agreement(graders(spark, [3, 3, 0, 0], [0, 0, 3, 3]), "a", "b", ["g"]).first().kappa == -1.0
    constant = graders(spark, [2, 2], [2, 2])
    assert math.isnan(evaluate.agreement(constant, "a", "b", ["g"]).first().kappa)
    assert math.isnan(evaluate.spearman(constant, "a", "b", ["g"]).first().spearman)
    assert evaluate.agreement(graders(spark, [1, None], [1, 2]), "a", "b", ["g"]).first().n == 1


def test_missing_grade_is_an_error(spark):
    results = spark.createDataFrame([(1, 7, 1)], "query_id int, passage_id int, rank int")
    grades = spark.createDataFrame([], "query_id int, passage_id int, grade int")
    with pytest.raises(Exception, match="no grade for 1"):
        evaluate.report(results, grades).collect()


def test_rrf(spark):
    ranked = lambda ids: spark.createDataFrame([(x, i) for i, x in enumerate(ids, 1)], "id int, rank int")
    got = fusion.search("find", ranked([10, 20, 30]), ranked([20, 40])).orderBy("rank").collect()
    assert [(r.id, round(r.score, 6), r.dominance) for r in got] == [(20, 0.032522, "both"), (10, 0.016393, "semantic"), (40, 0.016129, "lexical"), (30, 0.015873, "semantic")]
    tie = fusion.rrf([("a", ranked([1])), ("b", ranked([2]))]).orderBy("rank").collect()
    assert [r.id for r in tie] == [1, 2]
    with pytest.raises(ValueError):
        fusion.search("other", ranked([1]), ranked([1]))


def test_quotas():
    assert sampling.language_quota({"en": 81, "pl": 19}, 10) == {"en": 8, "pl": 2}
    assert sampling.language_quota({"en": 81, "pl": 19, "de": 9, "es": 5}, 10) == {"en": 6, "pl": 2, "de": 1, "es": 1}
    few = sampling.language_quota({"en": 500, "es": 3}, 10)
    assert few["es"] >= 1 and sum(few.values()) == 10
    assert sampling.language_quota({"a": 1, "b": 1, "c": 1, "d": 1}, 2) == {"a": 1, "b": 1}
    assert sampling.language_quota({"en": 5, "pl": 0}, 5) == {"en": 5}
    assert sampling.language_quota({}, 5) == {}
    assert sampling.band_targets(25) == {"top": 9, "mid": 8, "deep": 8}
    assert sum(map(sum, sampling.candidate_plan({"en": 70, "es": 3}).values())) == 98 + 5


def test_band_sample_uses_no_passage_twice(spark):
    rows = [(q, p, r) for q in range(4) for r, p in enumerate(range(q, q + 30), 1)]
    df = spark.createDataFrame(rows, "query_id int, passage_id int, rank int")
    got = sampling.band_sample(df, [F.col("passage_id")], {"top": 4, "mid": 3, "deep": 3}).collect()
    # The last query's top passages all go to others' middle bands.
    assert len({r.passage_id for r in got}) == len(got) == 9


def test_search_rules():
    assert [semantic.clamp_k(k) for k in (1, 10, 25, 100, 0, -5)] == [1, 10, 25, 25, 1, 1]
    assert [semantic.depth(k) for k in (1, 10, 25)] == [40, 40, 100]
    routes = [("en", True), ("pl", True), ("en", False), ("pl", False), ("de", False), ("es", False), (None, True), ("xx", True)]
    assert [semantic.route(*r)[1] for r in routes] == ["en", "pl", "en", None, None, None, None, None]
    assert semantic.route("es")[0] == "multilingual"
    with pytest.raises(ValueError):
        semantic.check_query("  \n")


def test_null_and_zero_vectors_are_no_candidates(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, None, "a"), (3, [0.0, 0.0], None), (4, [1.0, 0.0], None), (5, [2.0, 0.1], "b")], "id int, v array<float>, language string")
    assert [r.id for r in semantic.topk(df, [1.0, 0.0], 5, "id", "v").collect()] == [1, 4, 5]
    assert [r.id for r in semantic.topk(df, [1.0, 0.0], 5, "id", "v", "language", "b").collect()] == [5, 1, 4]


def viral(spark, rows):
    fields = "seq int, key string, artist string, title string, featured_artists string, source string, year int, original_year int, norm_score double"
    df = spark.createDataFrame([(i, "k", "A", "T", None, s, y, o, 0.5) for i, (s, y, o) in enumerate(rows)], fields)
    return scoring.viral_union(df, VIRAL_UNION_WEIGHTS, VIRAL_YEAR_PRIORITY, 0.5).first()


def test_year_by_priority(spark):
    r = viral(spark, [("spotify_viral", 2001, None), ("wiki_viral", 2020, 1999), ("tiktok_year", 2022, None), ("tiktok_year", 2023, None)])
    assert (r.year, r.original_year, r.source) == (2022, 1999, "spotify_viral, wiki_viral, tiktok_year")
    assert r.combined_score == pytest.approx(0.5 * (0.8 + 0.5 + 1.0 + 1.0))
    held = viral(spark, [("tiktok_year", None, None), ("wiki_viral", 2020, 2020)])
    assert (held.year, held.original_year) == (None, 2020)
    assert viral(spark, [("wiki_viral", 2020, 2020)]).original_year is None


def test_decade_score(spark):
    rows = [(i, "k", "A", "T", None, 1990 + i, r) for i, r in enumerate((15, 18, 22, 19))]
    df = spark.createDataFrame(rows, "seq int, key string, artist string, title string, featured_artists string, year int, rank int")
    r = scoring.decade_points(df).first()
    assert (r.decade_score, r.year, r.decade) == (330, 1990, "1990s")


def test_ingest(spark):
    target = spark.createDataFrame([("a", 1)], "k string, v int")
    incoming = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2), (None, 5)], "k string, v int")
    new = {(r.k, r.v) for r in ingest.insert_ignore(target, incoming, ["k"], [F.col("v")]).collect()}
    assert new == {("b", 2), (None, 5)}
    updated = ingest.update_column(target.unionByName(spark.createDataFrame([("c", 4)], target.schema)), spark.createDataFrame([("a", 7)], target.schema), ["k"], "v")
    assert {tuple(r) for r in updated.collect()} == {("a", 7), ("c", 4)}


def test_keep_first_and_seed(spark):
    df = spark.createDataFrame([(3, "X"), (1, "x"), (2, "y")], "seq int, v string")
    assert {r.seq for r in dedup.first_seen(df, "v", [F.col("seq")]).collect()} == {1, 2}
    one = spark.createDataFrame([(1, "k1", "A")], "seq int, key string, artist string")
    two = spark.createDataFrame([(0, "k1", 1999), (1, "k2", 2000)], "seq int, key string, year int")
    got = {(r.key, r.artist, r.year, r.tier) for r in dedup.merge_seed([("canonical", one), ("decades", two)], ["artist", "year", "genre"]).collect()}
    assert got == {("k1", "A", None, "canonical"), ("k2", None, 2000, "decades")}


PAGE = """<h2>1971 awards</h2><table><tr><th>No.</th><th>Title</th><th>Artist(s)</th></tr>
<tr><td>1[a]</td><td>"One"</td><td rowspan="2">Same</td></tr><tr><td>2</td><td>“Two”</td></tr><tr><td>3</td><td>Three</td><td>Other<br>line</td></tr></table>"""


def test_html_tables(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "<table><tr><td>1</td><td>A</td><td>B</td></tr></table>")], "page_id long, html string")
    rows = html.tables(df, "page_id", "html")
    got = html.chart_rows(rows, 3).orderBy("row_no").collect()
    assert [(r.rank, r.title, r.artist_raw) for r in got] == [(1, "One", "Same"), (2, "Two", "Same"), (3, "Three", "Other line")]
    assert {r.year for r in html.year_of_rows(rows).filter("id = 1").collect()} == {1971}
    assert [r.id for r in html.chart_rows(rows, 1).filter("id = 3").collect()] == [3]


def test_html_cells(spark):
    df = spark.createDataFrame([(["May 1", '"Song"\nSinger'],), (["x", '"Other" †', "Band[2]"],)], "c array<string>")
    got = [[(x.title, x.artist_raw) for x in r.o] for r in df.select(html.number_one_cells(F.col("c")).alias("o")).collect()]
    assert got[0] == [("Song", "Singer")] and got[1][0][1] == "Band"
    r = spark.createDataFrame([("A – B\n· C – D · junk",)], "c string").select(html.nominees(F.col("c")).alias("n"), html.artist_dash_title(F.lit("X - Y - Z")).alias("d")).first()
    assert [(x.title, x.artist_raw) for x in r.n] == [("A", "B"), ("C", "D")]
    assert (r.d.artist_raw, r.d.title) == ("X", "Y - Z")


def test_judge_cache(spark):
    pairs = spark.createDataFrame([("q1", "1", "late night", "a late night drive"), ("q1", "2", "late night", "nothing")], "query_id string, passage_id string, query string, passage_text string")
    cache = spark.createDataFrame([("m::v3", "q1", "1", 2), ("m::v2", "q1", "2", 3)], "signature string, query_id string, passage_id string, grade int")
    graded, new = judge.judge_all(pairs, cache, "m::v3")
    assert {(r.passage_id, r.grade) for r in graded.collect()} == {("1", 2), ("2", 0)}
    assert [(r.signature, r.passage_id) for r in new.collect()] == [("m::v3", "2")]
    budgets = []

    def stubborn():
        def grade(prompt, budget):
            budgets.append(budget)
            return "none"

        return grade

    with pytest.raises(Exception, match="no grade in"):
        judge.grade(pairs, stubborn).collect()


def test_adapters(spark):
    calls = iter([(429, ""), (503, ""), (200, "ok")])
    waits = []
    assert adapters.with_retries(lambda r: next(calls), "x", sleep=waits.append) == (200, "ok")
    assert len(waits) == 2 and waits[1] > waits[0] >= 2
    assert adapters.wait_time(9) == 30.0 and adapters.wait_time(0, 7) == 7
    requests = spark.createDataFrame([("a",), ("b",), ("c",)], "request string")
    body = '[{"plainLyrics": "", "syncedLyrics": "[00:01.00] Hello"}, {"plainLyrics": "Plain", "syncedLyrics": null}]'
    landed = adapters.landed({"a": (200, body), "b": (200, "[]")})
    got = {r.request: (r.lyrics, r.reason) for r in adapters.lyrics_of(adapters.fetch_all(requests, landed)).collect()}
    assert got == {"a": ("Plain", None), "b": (None, "no_results"), "c": (None, "not_found")}
    assert adapters.match_artist("abba", [{"name": "ABBA Tribute"}, {"name": "Abba"}])["name"] == "Abba"


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("A, \"x\"", None, "1999")], "artist string, genre string, year string")
    tables.write_csv(df, f"{tmp_path}/c")
    got = tables.read_csv_text(spark, f"{tmp_path}/c", ["artist", "year", "decade"], tier="recent").first()
    assert tuple(got) == ("A, \"x\"", "1999", None, "recent")
    assert tables.read_csv_typed(spark, f"{tmp_path}/none", "a int", missing_ok=True).count() == 0
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "good.json").write_text('{"pairs": [{"a": 1}, {"a": 2}]}')
    schema = "pairs array<struct<a:int>>"
    assert [r.a for r in tables.read_document(spark, f"{tmp_path}/good.json", schema, "pairs").collect()] == [1, 2]
    assert tables.read_document(spark, f"{tmp_path}/bad.json", schema, "pairs").count() == 0
    parts = tables.collect_sources([("one", spark.createDataFrame([(5, "x")], "seq long, v string")), ("two", spark.createDataFrame([(1, "y")], "seq long, v string"))])
    assert [r.source for r in parts.orderBy("seq").collect()] == ["one", "two"]
    assert tables.unify_columns(df.withColumnRenamed("artist", "Artist_Name"), {"artist": ["artist", "artist_name"], "title": ["song"]}).first().title is None


def test_incremental_runs_see_each_file_once(spark, tmp_path):
    source, sink, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    for start in (0, 10):
        spark.range(start, start + 10).withColumn("v", F.lit(1.0)).write.mode("append").parquet(source)
        for _ in range(2):
            incremental.process_new(spark, source, "id long, v double", sink, mark, lambda df: df.withColumn("v", F.col("v") + 1), "id")
    assert sorted((r.id, r.v) for r in incremental.read_processed(spark, sink).collect()) == [(i, 2.0) for i in range(20)]


def test_cells_that_span_rows(spark):
    """Against a row-by-row walk: nested and ended spans, headers, null spans, one page over many partitions."""
    rng = random.Random(2)
    rows = []
    for page, n in (("a", 3000), ("b", 1), ("c", 40), (None, 30)):
        rows += [(page, i, rng.choice([None, None, None, f"v{i}"]), rng.choice([None, 1, 2, 9, 60]), rng.choice([None, False, False, False, True]) if i % 9 == 0 else False) for i in range(n)]
    want, held = {}, {}
    for page, i, value, span, header in rows:
        if header:
            held[page] = (None, 0)
        elif value is not None:
            held[page] = (value, 1 if span is None else span)
        v, left = held.get(page, (None, 0))
        want[page, i] = v if left > 0 else None
        held[page] = (v, left - 1)
    df = spark.createDataFrame(rows, "page string, place long, value string, span int, header boolean").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scoring.carry_spans(df, ["page"], "place", "value", "span", "header").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.page, r.place): r.carried for r in got} == want and len(got) == len(rows)
    assert scoring.carry_spans(df.limit(0), ["page"], "place", "value", "span", "header").count() == 0
