"""Queries over charts, lists and sources: cells of pages, files, works lists.

Pages' cells are made of the star schema: a part is a song, its brand the
artist, its type the release.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import charts, evaluate, html, ingest, judge, sampling, scoring, semantic
from tessera.plans.corpus_queries import _ENTRIES, _WEIGHTS, entries
from tessera.plans.registry import query
from tessera.plans.text_queries import KEY
from tessera.sources import tables
from tessera.storage import new_path, table
from tessera.streaming import incremental


@query(
    """select cast(p_partkey as integer) as rank, p_name as title, p_brand as artist_raw, cast(2000 + p_partkey % 25 as integer) as year from part where p_partkey % 7 > 0 and p_partkey % 25 < 30"""
)
def all_time_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    released = F.when(key % 7 == 0, "1999").otherwise(F.concat((2000 + key % 25).cast("string"), F.lit(" (UK)")))
    cells = F.array(key.cast("string"), F.concat("p_name", F.lit(" [1]")), F.concat(F.lit(" "), F.col("p_brand")), F.lit("3,100"), released)
    return charts.all_time(table(spark, sf_dir, "part").select(cells.alias("cells")))


@query(
    """with l as (select cast(p_partkey as integer) as rank, p_name as title, p_brand as artist_raw, cast(2000 + p_partkey % 25 as integer) as year from part where p_partkey % 7 > 0)
select title, artist_raw, year, cast(row_number() over (partition by year order by rank, title, artist_raw) as integer) as rank from l where year between 2017 and 2024"""
)
def all_time_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.of_years(all_time_list(spark, sf_dir), 2017, 2024).select("title", "artist_raw", "year", "rank")


@query(
    f"""with c as (select p_partkey as seq, cast(2000 + p_partkey % 10 as integer) as year, p_size % 13 as peak, p_type as title, p_brand as artist_raw, row_number() over (partition by p_partkey % 10, {KEY("p_brand")}, {KEY("p_type")} order by p_partkey) as rn
  from part where p_size % 13 between 1 and 10 and p_partkey % 4 > 0)
select year, cast(peak as integer) as rank, title, artist_raw from c where rn = 1"""
)
def uk_top_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, six = F.col("p_partkey"), F.col("p_partkey") % 4 == 1
    title = F.when(key % 2 == 0, F.concat(F.lit("[2] \""), F.col("p_type"), F.lit("\" ‡ (#3)"))).otherwise(F.concat(F.col("p_type"), F.lit(" ‡ x")))
    rest = [F.lit("5"), title, F.concat(F.col("p_brand"), F.lit(" [a]")), F.concat(F.lit("no. "), (F.col("p_size") % 13).cast("string")), F.lit("x"), F.lit("y")]
    cells = F.when(key % 4 == 0, F.array(F.lit("too few"))).when(six, F.array(*rest)).otherwise(F.array(F.lit("1 May"), *rest))
    rows = table(spark, sf_dir, "part").select(cells.alias("cells"), (2000 + key % 10).cast("int").alias("year"), key.alias("seq"))
    return charts.top_ten(rows, ["seq"])


_BRANDS = "b as (select distinct p_brand from part), g as (select p_brand, case when cast(right(p_brand, 1) as integer) % 2 = 0 then 'rock' else 'folk' end as genre from b where cast(right(p_brand, 1) as integer) < 5)"


@query(f"with {_BRANDS} select p_partkey, p_brand as artist_raw, genre from part join g using (p_brand)")
def artist_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    digit = F.substring("p_brand", -1, 1).cast("int")
    genres = part.filter(digit < 5).select(F.upper("p_brand").alias("artist"), F.when(digit % 2 == 0, "rock").otherwise("folk").alias("genre")).distinct()
    return charts.with_artist_genre(part.select("p_partkey", F.col("p_brand").alias("artist_raw")), genres)


@query(
    """with k as (select p_brand, arg_max(p_type, p_partkey) as genre from part where p_partkey % 3 > 0 group by 1)
select p_partkey, p_brand as artist_raw, genre from part join k using (p_brand)"""
)
def artist_genres_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 where many names become equal: the last entry wins."""
    part = table(spark, sf_dir, "part")
    genres = part.filter("p_partkey % 3 > 0").select(F.upper("p_brand").alias("artist"), F.col("p_type").alias("genre"), F.col("p_partkey").alias("seq"))
    return charts.with_artist_genre(part.select("p_partkey", F.col("p_brand").alias("artist_raw")), genres)


@query("select p_partkey, p_type as url, case p_type when 'ECONOMY' then 'rap' else 'metal' end as genre, 'award' as source from part where p_type in ('ECONOMY', 'PROMO')")
def genre_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = spark.createDataFrame([("ECONOMY", "rap", "award"), ("PROMO", "metal", "award")], "url string, genre string, source string")
    return charts.with_genre(table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("url")), lists).select("p_partkey", "url", "genre", "source")


@query(
    "select o_orderkey, o_custkey, last_value(case when o_orderkey % 3 = 0 then o_orderpriority end ignore nulls) over (partition by o_custkey order by o_orderkey rows unbounded preceding) as artist from orders"
)
def award_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("artist"))
    return charts.carry(rows, "o_custkey", ["o_orderkey"], ["artist"])


@query(
    """with c as (select event_id, event_type, event_id % 13 = 0 as header, case when event_id % 7 = 0 then user_id end as artist, cast(1 + event_id % 40 as bigint) as rows from events),
h as (select *, last_value(case when header or artist is not null then {'until': case when header then event_id else event_id + rows end, 'v': case when not header then artist end} end ignore nulls)
  over (partition by event_type order by event_id rows unbounded preceding) as cell from c)
select event_id, event_type, case when event_id < cell.until then cell.v end as carried from h"""
)
def rowspan_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that span rows, ended by the next cell, a header or their last row; the pages are few and long."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", (e % 13 == 0).alias("header"), F.when(e % 7 == 0, F.col("user_id")).alias("artist"), (1 + e % 40).alias("rows"))
    return scoring.carry_spans(rows, ["event_type"], "event_id", "artist", "rows", "header").select("event_id", "event_type", "carried")


@query(
    """select p_partkey, [p_name || ' / ' || p_brand, p_type || ' / Maker ' || p_size] as both, [p_name || ' / ' || p_brand, p_type || ' / Maker ' || p_size] as nominees,
  p_brand as pair_artist, p_name || ' - live' as pair_title, [p_name] as prose from part"""
)
def chart_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number-one cells, nominees, "artist - title" and prose, all of the same songs."""
    quoted = lambda c: F.concat(F.lit("\""), F.col(c), F.lit("\""))
    cells = F.array(F.lit("1 May"), quoted("p_name"), F.concat("p_brand", F.lit(" [3]")), F.concat(quoted("p_type"), F.lit("\n"), F.concat(F.lit("Maker "), F.col("p_size").cast("string"))))
    listed = F.concat(quoted("p_name"), F.lit(" – "), F.col("p_brand"), F.lit(" • "), quoted("p_type"), F.lit(" – "), F.concat(F.lit("Maker "), F.col("p_size").cast("string")), F.lit("\nno dash"))
    prose = F.concat(F.lit("x" * 200), quoted("p_name"), F.lit(" (1999), not "), quoted("p_type"))
    both = F.array_sort(html.number_one_cells(cells), lambda a, b: F.when(a["title"] == F.col("p_name"), -1).otherwise(1))
    pair = html.artist_dash_title(F.concat(F.col("p_brand"), F.lit(" - "), F.col("p_name"), F.lit(" - live")))
    named = lambda songs: F.transform(songs, lambda r: F.concat_ws(" / ", r["title"], r["artist_raw"]))
    return table(spark, sf_dir, "part").select(
        "p_partkey", named(both).alias("both"), named(html.nominees(listed)).alias("nominees"), pair["artist_raw"].alias("pair_artist"), pair["title"].alias("pair_title"), html.prose_songs(prose).alias("prose")
    )


@query(
    """select p_partkey, p_partkey % 3 = 0 as meta, p_partkey % 2 = 0 and p_brand = 'Brand#13' as foreign_edit, contains(lower(p_name), 'rain') or contains(lower(p_name), 'sleep') or p_partkey % 5 = 0 as ambient,
  p_size as size_of, case when p_partkey % 2 = 0 then p_partkey end as "maybe" from part"""
)
def entry_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    meta = text.is_meta_entry(F.concat("p_name", F.when(key % 3 == 0, " (Genius Translation)").otherwise("")))
    foreign = text.is_foreign_edit(F.col("p_brand"), F.concat("p_name", F.when(key % 2 == 0, " - English Version").otherwise("")), ("Brand#13",))
    ambient = text.is_ambient(F.concat("p_name", F.when(key % 5 == 0, " White Noise").otherwise("")))
    size = text.to_int(F.concat(F.col("p_size").cast("string"), F.lit(".0")))
    maybe = text.to_int(F.when(key % 2 == 0, key.cast("string")).otherwise("n/a"))
    return table(spark, sf_dir, "part").select("p_partkey", meta.alias("meta"), foreign.alias("foreign_edit"), ambient.alias("ambient"), size.alias("size_of"), maybe.cast("long").alias("maybe"))


@query(
    """select lang, case lang when 'de' then 'multilingual' when 'es' then 'multilingual' when 'pl' then 'multilingual' else 'base' end as vectors, case when lang in ('en', 'pl', 'de', 'es') then lang end as boosted,
  case when lang in ('en', 'pl', 'de', 'es') then lang else 'unknown' end as label, 'base' as without_multi from (select distinct lang from documents where lang is not null)"""
)
def language_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [r["lang"] for r in table(spark, sf_dir, "documents").filter("lang is not null").select("lang").distinct().limit(1000).collect()]
    rows = [(x, *semantic.route(x), semantic.route_label(x), semantic.route(x, multilingual=False)[0]) for x in found]
    return spark.createDataFrame(rows, "lang string, vectors string, boosted string, label string, without_multi string")


@query("select count(*) as total, count(*) filter (source = 'src1') as found, count(*) filter (text is null) as missing, round(avg(length(text)) filter (source = 'src1'), 4) as avg_length from documents")
def average_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.lengths(table(spark, sf_dir, "documents"), "text", "src1", "source")


@query("select case when quality = 1 then 'success' when quality = 0 then 'no_results' else 'error' end as outcome, count(*) as n from documents left join labels using (doc_id) group by 1")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    tries = joined.select(F.when(F.col("quality") == 1, "words").alias("lyrics"), F.when(F.col("quality") == 0, "no_results").when(F.col("quality").isNull(), "http_500").alias("reason"))
    return ingest.outcomes(tries)


@query(
    f"""with {_ENTRIES}, firsts as (select distinct on (year, key, source) year, key, source, seq from entries order by year, key, source, seq), named as (select year, key, string_agg(source, ', ' order by seq) as source from firsts group by 1, 2),
m as (select year, key, arg_min(featured_artists, seq) filter (featured_artists is not null) as f, arg_min(original_year, seq) filter (original_year is not null) as oy from entries group by 1, 2)
select year, count(*) as songs, count(*) filter (contains(source, ',')) as multi_source, count(f) as featured, count(*) filter (year - oy > 3) as back_catalogue from m join named using (year, key) group by 1"""
)
def merged_song_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = entries(spark, sf_dir).withColumn("score", F.lit(1.0))
    merged = scoring._union(scored, ["year", "key"], {c: c for c in ("featured_artists", "original_year")})
    return ingest.merged_counts(merged, "year")


@query("select doc_id, lang, case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then 'en' else lang end as detected from documents where (case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then 'en' else lang end) is distinct from lang")
def language_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 4
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(n == 1, "en").when(n > 1, F.col("lang")).alias("detected"))
    return ingest.language_mismatches(docs, "lang", "detected")


@query("select o_orderkey, o_totalprice from orders order by o_orderkey limit 25")
def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.first_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_orderkey")], 25)


@query()
def random_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.random_rows(table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"], 5)


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment <> 'BUILDING')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'")
    return tables.cascade(left, table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "c_custkey", "o_custkey")


@query(
    r"""with w as (select doc_id as id, case when doc_id % 10 = 0 then 'fresh words of ' || doc_id else text end as t from documents)
select id, list_sort(list_distinct([x for x in regexp_split_to_array(lower(coalesce(t, '')), '[^\p{L}\p{M}\p{N}_]+') if x <> ''])) as terms from w"""
)
def refreshed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms follow a text that was updated, as both come from one expression."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    changed = docs.filter(F.col("id") % 10 == 0).select("id", F.concat(F.lit("fresh words of "), F.col("id").cast("string")).alias("text"))
    return ingest.update_column(docs, changed, ["id"], "text").select("id", F.sort_array(F.array_distinct(text.terms(F.coalesce("text", F.lit(""))))).alias("terms"))


@query("select cast(c_custkey as varchar) as id, c_name as name, null::varchar as extra, 'crm' as origin from customer")
def csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "csv")
    tables.write_csv(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_mktsegment"), path)
    return tables.read_csv_text(spark, path, ["id", "name", "extra"], origin="crm")


@query("select c_custkey as id, case when c_custkey % 3 > 0 then '\"' || c_name || '\",' || chr(10) || 'x' end as name, c_acctbal as balance from customer")
def csv_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "csv")
    name = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("\""), F.col("c_name"), F.lit("\",\nx")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), name.alias("name"), F.col("c_acctbal").alias("balance"))
    tables.write_csv(rows, path)
    return tables.read_csv_typed(spark, path, rows.schema.simpleString()[7:-1].replace(":", " "))


@query(
    """select c_name as artist, '' as title, '' as tier, cast(c_custkey as varchar) as year, 'no_results' as reason from customer where c_custkey % 2 = 0
union all select c_name, '', '', cast(c_custkey as varchar), 'http_500' from customer where c_custkey % 2 = 1"""
)
def failure_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "failures")
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("artist"), F.col("c_custkey").alias("year"))
    for n, reason in ((0, "no_results"), (1, "http_500")):
        tables.append_failures(rows.filter(F.col("year") % 2 == n).withColumn("reason", F.lit(reason)), path)
    return tables.read_csv_typed(spark, path, tables.FAILURES).na.fill("")


@query("select o_orderkey as id, [o_orderstatus, o_orderpriority] as tags from orders")
def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "json")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array("o_orderstatus", "o_orderpriority").alias("tags"))
    tables.write_document(rows.filter("id < 0"), path)
    tables.write_document(rows, path)  # replaces the first version
    return tables.read_document(spark, path, "id long, tags array<string>", lines=True)


@query("select o_orderkey as id, o_orderstatus as status from orders where o_orderkey % 2 = 1 union all select o_orderkey, o_orderstatus from orders where o_orderkey % 4 = 0")
def appended_and_regenerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "passages")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    tables.append(rows.filter("id % 2 = 0"), path)
    tables.regenerate(rows.filter("id % 2 = 1"), path)
    tables.append(rows.filter("id % 4 = 0"), path)
    return spark.read.parquet(path)


@query("select vec_id as id, label as song_id, cast(embedding as double[]) as embedding from embeddings")
def lean_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "export")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("song_id"), "embedding", F.col("embedding").alias("embedding_multi"), F.lit("x").alias("passage_tsv"))
    if not tables.export(rows, path):
        raise RuntimeError("nothing was written")
    return spark.read.parquet(path).select("id", "song_id", F.col("embedding").cast("array<double>").alias("embedding"))


@query(
    """select cast(n_nationkey as varchar) as key, 'nation' as source, n_nationkey as seq, n_name as artist, null::varchar as title from nation
union all select cast(r_regionkey as varchar), 'region', r_regionkey + (1::bigint << 40), null, r_name from region"""
)
def collected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in order, an empty one replaced by its fallback."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_nationkey").cast("long").alias("seq"), F.col("n_name").alias("artist"))
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("key"), F.col("r_regionkey").cast("long").alias("seq"), F.col("r_name").alias("title"))
    first = tables.first_with_rows([nation.filter("seq < 0"), nation])
    return tables.collect_sources([("nation", first), ("region", region)]).select("key", "source", "seq", "artist", "title")


@query("select cast(c_custkey as varchar) as title, c_name as artist, null::varchar as lyrics from customer")
def sniffed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"title": ["song", "C_CUSTKEY"], "artist": ["c_name", "singer"], "lyrics": ["text", "lyrics"]}
    return tables.unify_columns(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), names)


@query("select doc_id from documents where doc_id % 3 > 0")
def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return incremental.unprocessed(docs, docs.filter("doc_id % 3 = 0"), "doc_id")


@query("select vec_id as id, label, 'song ' || label as title from embeddings where vec_id in (3, 5, 8, 13, 21)")
def ids_with_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    wanted = spark.createDataFrame([(i,) for i in (3, 5, 8, 13, 21)], "id long")
    songs = rows.select("label").distinct().withColumn("title", F.concat(F.lit("song "), F.col("label").cast("string")))
    return semantic.with_parents(rows.join(wanted, "id", "left_semi"), songs, "label").select("id", "label", "title")


@query("select item_id as query_id, case item_id % 3 when 0 then 'en' when 1 then 'pl' else 'de' end as language from benchmark where item_id % 3 < 2 and item_id % 4 > 0")
def held_out_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("query_id") % 3
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).withColumn("language", F.when(n == 0, "en").when(n == 1, "pl").otherwise("de"))
    return sampling.unused(queries, queries.filter("query_id % 4 = 0"), ["en", "pl"])


@query("select * from (values ('en', [20, 20, 20, 19, 19]), ('pl', [5, 4, 4, 4, 4]), ('de', [3, 3, 3, 3, 2]), ('es', [2, 2, 1, 1, 1])) t(language, per_category)")
def candidate_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(sampling.candidate_plan({"en": 70, "pl": 15, "de": 10, "es": 5}).items()), "language string, per_category array<int>")


@query(
    """with r as (select user_id as query_id, event_id as passage_id, cast(row_number() over (partition by user_id order by value desc, event_id) as integer) as rank from events)
select query_id, rank, passage_id, cast(passage_id % 4 as integer) as grade from r where rank <= 5"""
)
def graded_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = scoring.top_n_per_group(table(spark, sf_dir, "events"), "user_id", [F.desc("value"), F.col("event_id")], 5)
    results = top.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("passage_id"), F.col("rn").alias("rank"))
    grades = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("passage_id"), (F.col("event_id") % 4).cast("int").alias("grade"))
    return evaluate.report(results, grades).select("query_id", F.inline("results"))


@query("select 'v3' as version, max(o_orderkey) filter (o_orderstatus = 'F') as batch from orders")
def credibility_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "v3").otherwise("v2").alias("version"), F.col("o_orderkey").alias("batch"))
    return judge.credible_stats(report, "v3").select("version", "batch")


@query("select p_partkey, cast(p_partkey as varchar) || '|' || cast(p_size as varchar) as key, 'm::v2+3shot' as signature, p_name || ' tail' as page from part")
def judgment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = text.page_song(F.concat("p_name", F.lit(" tail (2019 song)")))
    return table(spark, sf_dir, "part").select("p_partkey", text.judgment_key(F.col("p_partkey"), F.col("p_size")).alias("key"), F.lit(text.judge_signature("m", "v2", 3)).alias("signature"), page.alias("page"))


@query(
    f"""with {_ENTRIES} select source, year, count(*) as n from entries where source in ({", ".join(f"'{s}'" for s in _WEIGHTS)}) group by 1, 2
except select 'src0', year, count(*) from entries where source = 'src0' group by 2"""
)
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = entries(spark, sf_dir).filter(F.col("source").isin(*_WEIGHTS)).groupBy("source", "year").agg(F.count("*").alias("n"))
    return counts.exceptAll(counts.filter("source = 'src0'"))


@query(
    """with l as (select p_partkey, 0 as pos, p_name as query from part union all select p_partkey, 1, p_type from part), f as (select *, row_number() over (partition by lower(query) order by p_partkey, pos) as rn from l)
select 'raw_' || lpad(cast(row_number() over (order by p_partkey, pos) as varchar), 4, '0') as raw_id, 'en' as language, cast(p_partkey % 5 as integer) as category, query from f where rn = 1"""
)
def generated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("Here they are:\n1. "), F.col("p_name"), F.lit("\n- \""), F.col("p_type"), F.lit("\"\n"))
    replies = table(spark, sf_dir, "part").select("p_partkey", F.lit("en").alias("language"), (F.col("p_partkey") % 5).cast("int").alias("category"), body.alias("body"))
    return sampling.candidates_of(replies, ["p_partkey"])


@query("select p_name as title, p_brand as artist_raw, 2021 as year, 1983 as original_year from part where p_partkey % 3 = 0")
def viral_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("p_partkey") % 3 == 0, "It went viral on TikTok in 2021.").otherwise("No one noticed.")
    intro = F.concat(F.lit("\"X\" is a song by the American singer "), F.col("p_brand"), F.lit(", released in 1983. "), end)
    return charts.viral_songs(table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" (Some Band song)")).alias("page_title"), intro.alias("intro")))


@query("select p_partkey, 'Grade: ' || p_size as ending, true as starts from part")
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of the prompt starts with its rules; examples stand between them and the request."""
    shots = text.graded_examples([("rain", "drops fall", 3)])
    prompts = [text.judge_prompt(F.col("p_name"), F.concat(F.lit("Grade: "), F.col("p_size").cast("string")), shots, v) for v in text.PROMPTS]
    starts = [p.startswith(rules + "\n\n" + shots) for p, rules in zip(prompts, text.PROMPTS.values(), strict=True)]
    return table(spark, sf_dir, "part").select("p_partkey", F.substring_index(prompts[-1], "\n", -1).alias("ending"), (starts[0] & starts[1] & starts[2]).alias("starts"))
