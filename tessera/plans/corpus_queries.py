"""Queries that assemble a corpus: deduplication, merging, scoring, ingest.

Charts are made of the star schema: a part is a song (its brand the artist),
an order's supplier the source, its lines the entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import checks, dedup, ingest, sampling, scoring
from tessera.plans.registry import query
from tessera.plans.text_queries import KEY
from tessera.storage import table

_WEIGHTS = {"src0": 1.0, "src1": 0.7, "src2": 0.5}
_WEIGHT_SQL = "case source when 'src0' then 1.0 when 'src1' then 0.7 when 'src2' then 0.5 else 0.4 end"
_ENTRIES = """entries as (select ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey as seq, 'src' || l_suppkey % 4 as source, cast(year(l_shipdate) as integer) as year, 'k' || l_partkey % 500 as key,
  'Artist ' || l_partkey % 500 as artist, case when l_linenumber % 3 = 0 then 'Guest ' || l_suppkey % 10 end as featured_artists, 'Song ' || l_partkey % 500 as title,
  cast(l_quantity as integer) as rank, case when l_linenumber % 2 = 0 then cast(1960 + l_suppkey % 60 as integer) end as original_year, 'g' || l_suppkey % 3 as genre from lineitem)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart entries with an order of arrival."""
    named = lambda prefix, c, n: F.concat(F.lit(prefix), (F.col(c) % n).cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("seq"), named("src", "l_suppkey", 4).alias("source"), F.year("l_shipdate").alias("year"),
        named("k", "l_partkey", 500).alias("key"), named("Artist ", "l_partkey", 500).alias("artist"),
        F.when(F.col("l_linenumber") % 3 == 0, named("Guest ", "l_suppkey", 10)).alias("featured_artists"), named("Song ", "l_partkey", 500).alias("title"),
        F.col("l_quantity").cast("int").alias("rank"), F.when(F.col("l_linenumber") % 2 == 0, (1960 + F.col("l_suppkey") % 60).cast("int")).alias("original_year"),
        named("g", "l_suppkey", 3).alias("genre"),
    )


@query(f"select doc_id, key from (select doc_id, {KEY('text')} as key, row_number() over (partition by {KEY('text')} order by doc_id) as rn from documents) where rn = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").select("doc_id", text.normalize_key(F.col("text")).alias("key"))
    return dedup.keep_first(keyed, ["key"], [F.col("doc_id")])


_TIERS = f"keyed as (select doc_id, source, {KEY('text')} as key from documents), a as (select * from keyed where source in ('src0', 'src1')), b as (select * from keyed where source = 'src2')"


def _tiers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    keyed = table(spark, sf_dir, "documents").select("doc_id", "source", text.normalize_key(F.col("text")).alias("key"))
    early = keyed.filter(F.col("source").isin("src0", "src1"))
    return early, keyed.filter("source = 'src2'"), keyed.filter(~F.col("source").isin("src0", "src1", "src2"))


@query(f"with {_TIERS} select doc_id, key from keyed where source not in ('src0', 'src1', 'src2') and key not in (select key from a) and key not in (select key from b)")
def prior_key_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, rest = _tiers(spark, sf_dir)
    return dedup.exclude_prior(rest, [("a", a), ("b", b)]).select("doc_id", "key")


@query(
    f"""with {_TIERS} select case when key in (select key from a) then 'a' else 'b' end as "set", count(*) as removed from keyed
where source not in ('src0', 'src1', 'src2') and (key in (select key from a) or key in (select key from b)) group by 1"""
)
def prior_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, rest = _tiers(spark, sf_dir)
    return dedup.exclusion_counts(rest, [("a", a), ("b", b)])


_VERSIONS = f"""songs as (select p_partkey, {KEY("p_brand")} as artist_key, p_name || case p_partkey % 3 when 0 then ' (Live)' when 1 then ' [Remix]' else '' end as title from part),
keyed as (select *, artist_key || '|||' || {KEY("title")} as key, p_partkey % 3 < 2 as alt from songs)"""


@query(
    rf"""with {_VERSIONS} select p_partkey, title from keyed where not alt
  or artist_key || '|||' || {KEY(r"regexp_replace(title, '\s*[\(\[][^\)\]]*[\)\]]\s*$', '')")} not in (select key from keyed where not alt)"""
)
def variant_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 3
    title = F.concat("p_name", F.when(n == 0, " (Live)").when(n == 1, " [Remix]").otherwise(""))
    songs = table(spark, sf_dir, "part").select("p_partkey", text.normalize_key(F.col("p_brand")).alias("artist_key"), title.alias("title"))
    keyed = songs.withColumn("key", F.concat("artist_key", F.lit("|||"), text.normalize_key(F.col("title"))))
    return dedup.drop_variants(keyed, text.is_alternative(F.col("title"))).select("p_partkey", "title")


@query(
    f"""with {_ENTRIES} select key, arg_min(artist, seq) filter (source = 'src2' or key not in (select key from entries where source = 'src2')) as artist,
  arg_min(title, seq) filter (source = 'src2' or key not in (select key from entries where source = 'src2')) as title,
  arg_min(featured_artists, -length(featured_artists)::hugeint * 1000000000000000000 + seq) filter (featured_artists is not null) as featured_artists,
  arg_min(original_year, seq) filter (original_year is not null) as year,
  array_to_string([s for s in ['src1', 'src0', 'src3', 'src2'] if list_contains(list(distinct source), s)], ', ') as source, min(rank) as source_rank from entries group by key"""
)
def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir).withColumn("year", F.col("original_year")).withColumn("source_rank", F.col("rank"))
    return scoring.merge_canonical(rows, "src2", ("src1", "src0", "src3", "src2"))


_DECADES = """select cast(floor(year / 10) * 10 as integer) || 's' as decade, key, cast(sum(101 - rank) as bigint) as decade_score, arg_min(artist, rank::hugeint * 1000000000000000000 + seq) as artist,
  arg_min({'f': featured_artists}, rank::hugeint * 1000000000000000000 + seq).f as featured_artists, arg_min(title, rank::hugeint * 1000000000000000000 + seq) as title, arg_min(year, rank::hugeint * 1000000000000000000 + seq) as year from entries group by 1, 2"""


@query(f"with {_ENTRIES} {_DECADES}")
def decade_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.decade_points(entries(spark, sf_dir))


@query(
    f"""with {_ENTRIES}, d as ({_DECADES}), ranked as (select *, cast(row_number() over (partition by decade order by decade_score desc, key) as integer) as rn from d)
select decade, key, decade_score, rn from ranked where rn <= case decade when '1990s' then 180 when '2000s' then 20 else 0 end"""
)
def decade_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.decade_points(entries(spark, sf_dir))
    return scoring.top_per_group(scored, "decade", [F.desc("decade_score"), F.col("key")], {"1990s": 180, "2000s": 20}).select("decade", "key", "decade_score", "rn")


@query(
    f"""with {_ENTRIES}, scored as (select *, (count(*) over (partition by source, year) + 1 - rank) / cast(count(*) over (partition by source, year) as double) * {_WEIGHT_SQL} as score from entries),
firsts as (select distinct on (year, key, source) year, key, source, seq from scored order by year, key, source, seq),
named as (select year, key, string_agg(source, ', ' order by seq) as source from firsts group by 1, 2),
merged as (select year, key, sum(score) as combined_score, arg_min(artist, seq) as artist, arg_min(title, seq) as title, arg_min(featured_artists, seq) filter (featured_artists is not null) as featured_artists, min(seq) as seq from scored group by 1, 2),
ranked as (select m.*, n.source, row_number() over (partition by m.year order by round(combined_score, 9) desc, seq) as rn from merged m join named n using (year, key))
select year, key, round(combined_score, 6) as combined_score, artist, title, featured_artists, source, cast(rn as integer) as rn from ranked where rn <= 420"""
)
def year_union_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.year_union(entries(spark, sf_dir), _WEIGHTS, 0.4, 420)
    return out.drop("seq").withColumn("combined_score", F.round("combined_score", 6))


@query(
    f"""with {_ENTRIES}, e as (select *, case when source = 'src3' then null else rank end as r from entries),
placed as (select *, sum(case when r is null then 1 else 0 end) over (partition by source, genre order by seq rows unbounded preceding) as place from e),
scored as (select *, case when r is null then greatest(0.01, (151 - place) / 150.0) else (50 + 1 - r) / 50.0 end * {_WEIGHT_SQL.replace("0.4", "0.5")} as score from placed),
firsts as (select distinct on (key, source) key, source, seq from scored order by key, source, seq), named as (select key, string_agg(source, ', ' order by seq) as source from firsts group by 1)
select key, round(sum(score), 6) as combined_score, arg_min(artist, seq) as artist, arg_min(title, seq) as title, arg_min(featured_artists, seq) filter (featured_artists is not null) as featured_artists,
  arg_min(genre, seq) as genre, arg_min(original_year, seq) filter (original_year is not null) as year, any_value(n.source) as source from scored join named n using (key) group by key"""
)
def genre_union_implicit_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir).withColumn("rank", F.when(F.col("source") != "src3", F.col("rank"))).withColumn("list_length", F.lit(50)).withColumn("year", F.col("original_year"))
    return scoring.genre_union(rows, _WEIGHTS, 0.5).withColumn("combined_score", F.round("combined_score", 6))


@query(
    f"""with {_ENTRIES}, e as (select *, case when seq % 5 = 0 then null else year end as y, case source when 'src0' then 3 when 'src1' then 1 when 'src2' then 2 else 0 end as p from entries),
h as (select *, min(seq) over (partition by key) as first_seq, first_value(p) over (partition by key order by seq) as held from e),
firsts as (select distinct on (key, source) key, source, seq from e order by key, source, seq), named as (select key, string_agg(source, ', ' order by seq) as source from firsts group by 1),
m as (select key, round(sum((50 + 1 - rank) / 50.0 * {_WEIGHT_SQL.replace("0.4", "0.5")}), 6) as combined_score, arg_min(artist, seq) as artist, arg_min(title, seq) as title,
  arg_min(featured_artists, seq) filter (featured_artists is not null) as featured_artists,
  arg_max({{'y': y}}, p::hugeint * 1000000000000000000 - seq) filter (seq = first_seq or (y is not null and p > held)) as year, arg_min(original_year, seq) filter (original_year is not null) as oy from h group by key)
select key, combined_score, artist, title, featured_artists, year.y as year, case when oy is distinct from year.y then oy end as original_year, n.source from m join named n using (key)"""
)
def priority_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir).withColumn("year", F.when(F.col("seq") % 5 != 0, F.col("year"))).withColumn("norm_score", text.rank_score(F.col("rank"), F.lit(50)))
    out = scoring.viral_union(rows, _WEIGHTS, {"src0": 3, "src1": 1, "src2": 2}, 0.5)
    return out.withColumn("combined_score", F.round("combined_score", 6))


@query(
    f"""with {_ENTRIES}, c as (select year, key, count(*) as weeks, min(seq) as seq from entries group by 1, 2),
r as (select *, row_number() over (partition by year order by weeks desc, seq) as rank, count(*) over (partition by year) as songs from c) select year, key, weeks, cast(rank as integer) as rank from r where songs >= 5"""
)
def number_one_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.weeks_at_top(entries(spark, sf_dir), "year")


@query(
    "select event_id, event_type, rank() over (partition by event_type order by user_id) + (count(*) over (partition by event_type, user_id) - 1) / 2.0::double as avg_rank from events"
)
def avg_tie_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.average_rank(table(spark, sf_dir, "events"), "event_type", "user_id").select("event_id", "event_type", "avg_rank")


@query(
    """select conv_id, turn, role, last_value(case when role = 'user' then text end ignore nulls) over (partition by conv_id order by turn, role, text rows unbounded preceding) as filled from conversations"""
)
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("role") == "user", F.col("text"))
    return scoring.forward_fill(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], value).select("conv_id", "turn", "role", "filled")


@query(
    f"""with keyed as (select doc_id, lang, source, {KEY("text")} as key, case source when 'src5' then 0 when 'src3' then 1 else 2 end as tier from documents where source in ('src5', 'src3', 'src1')),
r as (select *, row_number() over (partition by key order by tier, doc_id) as rn from keyed)
select doc_id, case when tier = 1 then null else lang end as lang, case tier when 0 then 'canonical' when 1 then 'decades' else 'recent' end as tier, key from r where rn = 1"""
)
def seed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("seq"), "lang", "source", text.normalize_key(F.col("text")).alias("key"))
    tiers = [("canonical", keyed.filter("source = 'src5'")), ("decades", keyed.filter("source = 'src3'").drop("lang")), ("recent", keyed.filter("source = 'src1'"))]
    return dedup.merge_seed([(n, df.drop("source")) for n, df in tiers], ["doc_id", "lang"])


@query(
    """with j as (select d.doc_id, d.lang, l.quality, l.toxic from documents d left join labels l using (doc_id)),
u as (select 'lang' as "column", count(*) - count(lang) as nulls, count(*) as n from j union all select 'quality', count(*) - count(quality), count(*) from j union all select 'toxic', count(*) - count(toxic), count(*) from j)
select "column", nulls, round(100.0::double * nulls / n, 1) as pct from u"""
)
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return ingest.null_profile(joined, ["lang", "quality", "toxic"])


@query("select source, count(*) as total, count(quality) as found, round(100.0::double * count(quality) / count(*), 1) as pct from documents left join labels using (doc_id) group by 1")
def coverage_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return ingest.coverage(joined, "source", F.col("quality").isNotNull())


@query("select lang, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 1) as pct from documents group by 1")
def language_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.distribution(table(spark, sf_dir, "documents"), "lang")


@query(
    """select o_orderkey, coalesce(a.v, b.v, c.v) as value, case when a.v is not null then 'priority' when b.v is not null then 'status' when c.v is not null then 'customer' end as value_source from orders
left join (select o_orderkey, o_orderpriority as v from orders where o_orderkey % 3 = 0) a using (o_orderkey) left join (select o_orderkey, o_orderstatus as v from orders where o_orderkey % 2 = 0) b using (o_orderkey)
left join (select o_orderkey, 'c' || o_custkey as v from orders where o_orderkey % 5 = 0) c using (o_orderkey)"""
)
def waterfall_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    take = lambda n, v: orders.filter(F.col("o_orderkey") % n == 0).select("o_orderkey", v.alias("value"))
    sources = [("priority", take(3, F.col("o_orderpriority"))), ("status", take(2, F.col("o_orderstatus"))), ("customer", take(5, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))))]
    return ingest.waterfall(orders.select("o_orderkey"), sources, "o_orderkey", "value")


@query("select o_custkey, min(o_orderkey) as o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING') group by 1")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return ingest.insert_ignore(target, table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")])


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def missing_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.missing_children(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("select c_custkey, coalesce((select max(o_orderpriority) from orders where o_custkey = c_custkey), c_mktsegment) as c_mktsegment from customer")
def keyed_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_mktsegment"))
    return ingest.update_column(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), changes, ["c_custkey"], "c_mktsegment")


@query(
    f"""with seed as (select doc_id, {KEY("text")} as key from documents where source <> 'src0'), source as (select {KEY("text")} as key, text, row_number() over (partition by {KEY("text")} order by doc_id) as rn from documents where source = 'src0')
select s.doc_id, nullif(trim(o.text), '') as found from seed s left join source o on o.key = s.key and rn = 1"""
)
def lyrics_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").select("doc_id", "source", text.normalize_key(F.col("text")).alias("key"), F.col("text").alias("lyrics"))
    return ingest.lookup_lyrics(keyed.filter("source <> 'src0'").select("doc_id", "key"), keyed.filter("source = 'src0'"), [F.col("doc_id")]).select("doc_id", "found")


@query(
    f"""with k as (select distinct {KEY("text")} as key from documents where source <> 'src0'), s as (select distinct {KEY("text")} as key from documents where source = 'src0')
select count(*) as keys, count(*) filter (key in (select key from s)) as hits, (select list(key order by key) from (select key from k where key not in (select key from s) order by key limit 5)) as missed from k"""
)
def dataset_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").select("source", text.normalize_key(F.col("text")).alias("key"))
    return ingest.source_hits(keyed.filter("source <> 'src0'"), keyed.filter("source = 'src0'"))


@query(
    """select 'row_count' as "check", count(*) between 100 and 10000000 as ok, count(*) as detail from documents
union all select 'no_duplicates', count(*) = 0, count(*) from (select text from documents group by 1 having count(*) > 1)
union all select 'group_floor', count(*) = 0, count(*) from (select source from documents group by 1 having count(*) < 5)
union all select 'required_values', count(*) filter (text is null) + count(*) filter (lang is null) = 0, count(*) filter (text is null) + count(*) filter (lang is null) from documents
union all select 'no_overlap', count(*) = 0, count(*) from documents where text in (select text from benchmark)"""
)
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.checks(table(spark, sf_dir, "documents"), "text", "source", (100, 10_000_000), 5, ["text", "lang"], table(spark, sf_dir, "benchmark").select("text"))


@query(
    """with r as (select doc_id, lang, row_number() over (partition by lang order by (doc_id * 7919 + 7) % 104729, doc_id) as rn from documents)
select doc_id, lang from r where rn <= case lang when 'en' then 20 when 'fr' then 5 when 'de' then 3 else 2 end"""
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [sampling.arithmetic_key("doc_id", 7), F.col("doc_id")]
    return sampling.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", {"en": 20, "fr": 5, "de": 3, "es": 2}, order)


@query(
    """with u as (select distinct lower(c_mktsegment) as v from customer) select 'raw_' || lpad(cast(row_number() over (order by v) as varchar), 4, '0') as id, v as segment from u"""
)
def numbered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = dedup.first_seen(table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("segment"), "c_custkey"), "segment", [F.col("c_custkey")])
    return sampling.numbered(seen, "raw", 4, [F.col("segment")]).select("id", "segment")


@query(
    """select user_id, event_id, cast(rn as integer) as rn from (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as rn from events) where rn <= 5"""
)
def artist_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.top_n_per_group(table(spark, sf_dir, "events"), "user_id", [F.desc("value"), F.col("event_id")], 5).select("user_id", "event_id", "rn")
