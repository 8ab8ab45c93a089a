"""Queries over single texts: names, keys, lyrics, years, passages, HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import chunk, html
from tessera.plans.registry import query
from tessera.storage import table

_WS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1c-\x1f]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _key(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({_strip(f'lower({x})')}, '^the ', ''), '[^\\p{{L}}\\p{{M}}\\p{{N}}_{_WS[1:-1]}]', '', 'g')"
    return _strip(f"regexp_replace({bare}, '{_WS}+', ' ', 'g')")


KEY = _key


@query(f"select doc_id, {_key('text')} as key from documents")
def normalize_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_key(F.col("text")).alias("key"))


@query(f"select p_partkey, {_key('p_brand')} || '|||' || {_key('p_name')} as key from part")
def dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.dedup_key(F.col("p_brand"), F.col("p_name")).alias("key"))


@query(
    rf"""select doc_id, {_strip("regexp_replace(regexp_replace(regexp_replace(" + _strip("text") + r", '(?s)^\d+\s+Contributors.*?Lyrics\s*', ''), '(?m)^\[.+?\]\s*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} as cleaned from documents"""
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_lyrics(F.col("text")).alias("cleaned"))


# Artist credits of every kind, made of parts' brands and types.
_CREDIT = """case p_partkey % 7 when 0 then p_brand || ' (feat. ' || p_type || ' & ' || p_name || ')'
 when 1 then p_brand || ' ft. ' || p_type || ' and ' || p_name when 2 then p_brand || ', ' || p_type || ' & ' || p_name
 when 3 then p_brand || ' & ' || p_type when 4 then 'Earth, Wind & Fire' when 5 then p_brand || ' WITH ' || p_name else '  ' || p_brand || '  ' end"""
_FEAT = r"(?:feat\.?|ft\.?|featuring|w/|with)"


def _names(x: str) -> str:
    return f"nullif(array_to_string([y for y in [trim(z) for z in regexp_split_to_array({x}, '\\s*(?:[&,]|\\band\\b)\\s*')] if y <> ''], ', '), '')"


@query(
    rf"""with credits as (select p_partkey, trim({_CREDIT}) as raw from part), kinds as (
  select *, regexp_matches(raw, '(?is)^(.+?)\s*\(\s*{_FEAT}\s+(.+?)\s*\)\s*$') as a, regexp_matches(raw, '(?i)^(.+?)\s+{_FEAT}\s+(.+)$') as b,
    lower(raw) = 'earth, wind & fire' as band, contains(raw, ',') as c from credits)
select p_partkey, trim(case when a then regexp_extract(raw, '(?is)^(.+?)\s*\(\s*{_FEAT}\s+(.+?)\s*\)\s*$', 1)
    when b then regexp_extract(raw, '(?i)^(.+?)\s+{_FEAT}\s+(.+)$', 1) when band then raw when c then split_part(raw, ',', 1) else raw end) as artist,
  case when a then {_names(rf"regexp_extract(raw, '(?is)^(.+?)\s*\(\s*{_FEAT}\s+(.+?)\s*\)\s*$', 2)")}
    when b then {_names(rf"regexp_extract(raw, '(?i)^(.+?)\s+{_FEAT}\s+(.+)$', 2)")}
    when band then null when c then {_names("substr(raw, position(',' in raw) + 1)")} end as featured from kinds"""
)
def featured_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "part").withColumn("credit", F.expr(_CREDIT)).select("p_partkey", text.parse_artist(F.col("credit")).alias("a"))
    return parsed.select("p_partkey", F.col("a.primary").alias("artist"), "a.featured")


@query(
    r"""select p_partkey, array_to_string([upper(substr(w, 1, 1)) || lower(substr(w, 2)) for w in regexp_extract_all(upper(p_name || '-' || p_type), '\p{L}+|[^\p{L}]+')], '') as title from part"""
)
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    shouted = F.upper(F.concat_ws("-", "p_name", "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", text.fix_capitals(shouted).alias("title"))


@query(rf"select conv_id, turn, role, {_strip('text')} as line from conversations")
def strip_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = F.concat(F.lit("[01:23.45] "), F.regexp_replace("text", "\n", "\n[02:03:04] "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.strip_timestamps(stamped).alias("line"))


@query("select doc_id, replace(left(text, 200), chr(10), ' / ') as snippet from documents")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query(
    r"""select page_id, try_cast(nullif(regexp_extract(html, '\b(?:19|20)\d{2}\b', 0), '') as integer) as year,
  cast(cast(floor((1950 + page_id % 70) / 10) * 10 as integer) as varchar) || 's' as decade from pages"""
)
def year_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = (F.lit(1950) + F.col("page_id") % 70).cast("int")
    return table(spark, sf_dir, "pages").select("page_id", text.first_year(F.col("html")).alias("year"), text.decade(made).alias("decade"))


@query(
    r"""select conv_id, turn, role, try_cast(list_last(regexp_extract_all(text || ' ' || turn, '\b([0-3])\b', 1)) as integer) as grade from conversations"""
)
def parse_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat_ws(" ", "text", F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.parse_grade(reply).alias("grade"))


@query(
    rf"""with lines as (select doc_id, unnest(string_split(text, chr(10))) as line from documents), cleaned as (
  select doc_id, {_strip("regexp_replace(" + _strip("regexp_replace(line, '^\\s*(?:[-*•]|\\d+[.)])\\s*', '')") + ", '\\.+$', '')")} as candidate from lines where not regexp_matches(line, '["''“‘”’]'))
select doc_id, candidate, count(*) as n from cleaned where candidate <> '' and not ends_with(candidate, ':') and len(regexp_split_to_array(candidate, '{_WS}+')) <= 20 group by 1, 2"""
)
def candidate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(~F.col("line").rlike("[\"'“‘”’]"))
    return lines.select("doc_id", F.explode(text.query_lines(F.col("line"))).alias("candidate")).groupBy("doc_id", "candidate").agg(F.count("*").alias("n"))


@query(
    r"""select p_partkey, regexp_matches(t, '(?i)\b(live|remix|acoustic|demo|instrumental|reprise|radio\s+edit)\b') as alternative,
  regexp_matches(t, '(?i)\b(sped[\s\-]?up|slowed[\s\-]?(down)?|nightcore|reverb[\s\-]?ed|pitched[\s\-]?up)\b') as sped_up,
  regexp_matches(t, '(?i)\b(remix|rmx|edit|live|acoustic|demo|instrumental|remaster(ed)?|version|rework|re[\s\-]?recorded)\b|\bmix($|[^\-\p{L}\p{N}_]|-($|[^\p{L}\p{N}_]))') as variant
from (select p_partkey, p_name || case p_partkey % 6 when 0 then ' (Live)' when 1 then ' - Sped Up' when 2 then ' Mix-Up' when 3 then ' Mix' when 4 then ' demon' else '' end as t from part)"""
)
def title_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 6
    end = F.when(n == 0, " (Live)").when(n == 1, " - Sped Up").when(n == 2, " Mix-Up").when(n == 3, " Mix").when(n == 4, " demon").otherwise("")
    title = F.concat("p_name", end)
    flags = [text.is_alternative(title).alias("alternative"), text.is_sped_up(title).alias("sped_up"), text.is_variant(title).alias("variant")]
    return table(spark, sf_dir, "part").select("p_partkey", *flags)


# Blank lines stand in for verses, which the texts don't have: every seventh line is emptied.
_LINES = "[case when i % 7 = 0 then '' else l[i] end for i in range(1, len(l) + 1)]"
PASSAGES_SQL = rf"""base as (select doc_id, string_split(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) as l from documents where text is not null),
blanked as (select doc_id, {_LINES} as l, len(l) as n from base),
starts as (select doc_id, l, n, unnest(range(0, n, 6)) as s from blanked),
wins as (select *, coalesce(list_min([j for j in range(s + 5, least(s + 8, n)) if trim(l[j + 1]) = '']), least(s + 8, n)) as e from starts),
marked as (select *, lead(s) over w as next_s, lead(e) over w as next_e, lead(s, 2) over w as later, lag(s) over w as prev_s from wins window w as (partition by doc_id order by s)),
joined as (select doc_id, l, s, case when next_s is not null and later is null and len([x for x in l[next_s + 1:next_e] if trim(x) <> '']) < 4 then next_e else e end as e,
  next_s is null and prev_s is not null and len([x for x in l[s + 1:e] if trim(x) <> '']) < 4 as gone from marked),
passages as (select doc_id, array_to_string([x for x in l[s + 1:e] if trim(x) <> ''], chr(10)) as passage_text, cast(s as integer) as start_line, cast(e as integer) as end_line
  from joined where not gone and length(array_to_string([x for x in l[s + 1:e] if trim(x) <> ''], chr(10))) >= 50)"""


def passages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.split(F.regexp_replace("text", "\n{3,}", "\n\n"), "\n", -1), lambda x, i: F.when((i + 1) % 7 == 0, "").otherwise(x))
    # Emptied lines may touch: the chunker would join three line ends, so none do here.
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))
    return chunk.chunk_passages(docs, "doc_id", "text")


@query(f"with {PASSAGES_SQL} select * from passages")
def chunk_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages_of(spark, sf_dir)


@query(
    f"""with {PASSAGES_SQL}, per as (select d.doc_id, count(p.passage_text) as n, sum(length(p.passage_text)) as chars, min(length(p.passage_text)) as low, max(length(p.passage_text)) as high
  from documents d left join passages p using (doc_id) group by 1)
select count(*) as texts, cast(sum(n) as bigint) as passages, round(avg(n), 4) as avg_passages, min(n) as min_passages, max(n) as max_passages, round(sum(chars) / sum(n), 4) as avg_chars,
  cast(min(low) as integer) as min_chars, cast(max(high) as integer) as max_chars, count(*) filter (n = 0) as without from per"""
)
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_stats(table(spark, sf_dir, "documents"), passages_of(spark, sf_dir), "doc_id")


@query(
    r"""with found as (select page_id as id, regexp_extract_all(coalesce(html, ''), '<li>([^<]*(?:<a [^>]*>[^<]*</a>)?[^<]*)</li>', 1) as items from pages)
select id, cast(i - 1 as integer) as item_no, regexp_replace(items[i], '<[^>]*>', '', 'g') as item from (select id, items, unnest(range(1, len(items) + 1)) as i from found)"""
)
def html_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.list_items(table(spark, sf_dir, "pages"), "page_id", "html")


# A chart page for each order: a heading with the year, and rows with spans.
_ROW = "'<tr><td>' || l_linenumber || '</td><td>\"Part ' || l_partkey || '\"</td><td>Supplier ' || l_suppkey || '</td></tr>'"


@query(
    """select l_orderkey as id, l_linenumber as rank, 'Part ' || l_partkey as title, 'Supplier ' || l_suppkey as artist_raw, 2000 + cast(l_orderkey % 20 as integer) as year
from lineitem where l_orderkey in (select l_orderkey from lineitem group by 1 having count(*) >= 3)"""
)
def html_chart_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.expr(_ROW).alias("h")).alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["h"]), "")
    head = F.concat(F.lit("<h2>Year "), (2000 + F.col("l_orderkey") % 20).cast("string"), F.lit("</h2><table><tr><th>No.</th><th>Title</th><th>Artist(s)</th></tr>"))
    pages = rows.groupBy("l_orderkey").agg(body.alias("b")).select("l_orderkey", F.concat(head, "b", F.lit("</table>")).alias("html"))
    found = html.year_of_rows(html.tables(pages, "l_orderkey", "html"))
    chart = html.chart_rows(found, 3)
    years = found.select("id", "row_no", "year")
    return chart.join(years, ["id", "row_no"]).select("id", "rank", "title", "artist_raw", "year")


_CELL = "' \"' || p_name || '\"[1]  (x)/' || p_type || ' [note] '"


@query(
    rf"""with c as (select p_partkey, {_CELL} as raw from part), d as (select p_partkey, raw, {_strip(f"regexp_replace(regexp_replace(raw, '[[].*?[]]', '', 'g'), '{_WS}+', ' ', 'g')")} as cell from c)
select p_partkey, cell, {_strip("regexp_replace(cell, '^[\"“”]+|[\"“”]+$', '', 'g')")} as unquoted, {_strip("split_part(raw, '/', 1)")} as first_side,
  {_strip(r"regexp_replace(raw, '\s*[\(\[][^\)\]]*[\)\]]\s*$', '')")} as without_bracket from d"""
)
def cell_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    cells = [text.clean_cell(raw).alias("cell"), text.clean_cell(raw, True).alias("unquoted"), text.first_side(raw).alias("first_side"), text.strip_bracket(raw).alias("without_bracket")]
    return table(spark, sf_dir, "part").withColumn("raw", F.expr(_CELL)).select("p_partkey", *cells)


@query(
    """select p_partkey, 101 - p_size as points, (50 + 1 - p_size) / 50.0::double as score, greatest(0.01::double, (151 - p_partkey % 300) / 150.0::double) as implicit,
  case when p_retailprice / 1500 > 0.75 then 'strong' when p_retailprice / 1500 >= 0.60 then 'acceptable' when p_retailprice / 1500 >= 0.40 then 'weak' else 'unusable' end as reads from part"""
)
def rank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = [
        text.chart_points(F.col("p_size")).alias("points"), text.rank_score(F.col("p_size"), F.lit(50)).alias("score"),
        text.implicit_score(F.col("p_partkey") % 300).alias("implicit"), text.agreement_band(F.col("p_retailprice") / 1500).alias("reads"),
    ]
    return table(spark, sf_dir, "part").select("p_partkey", *scores)


_INTRO = "'\"' || p_name || '\" is a song by the British band ' || p_brand || ', released in ' || case p_partkey % 3 when 0 then 'May 1971' when 1 then '1983' else '1888' end || '. It went viral on TikTok' || case p_partkey % 2 when 0 then ' in 2021.' else ' soon after 2020.' end"


@query(
    """select p_partkey, p_brand as artist, cast(case p_partkey % 3 when 0 then 1971 when 1 then 1983 else case when p_partkey % 2 = 0 then 2021 else 2020 end end as integer) as released,
  cast(case when p_partkey % 2 = 0 then 2021 else 2020 end as integer) as viral from part"""
)
def article_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    intro = F.col("intro")
    facts = [text.intro_artist(intro).alias("artist"), text.release_year(intro).alias("released"), text.viral_year(intro).alias("viral")]
    return table(spark, sf_dir, "part").withColumn("intro", F.expr(_INTRO)).select("p_partkey", *facts)
