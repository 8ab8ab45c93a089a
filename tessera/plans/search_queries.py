"""Queries that search: by vector, by word, and both."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import snowball
from tessera.functions.constants import LIST_DEPTH
from tessera.operators import ann, cover, encode, fusion, graph, inverted, language, lexical, semantic, serve
from tessera.plans.registry import query
from tessera.storage import new_path, persist, shared_dir, table
from tessera.streaming import index_refresh

_SIM = "list_inner_product(e.v, q.v) / (sqrt(list_inner_product(e.v, e.v)) * sqrt(list_inner_product(q.v, q.v)))"
_VECTORS = "e as (select vec_id as id, cast(embedding as double[]) as v, label from embeddings where embedding is not null), q as (select * from e where id = 0)"


def _query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One row's vector: what a caller's encoder would give."""
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("language"), "label")


@query(f"with {_VECTORS} select e.id, round({_SIM}, 6) as score from e, q order by score desc, e.id limit 10")
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.topk(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 10, "id", "embedding").select("id", "score")


@query(f"with {_VECTORS} select e.id, round({_SIM} + case when e.label = 3 then 0.1 else 0.0 end, 6) as score from e, q order by score desc, e.id limit 10")
def semantic_topk_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.topk(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 10, "id", "embedding", "language", "3").select("id", "score")


@query(
    f"""with {_VECTORS.replace("where id = 0", "where id % 20 = 0")}, s as (select q.id as query_id, e.id, round({_SIM} + case when e.label = q.label then 0.1 else 0.0 end, 6) as score from e, q),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) select query_id, id, score, cast(rank as integer) as rank from r where rank <= 10"""
)
def semantic_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    queries = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("language").alias("query_language"))
    return semantic.topk_batch(rows, queries, 10, "id", "embedding")


@query(
    f"""with {_VECTORS}, s as (select e.id, e.label, round({_SIM}, 6) as score from e, q order by score desc, e.id limit 40),
b as (select *, row_number() over (partition by label order by score desc, id) as rn from s)
select id, label, score, cast(row_number() over (order by score desc, id) as integer) as rank from b where rn = 1 order by score desc, id limit 10"""
)
def song_level_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched = semantic.topk(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), semantic.depth(10), "id", "embedding")
    return semantic.best_per_parent(fetched.select("id", "label", "score"), ["label"], [F.desc("score"), F.col("id")], semantic.clamp_k(10))


_SPLIT = r"[x for x in regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}_]+') if x <> '']"
_INDEX = f"""w as (select doc_id as id, {_SPLIT} as t from documents), flat as (select id, len(t) as doc_len, unnest(t) as term from w),
p as (select term, id, count(*) as tf, any_value(doc_len) as doc_len from flat group by 1, 2), qt as (select distinct item_id as query_id, unnest({_SPLIT}) as term from benchmark)"""
_MATCH = """m as (select query_id, id, round(sum(tf) * 0.1::double, 6) as score from p join qt using (term) group by 1, 2),
match as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from m) where rank <= 100)"""
_BM25 = """n as (select count(*) as n_docs, avg(doc_len) as avg_len from (select distinct id, doc_len from p)), df as (select term, count(*) as df from p group by 1),
b as (select query_id, id, round(sum(ln(1 + (n_docs - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * doc_len / avg_len))), 6) as score
  from p join qt using (term) join df using (term), n group by 1, 2),
bm as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from b) where rank <= 100)"""


def _stored(spark: SparkSession, sf_dir: str, stemmed: bool = False, positions: bool = False) -> inverted.Index:
    return inverted.stored(table(spark, sf_dir, "documents"), "doc_id", "text", f"{shared_dir(spark)}/tessera", stemmed, positions)


def _asked(spark: SparkSession, sf_dir: str, stemmed: bool = False) -> DataFrame:
    return persist(lexical.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text", stemmed), "asked")


@query(f"with {_INDEX} select term, id, tf, cast(doc_len as bigint) as doc_len from p")
def postings_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _stored(spark, sf_dir).entries
    return entries.select("term", "id", F.col("tf").cast("long").alias("tf"), F.col("doc_len").cast("long").alias("doc_len"))


@query(f"with {_INDEX}, {_MATCH} select query_id, id, score, cast(rank as integer) as rank from match")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverted.match_topk(_stored(spark, sf_dir), _asked(spark, sf_dir))


@query(f"with {_INDEX}, {_BM25} select query_id, id, score, cast(rank as integer) as rank from bm")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverted.bm25_topk(_stored(spark, sf_dir), _asked(spark, sf_dir))


# The same over stems: words in place, stop words out, each word's stem from the steps of ``snowball.sql``.
_STOP = "(" + ", ".join(f"'{w}'" for w in snowball.STOP_WORDS) + ")"
_PLACED = {t: f"(select {c} as id, unnest(range(len(t))) as pos, unnest(t) as term from (select {c}, {_SPLIT} as t from {t}))" for t, c in (("documents", "doc_id"), ("benchmark", "item_id"))}
_STEMS = f"""dw as (select * from {_PLACED["documents"]} where term not in {_STOP}), qw as (select * from {_PLACED["benchmark"]} where term not in {_STOP}),
voc as (select term from dw union select term from qw), {snowball.sql("voc")},
ds as (select id, pos, stem as term from dw join snow9 using (term)), qs as (select id as query_id, pos, stem as term from qw join snow9 using (term)),
sizes as (select id, count(*) as doc_len from ds group by 1), p as (select term, id, count(*) as tf, any_value(doc_len) as doc_len from ds join sizes using (id) group by 1, 2), qt as (select distinct query_id, term from qs)"""


@query(f"with {_STEMS} select term, stem from snow9")
def stemmed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stem of every word of documents and benchmark."""
    words = [lexical.words(table(spark, sf_dir, t), c, "text").select("term") for t, c in (("documents", "doc_id"), ("benchmark", "item_id"))]
    return snowball.stems(words[0].unionByName(words[1]).filter(~F.col("term").isin(*snowball.STOP_WORDS)).distinct())


@query(f"with {_STEMS}, {_BM25} select query_id, id, score, cast(rank as integer) as rank from bm")
def bm25_topk_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverted.bm25_topk(_stored(spark, sf_dir, stemmed=True), _asked(spark, sf_dir, stemmed=True))


@query(f"with {_STEMS}, {_MATCH} select query_id, id, score, cast(rank as integer) as rank from match")
def cover_any_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V11 for OR queries: each position is a cover of its own."""
    return inverted.match_topk(_stored(spark, sf_dir, stemmed=True), _asked(spark, sf_dir, stemmed=True))


_ALL = f"""{_STEMS}, m as (select query_id, count(*) as m from qt group by 1), e as (
  select query_id, id, pos, term from (select query_id, id from p join qt using (term) join m using (query_id) group by 1, 2, m having count(*) = m) join qt using (query_id) join ds using (id, term))"""
_RANKED_COVERS = "select * from (select query_id, id, score, cast(row_number() over (partition by query_id order by score desc, id) as integer) as rank from s) where rank <= 100"


@query(
    f"""with {_ALL}, x as (select e.query_id, e.id, e.pos, qt.term from e join qt using (query_id)),
l as (select x.query_id, x.id, x.pos as hi, b.pos as last from x asof join e b on x.query_id = b.query_id and x.id = b.id and x.term = b.term and x.pos >= b.pos),
c as (select query_id, id, hi, min(last) as lo from l join m using (query_id) group by 1, 2, 3, m having count(*) = m),
covers as (select query_id, id, lo, min(hi) as hi from c group by 1, 2, 3),
numbered as (select query_id, id, pos, row_number() over (partition by query_id, id order by pos) as no from e),
s as (select c.query_id, c.id, round(sum(0.1::double / (1 + (c.hi - c.lo) - (b.no - a.no))), 6) as score from covers c
  join numbered a on a.query_id = c.query_id and a.id = c.id and a.pos = c.lo join numbered b on b.query_id = c.query_id and b.id = c.id and b.pos = c.hi group by 1, 2)
{_RANKED_COVERS}"""
)
def cover_all_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V11 for AND queries: the texts that have all words of a benchmark text, those that have them closest first."""
    return cover.all_topk(_stored(spark, sf_dir, stemmed=True, positions=True), cover.query_words(table(spark, sf_dir, "benchmark"), "item_id", "text"))


@query(
    f"""with {_ALL}, q as (select query_id, term, pos - min(pos) over (partition by query_id) as off from qs), f as (select query_id, max(off) as span, count(*) as k from q group by 1),
b as (select e.query_id, e.id, e.pos - off as lo, any_value(span) as span from e join q using (query_id, term) join f using (query_id) group by e.query_id, e.id, e.pos - off, k having count(*) = k),
n as (select b.query_id, b.id, b.lo, b.span, count(*) as own from b join e on e.query_id = b.query_id and e.id = b.id and e.pos between b.lo and b.lo + b.span group by 1, 2, 3, 4),
s as (select query_id, id, round(sum(0.1::double / (span - own + 2)), 6) as score from n group by 1, 2)
{_RANKED_COVERS}"""
)
def cover_phrase_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V11 for phrases: the texts in which a benchmark text stands word for word."""
    return cover.phrase_topk(_stored(spark, sf_dir, stemmed=True, positions=True), cover.query_words(table(spark, sf_dir, "benchmark"), "item_id", "text"))


@query(
    f"""with w as (select doc_id as id, {_SPLIT} as t from (select doc_id, case doc_id % 10 when 1 then 'again ' || coalesce(text, '') when 5 then 'fresh words of ' || doc_id else text end as text from documents where doc_id % 10 <> 0)),
flat as (select id, len(t) as doc_len, unnest(t) as term from w) select term, id, count(*) as tf, cast(any_value(doc_len) as bigint) as doc_len from flat group by 1, 2"""
)
def refreshed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs of a stream insert, change and delete texts; the postings are those of an index made of what is left."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 10).alias("d"))
    source, path, checkpoint = (new_path(spark, label) for label in ("changes", "index", "checkpoint"))
    runs = (
        docs.filter("d < 6"),
        docs.filter("d > 4").withColumn("text", F.when(F.col("d") == 5, F.concat(F.lit("fresh words of "), F.col("id").cast("string"))).otherwise(F.col("text"))),
        docs.filter("d < 2").withColumn("text", F.when(F.col("d") == 1, F.concat(F.lit("again "), F.coalesce("text", F.lit(""))))),
    )
    for number, changes in enumerate(runs):
        rows = changes.select("id", "text", F.lit(False).alias("gone"), F.lit(number).cast("long").alias("seq"))
        rows.write.mode("append").parquet(source)
        index = index_refresh.refresh(spark, source, path, checkpoint, compact_over=2)
    return index.entries.select("term", "id", F.col("tf").cast("long").alias("tf"), F.col("doc_len").cast("long").alias("doc_len"))


@query()
def blocks_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: how many blocks of the index each query of ``bm25_topk`` could open, and how many it does."""
    index, terms = _stored(spark, sf_dir), _asked(spark, sf_dir)
    return inverted.opened(index, inverted.bm25_terms(index, terms), inverted.bm25_part(index))


# Vectors of documents and queries: those of the rows of the same number, as far as there are some.
_FUSED = f"""with {_INDEX}, {_MATCH}, {_VECTORS.replace(", q as (select * from e where id = 0)", "")}, q as (select b.item_id as query_id, e.v from benchmark b join e on e.id = b.item_id),
s as (select query_id, e.id, round({_SIM}, 6) as score from e, q), semantic as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from s where score is not null) where rank <= 100),
u as (select query_id, id, rank, 0 as l from semantic union all select query_id, id, rank, 1 from match),
f as (select query_id, id, round(sum(1.0::double / (60 + rank)), 9) as score, min(rank) filter (l = 0) as semantic_rank, min(rank) filter (l = 1) as lexical_rank, min(l * 1000000 + rank) as first from u group by 1, 2),
r as (select *, row_number() over (partition by query_id order by score desc, first, id) as rank from f)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").join(rows, F.col("item_id") == F.col("id"))
    asked = asked.select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.lit(None).cast("string").alias("query_language"))
    semantic_list = semantic.topk_batch(rows, asked, LIST_DEPTH, "id", "embedding")
    return fusion.rrf([("semantic", semantic_list), ("lexical", inverted.match_topk(_stored(spark, sf_dir), _asked(spark, sf_dir)))], by=["query_id"])


@query(f"{_FUSED} select query_id, id, score, cast(semantic_rank as integer) as semantic_rank, cast(lexical_rank as integer) as lexical_rank, cast(rank as integer) as rank from r where rank <= 10")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir)


@query(
    f"{_FUSED} select query_id, id, case when semantic_rank is not null and lexical_rank is not null then 'both' when semantic_rank is not null then 'semantic' else 'lexical' end as dominance from r where rank <= 10"
)
def rrf_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.dominance(_fused(spark, sf_dir), "semantic", "lexical").select("query_id", "id", "dominance")


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, np.ndarray]:
    path = new_path(spark, "vectors")
    centres = ann.build(_vectors(spark, sf_dir), "embedding", path)
    return spark.read.parquet(path), centres


@query(f"with {_VECTORS} select e.id, round({_SIM}, 6) as score from e, q order by score desc, e.id limit 10")
def ann_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lists of the index: what an exact search finds."""
    return ann.topk(*_index(spark, sf_dir), _query_vector(spark, sf_dir), 10, "id", "embedding", share=1.0).select("id", "score")


@query()
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many lists of the index as the rows need for their neighbours."""
    index, centres = _index(spark, sf_dir)
    share = ann.share_for(index, centres, "id", "embedding")
    return ann.topk(index, centres, _query_vector(spark, sf_dir), 10, "id", "embedding", share).select("id", "score")


def _library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Passages and songs made of vectors and their labels."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    passages = _vectors(spark, sf_dir).select("id", F.col("label").alias("song_id"), name(" passage ", "id").alias("passage_text"), "embedding", F.col("embedding").alias("embedding_multi"), "language")
    songs = passages.select(F.col("song_id").alias("id")).distinct()
    return passages, songs.select("id", name("Artist ", "id").alias("artist"), name("Song ", "id").alias("title"), (F.lit(1960) + F.col("id")).cast("int").alias("year"))


@query(
    f"""with {_VECTORS}, s as (select e.id, e.label, round({_SIM}, 6) as score from e, q order by score desc, e.id limit 40), b as (select *, row_number() over (partition by label order by score desc, id) as rn from s)
select cast(row_number() over (order by score desc, id) as integer) as rank, 'Artist ' || label as artist, 'Song ' || label as title, cast(1960 + label as integer) as year, 'passage ' || id as passage, score from b where rn = 1 order by score desc, id limit 10"""
)
def vibe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = np.array([_query_vector(spark, sf_dir)])
    return serve.vibe_search(*_library(spark, sf_dir), "songs like the first", 10, encoder=lambda texts: vector, detect=lambda text: "en")[1]


@query(f"with {_VECTORS}, r as (select e.id, round({_SIM}, 6) as score from e, q) select id, score, cast(row_number() over (order by score desc, id) as integer) as rank from r order by score desc, id limit 10")
def search_twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = np.array([_query_vector(spark, sf_dir)])
    return serve.search(_library(spark, sf_dir)[0], "a twin of the first", "twin", encoder=lambda texts: vector)


@query()
def search_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("passage_text"), "lang")
    passages = encode.embed(docs, "passage_text").withColumnRenamed("lang", "language")
    asked = table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    return serve.search(passages, asked, "find").select("id", "score", "rank", "dominance")


_GRAMS = """spaced as (select doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')) || ' ' as s from documents),
chars as (select doc_id, lang, unnest(string_split(s, '')) as c, generate_subscripts(string_split(s, ''), 1) as i from spaced),
runs as (select doc_id, lang, c as c1, c || lead(c) over w as c2, c || lead(c) over w || lead(c, 2) over w as c3 from chars window w as (partition by doc_id order by i)),
grams as (select * from (select doc_id, lang, unnest([c1, c2, c3]) as gram from runs) where trim(gram) <> ''),
profile as (select lang, gram, r from (select lang, gram, row_number() over (partition by lang order by count(*) desc, gram) as r from grams where lang is not null group by 1, 2) where r <= 300),
own as (select doc_id, gram, r from (select doc_id, gram, row_number() over (partition by doc_id order by count(*) desc, gram) as r from grams group by 1, 2) where r <= 300),
far as (select own.doc_id, l.lang, sum(abs(coalesce(p.r, 300) - own.r)) as far from own cross join (select distinct lang from profile) l left join profile p on p.lang = l.lang and p.gram = own.gram group by 1, 2),
found as (select doc_id, lang as detected from far qualify row_number() over (partition by doc_id order by far, lang) = 1)"""


@query(f"with {_GRAMS} select d.doc_id, d.lang, coalesce(f.detected, 'unknown') as detected from documents d left join found f on f.doc_id = d.doc_id")
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.detect(docs, "doc_id", "text", language.profiles(docs, "text", "lang"), unknown="unknown")
    return docs.select("doc_id", "lang").join(found, "doc_id")


def _hashed_sql(name: str, salt: str) -> str:
    h = f"('0x' || substr(md5('{salt}' || w), 1, 8))::bigint"
    return f"{name} as (select doc_id, {h} % 64 as place, sum(case when {h} // 64 % 2 = 0 then 1 else -1 end)::double as x from words group by 1, 2)"


# The least document of each of two languages is a text to search with; documents are passages, dealt to 90 songs.
@query(
    f"""with {_GRAMS}, words as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as w from documents), {_hashed_sql("base", "")}, {_hashed_sql("multi", "m")},
asked as (select lang as asked, min(doc_id) as q, any_value(detected) as detected from (select d.lang, d.doc_id, f.detected, min(d.doc_id) over (partition by d.lang) as least from documents d left join found f using (doc_id) where d.lang in ('de', 'en')) where doc_id = least group by 1),
v as (select 'base' as kind, * from base union all select 'multi', * from multi), norms as (select kind, doc_id, sqrt(sum(x * x)) as norm from v group by 1, 2),
pick as (select *, case when detected in ('pl', 'de', 'es') then 'multi' else 'base' end as kind, case when detected in ('en', 'pl', 'de', 'es') then detected end as boost from asked),
dots as (select p.asked, p.boost, p.kind, p.q, b.doc_id, sum(a.x * b.x) as dot from pick p join v a on a.kind = p.kind and a.doc_id = p.q join v b on b.kind = p.kind and b.place = a.place group by all),
scored as (select t.asked, t.doc_id, round(t.dot / (m.norm * n.norm) + case when d.lang = t.boost then 0.1 else 0 end, 6) as score, d.text from dots t join norms m on m.kind = t.kind and m.doc_id = t.q join norms n on n.kind = t.kind and n.doc_id = t.doc_id
  join documents d on d.doc_id = t.doc_id where m.norm > 0 and n.norm > 0),
near as (select * from scored qualify row_number() over (partition by asked order by score desc, doc_id) <= 40),
best as (select * from near qualify row_number() over (partition by asked, doc_id % 90 order by score desc, doc_id) = 1)
select asked, cast(row_number() over (partition by asked order by score desc, doc_id) as integer) as rank, 'Artist ' || doc_id % 90 as artist, 'Song ' || doc_id % 90 as title, cast(1960 + doc_id % 90 as integer) as year, trim(text) as passage, score
from best qualify row_number() over (partition by asked order by score desc, doc_id) <= 10"""
)
def vibe_search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in two languages: detected, encoded for the vectors of their route, boosted, one row a song."""
    docs = table(spark, sf_dir, "documents")
    vectors = encode.hashed(docs, "doc_id", "text", "embedding").join(encode.hashed(docs, "doc_id", "text", "embedding_multi", salt="m"), "doc_id")
    passages = persist(docs.join(vectors, "doc_id").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 90).alias("song_id"), F.col("text").alias("passage_text"), F.col("lang").alias("language"), "embedding", "embedding_multi"), "passages")
    song = F.col("song_id").cast("string")
    songs = passages.select("song_id").distinct().select(F.col("song_id").alias("id"), F.concat(F.lit("Artist "), song).alias("artist"), F.concat(F.lit("Song "), song).alias("title"), (1960 + F.col("song_id")).cast("int").alias("year"))

    def encoder(salt: str) -> encode.Encoder:
        def run(texts: list[str]) -> np.ndarray:
            rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
            return np.array([r["v"] for r in encode.hashed(rows, "id", "text", "v", salt=salt).orderBy("id").collect()])

        return run

    detect = language.detector(language.profiles(docs, "text", "lang"))
    asked = docs.filter(F.col("lang").isin("de", "en")).groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).orderBy("lang").collect()  # two rows
    found = [serve.vibe_search(passages, songs, r["text"], 10, encoder(""), detect, encoder_multi=encoder("m"))[1].withColumn("asked", F.lit(r["lang"])) for r in asked]
    return found[0].unionByName(found[1])


@query()
def encode_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "embedding")


_NEAREST = f"""with {_VECTORS.replace("where id = 0", "where id % 20 = 0")}, s as (select q.id as query_id, e.id, round({_SIM}, 6) as score from e, q),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) select query_id, id, score, cast(rank as integer) as rank from r where rank <= 10"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The graph of all vectors, and the rows that are queries."""
    rows = _vectors(spark, sf_dir)
    index = graph.build(rows, "id", "embedding", new_path(spark, "graph"))
    return index, rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(_NEAREST)
def graph_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of every shard: what an exact search finds."""
    return graph.topk(*_graph(spark, sf_dir), 10, None)


@query()
def graph_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beams as wide as the rows need for their neighbours."""
    index, queries = _graph(spark, sf_dir)
    return graph.topk(index, queries, 10, graph.width_for(index, _vectors(spark, sf_dir), "id", "embedding"))


@query()
def graph_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the graph finds of the true neighbours, and the share of all cosines that it takes."""
    rows = _vectors(spark, sf_dir)
    index, queries = _graph(spark, sf_dir)
    found = persist(graph.search_shards(index, queries, 10, graph.width_for(index, rows, "id", "embedding")), "found")
    truth = semantic.topk_batch(rows, queries.withColumn("query_language", F.lit(None).cast("string")), 10, "id", "embedding").select("query_id", "id")
    parts = (
        found.agg(F.sum("computed").alias("computed")),
        rows.filter("embedding is not null").agg(F.count("*").alias("candidates"), F.count_if(F.col("id") % 20 == 0).alias("queries")),
        truth.join(graph.merge(found, 10), ["query_id", "id"], "left").agg(F.count("*").alias("true"), F.count("rank").alias("hits")),
    )
    one = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    sums = one.agg(*(F.sum(c).alias(c) for c in ("candidates", "queries", "computed", "true", "hits")))
    return sums.select("candidates", "queries", "computed", (F.col("computed") / (F.col("candidates") * F.col("queries"))).alias("share"), (F.col("hits") / F.col("true")).alias("recall"))
