"""One query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, hamming, importance, langid, lm, mih, mixing, prefixhash, simhash, substrings, tokenfile, urlfilter, whitening
from tessera.storage import new_path, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of 16 words or more that stands at an earlier place too, with that place (``substrings.repeats``)."""
    return substrings.repeats(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back (``tokenfile``)."""
    folder = new_path(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, end_id=1)
    return tokenfile.read(spark, folder)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from three quarters of them (``langid.identify``)."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fingerprint and its component at 4 bits or fewer (``simhash.query``)."""
    return simhash.query(table(spark, sf_dir, "documents"))


def op5_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text under the PPM model and the unigram baseline, learnt from nine tenths of them (``lm.score``)."""
    return lm.score(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by rules, else by the link graph (``urlfilter.judge``)."""
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op7_prefix_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text against an edited copy and against the next one (``prefixhash.neighbours``)."""
    return prefixhash.neighbours(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again, as digests (``bpe.encode_documents``)."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, ["doc_id"])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document (``mixing.mix``)."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes of every vector whose id is divisible by 20, itself among them (``hamming.top_k``).

    Rows with a null id or vector are left out.
    """
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"), "embedding")
    codes = codes.filter("embedding is not null").select("id", "code")
    return hamming.top_k(codes, codes.filter("id % 20 = 0"), 10)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark texts, and the quarter that is drawn (``importance.resample``)."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 32 first components of all vectors, whitened (``whitening.components_of``)."""
    return whitening.components_of(table(spark, sf_dir, "embeddings"))


def op13_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found of every vector whose id is divisible by 50, but for itself (``mih.top_k``)."""
    found = mih.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_token_files,
        op3_language_id,
        op4_simhash,
        op5_ppm_scores,
        op6_url_filter,
        op7_prefix_hashes,
        op8_byte_bpe,
        op9_mixing,
        op10_hamming_topk,
        op11_importance_resampling,
        op12_whitening,
        op13_multi_index_hashing,
    )
}

_NEAREST = """
with codes as (
  select vec_id as id, [x > 0 for x in embedding] as bits from embeddings where vec_id is not null and embedding is not null
), ranked as (
  select q.id as query_id, c.id as id,
    cast(list_sum([case when q.bits[i] <> c.bits[i] then 1 else 0 end for i in range(1, 65)]) as integer) as distance
  from codes q, codes c where q.id % 20 = 0
)
select query_id, cast(rank as integer) as rank, id, distance from (
  select *, row_number() over (partition by query_id order by distance, id) as rank from ranked
) where rank <= 10
"""

# crc32 of a text's bytes, byte by byte, from the table that its polynomial makes.
_RESAMPLED = r"""
with crc as (
  select list(list_reduce(list_prepend(i, range(8)), lambda c, _: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)
), tokens as (
  select 'd' as side, row_number() over () as k, doc_id, text from documents union all select 'b', row_number() over (), null, text from benchmark
), split as (
  select side, k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from tokens
), grams as (
  select side, k, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) as g from split
), distinct_grams as (
  select g, hex(encode(g)) as x from (select distinct g from grams)
), buckets as (
  select g, xor(list_reduce(list_prepend(4294967295, [cast('0x' || substr(x, cast(2 * i + 1 as bigint), 2) as bigint) for i in range(0, len(x) // 2)]),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 as bucket
  from distinct_grams, crc
), placed as (
  select side, k, bucket from grams join buckets using (g)
), per_bucket as (
  select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t from placed group by bucket
), gains as (
  select bucket, cast(floor(1000 * ln((cast(t as double) + 1) * (cast(sum(s) over () as double) + 10000) / ((cast(s as double) + 1) * (cast(sum(t) over () as double) + 10000)))) as bigint) as gain from per_bucket
), sums as (
  select k, count(*) as n, sum(gain) as total from placed join gains using (bucket) where side = 'd' group by k
), weighed as (
  select doc_id, len(w) as words, coalesce(n, 0) as n_features, case when n > 0 then cast((total - ((total % n) + n) % n) // n as bigint) else 0 end as weight,
    cast('0x' || substr(sha256('7:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as h
  from split left join sums using (k) where side = 'd'
), scored as (
  select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from weighed
), ranked as (
  select *, row_number() over (partition by words >= 20 order by score desc, doc_id) as r, count(*) filter (words >= 20) over () as eligible from scored
)
select doc_id, cast(n_features as bigint) as n_features, weight, score, case when words >= 20 and r <= 25 * eligible // 100 then r end as rank from ranked
"""

ORACLES: dict[str, str] = {"op10_hamming_topk": _NEAREST, "op11_importance_resampling": _RESAMPLED}
