"""Queries that evaluate: rankings against grades, graders against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import evaluate, judge, replay, sampling
from tessera.plans.registry import query
from tessera.storage import new_path, table
from tessera.streaming import incremental, judge_stream

# Each event is a result: its user the query, its place by value the rank, its type the grade.
_GRADE = "case event_type when 'purchase' then 3 when 'signup' then 2 when 'click' then 1 else 0 end"
_RESULTS = f"""r as (select user_id as query_id, row_number() over (partition by user_id order by value desc, event_id) as rank, {_GRADE} as grade, 'l' || user_id % 4 as language from events),
cut as (select *, row_number() over (partition by query_id order by grade desc, rank) as ideal from r where rank <= 10),
q as (select query_id, language, max(case when rank <= 1 and grade >= 2 then 1.0::double else 0 end) as recall_1, max(case when rank <= 5 and grade >= 2 then 1.0::double else 0 end) as recall_5,
  max(case when rank <= 10 and grade >= 2 then 1.0::double else 0 end) as recall_10, coalesce(1.0::double / min(rank) filter (grade >= 2), 0) as rr,
  sum((pow(2.0, grade) - 1) / log2(rank + 1.0)) as dcg, sum((pow(2.0, grade) - 1) / log2(ideal + 1.0)) as idcg from cut group by 1, 2)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    named = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("query_id"), rank.alias("rank"), F.expr(_GRADE).alias("grade"), F.concat(F.lit("l"), (F.col("user_id") % 4).cast("string")).alias("language"), "event_id"
    )
    return named.filter("rank <= 10")


_NDCG = "case when idcg > 0 then dcg / idcg else 0 end"


@query(f"with {_RESULTS} select query_id, language, recall_1, recall_5, recall_10, round(rr, 9) as rr, round(dcg, 6) as dcg, round({_NDCG}, 6) as ndcg from q")
def recall_mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = evaluate.per_query(_results(spark, sf_dir), ["language"]).drop("idcg")
    return scores.withColumns({"rr": F.round("rr", 9), "dcg": F.round("dcg", 6), "ndcg": F.round("ndcg", 6)})


@query(
    f"""with {_RESULTS} select language, count(*) as n, round(avg(recall_1), 6) as recall_1, round(avg(recall_5), 6) as recall_5, round(avg(recall_10), 6) as recall_10, round(avg(rr), 6) as rr,
  round(avg({_NDCG}), 6) as ndcg, count(*) < 10 as small from q group by grouping sets ((), (language))"""
)
def metrics_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.summarize(evaluate.per_query(_results(spark, sf_dir), ["language"]), "language")
    return out.withColumns({c: F.round(c, 6) for c in ("recall_1", "recall_5", "recall_10", "rr", "ndcg")})


# Two graders of 0 to 3 and a batch, from ids and labels.
_PAIRS = "pairs as (select doc_id, cast(quality * 2 + doc_id % 2 as integer) as human, cast((quality * 2 + toxic + doc_id % 3 // 2) % 4 as integer) as judge, 'b' || doc_id % 3 as batch from labels)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("quality") * 2 + d % 2).cast("int").alias("human"), ((F.col("quality") * 2 + F.col("toxic") + F.floor(d % 3 / 2)) % 4).cast("int").alias("judge"),
        F.concat(F.lit("b"), (d % 3).cast("string")).alias("batch"),
    )


@query(f"with {_PAIRS}, g as (select unnest(range(0, 4)) as x) select cast(a.x as integer) as a, cast(b.x as integer) as b, (select count(*) from pairs where human = a.x and judge = b.x) as n from g a, g b")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_pairs(spark, sf_dir), "human", "judge")


_KAPPA = "case when avg(h * h) - 2 * avg(h) * avg(j) + avg(j * j) > 1e-12 then round(1 - avg((h - j) * (h - j)) / (avg(h * h) - 2 * avg(h) * avg(j) + avg(j * j)), 6) else 'nan'::double end"


@query(f"with {_PAIRS}, p as (select batch, human::double as h, judge::double as j from pairs) select batch, count(*) as n, {_KAPPA} as kappa from p group by 1")
def qw_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.agreement(_pairs(spark, sf_dir), "human", "judge", ["batch"])
    return out.select("batch", "n", F.round("kappa", 6).alias("kappa"))


@query(f"with {_PAIRS} select batch, count(*) as n, round(avg((human = judge)::int), 9) as exact, round(avg((abs(human - judge) <= 1)::int), 9) as within_one from pairs group by 1")
def agreement_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.agreement(_pairs(spark, sf_dir), "human", "judge", ["batch"]).drop("kappa")


@query(
    f"""with {_PAIRS}, r as (select batch, rank() over (partition by batch order by human) + (count(*) over (partition by batch, human) - 1) / 2.0::double as x,
  rank() over (partition by batch order by judge) + (count(*) over (partition by batch, judge) - 1) / 2.0::double as y from pairs)
select batch, count(*) as n, round(corr(x, y), 6) as spearman from r group by 1"""
)
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.spearman(_pairs(spark, sf_dir), "human", "judge", ["batch"]).withColumn("spearman", F.round("spearman", 6))


@query(
    f"""with {_PAIRS} select batch, count(*) filter (human = 0) as n_0, count(*) filter (human = 1) as n_1, count(*) filter (human = 2) as n_2, count(*) filter (human = 3) as n_3, count(*) as n,
  round(avg(human), 9) as mean_grade from pairs group by rollup (batch)"""
)
def grade_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.grade_distribution(_pairs(spark, sf_dir), "human", "batch")


@query(f"with {_PAIRS} select doc_id, human, judge, abs(human - judge) as gap from pairs where abs(human - judge) >= 2")
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.disagreements(_pairs(spark, sf_dir).drop("batch"), "human", "judge")


@query(
    """with cache as (select doc_id, quality from labels where doc_id % 2 = 0) select d.doc_id as passage_id, c.quality as grade, case when c.doc_id is null then 'miss' else 'hit' end as outcome from documents d left join cache c on c.doc_id = d.doc_id"""
)
def cache_hits_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "documents").select(F.lit("q").alias("query_id"), F.col("doc_id").alias("passage_id"))
    cache = table(spark, sf_dir, "labels").filter("doc_id % 2 = 0")
    cache = cache.select(F.lit("m::v3").alias("signature"), F.lit("q").alias("query_id"), F.col("doc_id").alias("passage_id"), F.col("quality").alias("grade"))
    hits, misses = judge.split_cache(pairs, cache, "m::v3")
    missed = misses.select("passage_id", F.lit(None).cast("int").alias("grade"), F.lit("miss").alias("outcome"))
    return hits.select("passage_id", "grade", F.lit("hit").alias("outcome")).unionByName(missed)


_WORDS = r"list_distinct([x for x in regexp_split_to_array(lower(coalesce({}, '')), '\s+') if x <> ''])"


@query(
    f"""with n as (select count(*) as n from benchmark), p as (select b.item_id, d.doc_id, {_WORDS.format("b.text")} as wanted, {_WORDS.format("d.text")} as has from documents d, n join benchmark b on b.item_id = d.doc_id % n.n)
select cast(item_id as varchar) as query_id, cast(doc_id as varchar) as passage_id, cast(least(3, floor(4.0 * len(list_intersect(wanted, has)) / greatest(1, len(wanted)))) as integer) as grade,
  cast(case when doc_id % 2 = 0 then 2 else 1 end as bigint) as asked, cast(1 as bigint) as graded from p"""
)
def judge_stream_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document graded for a benchmark text as pairs arrive: first those of even ids, then, to a restarted stream, all."""
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    requests = asked.select("item_id", F.col("text").alias("query"))
    met = docs.withColumn("item_id", F.col("doc_id") % F.lit(asked.count())).join(requests, "item_id")
    pairs = met.select(
        "doc_id", F.lit("offline::v3").alias("signature"), F.col("item_id").cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("passage_id"), "query", F.col("text").alias("passage_text"),
    )
    at = new_path(spark, "judging")
    for arrived in (pairs.filter("doc_id % 2 = 0"), pairs):
        judge_stream.land(arrived, f"{at}/pairs", flush=None)
        judge_stream.judge_new(spark, f"{at}/pairs", f"{at}/judged", f"{at}/state", files_per_batch=1000)
    judged = judge_stream.read_judged(spark, f"{at}/judged")
    return judged.groupBy("query_id", "passage_id").agg(F.max("grade").alias("grade"), F.sum("asked").alias("asked"), F.count_if("fresh").alias("graded"))


@query()
def judged_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn graded against its conversation's first request, by the offline grader."""
    turns = table(spark, sf_dir, "conversations")
    first = turns.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", F.struct("turn", "text")).alias("query"))
    pairs = turns.join(first, "conv_id").select("conv_id", "turn", "role", "query", F.col("text").alias("passage_text"))
    return judge.grade(pairs).select("conv_id", "turn", "role", "grade")


@query(
    """with r as (select user_id as query_id, event_id as passage_id, row_number() over (partition by user_id order by value desc, event_id) as rank from events),
b as (select *, case when rank between 1 and 3 then 'top' when rank between 4 and 10 then 'mid' when rank between 15 and 30 then 'deep' end as band from r),
p as (select *, row_number() over (partition by query_id, band order by (passage_id * 7919) % 104729, passage_id) as rn from b where band is not null),
t as (select *, row_number() over (partition by band order by (passage_id * 7919) % 104729, passage_id) as bn from p where rn = 1)
select query_id, passage_id, cast(rank as integer) as rank, band from t where bn <= case band when 'top' then 9 else 8 end"""
)
def band_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    results = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("passage_id"), rank.alias("rank"))
    return sampling.band_sample(results, [sampling.arithmetic_key("passage_id"), F.col("passage_id")], sampling.band_targets(25))


@query(
    """with n as (select lang, count(*) as n from documents group by 1), s as (select lang, n, n * 30.0::double / sum(n) over () as exact from n),
q as (select *, cast(floor(exact) as integer) as base, row_number() over (order by exact - floor(exact) desc, lang) as rn from s)
select lang, base + case when rn <= 30 - (select sum(base) from q) then 1 else 0 end as quota from q"""
)
def language_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = {r["lang"]: r["count"] for r in table(spark, sf_dir, "documents").groupBy("lang").count().collect()}
    return spark.createDataFrame(sorted(sampling.language_quota(sizes, 30).items()), "lang string, quota int")


@query("select event_id, event_type, value * 2 as doubled from events")
def incremental_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final state after three runs over a folder that grew in between."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    source, sink, mark = (new_path(spark, x) for x in ("stream-in", "stream-out", "stream-mark"))
    step = lambda df: df.select("event_id", "event_type", (F.col("value") * 2).alias("doubled"))
    for part in range(3):
        events.filter(F.col("event_id") % 3 == part).write.mode("append").parquet(source)
        incremental.process_new(spark, source, "event_id long, event_type string, value double", sink, mark, step, "event_id", 1)
    return incremental.read_processed(spark, sink)


@query("select date_trunc('day', ts)::timestamp as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.windowed_counts(table(spark, sf_dir, "events"))


def _kappa_sql(a: str, b: str) -> str:
    return f"round(1 - avg(({a} - {b}) * ({a} - {b})) / (avg({a} * {a}) - 2 * avg({a}) * avg({b}) + avg({b} * {b})), 6)"


@query(
    f"""with {_PAIRS}, p as (select batch, judge::double as j, human::double as h, ((human + doc_id % 5 // 4) % 4)::double as s from pairs)
select batch, {_kappa_sql("j", "h")} as first_kappa, {_kappa_sql("j", "s")} as second_kappa from p group by 1"""
)
def kappa_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = ((F.col("human") + F.floor(F.col("doc_id") % 5 / 4)) % 4).cast("int")
    out = evaluate.kappa_change(_pairs(spark, sf_dir).withColumn("second", second), "judge", "human", "second", ["batch"])
    return out.select("batch", F.round("first_kappa", 6).alias("first_kappa"), F.round("second_kappa", 6).alias("second_kappa"))


@query(f"with {_PAIRS} select count(*) as n, avg((human = judge)::int) as repeat_rate from pairs")
def repeat_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    take = lambda c: pairs.select(F.col("batch").alias("query_id"), F.col("doc_id").alias("passage_id"), F.col(c).alias("grade"))
    return judge.repeat_rate(take("human"), take("judge"))


@query(
    """with k as (select conv_id, turn, role, text from conversations where turn % 2 = 0 and role = 'user'), c as (select distinct conv_id || '-' || turn as raw_id from k)
select raw_id, 'vibe_' || lpad(cast(row_number() over (order by raw_id) as varchar), 3, '0') as id from c"""
)
def kept_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    turns = turns.select(F.concat_ws("-", "conv_id", "turn").alias("raw_id"), "turn").distinct()
    decisions = turns.select("raw_id", F.when(F.col("turn") % 2 == 0, "k").otherwise("d").alias("decision"))
    return sampling.apply_decisions(turns.select("raw_id"), decisions).select("raw_id", "id")


@query("select lang as language, lang not in (select lang from documents where source = 'src3') as uncalibrated, lang in (select lang from documents where source = 'src3') as both from documents group by 1")
def calibrated_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    all_, some = docs.select("lang").distinct(), docs.filter("source = 'src3'").select("lang").distinct()
    rest, both = all_.subtract(some), all_.intersect(some)
    mark = lambda df, a, b: df.select(F.col("lang").alias("language"), F.lit(a).alias("uncalibrated"), F.lit(b).alias("both"))
    return mark(rest, True, False).unionByName(mark(both, False, True))


def _replay_sql(log: str, sizes: str) -> str:
    """Tables ``keys`` and ``done`` (who, stack of their places): each list's keys one after the other, on a stack that is held as such.

    ``log`` is (who, session, seq, key) and ``sizes`` (who, size).
    """
    return f"""keys as (select *, row_number() over (partition by who order by session, seq) as n from ({log}) join ({sizes}) using (who)),
walk as (select who, size, 0::bigint as n, null::bigint as session, false as quit, 0::bigint as floor, []::bigint[] as stack from (select distinct who, size from keys)
  union all select w.who, w.size, k.n, k.session, case when len(w.stack) >= w.size then w.quit else (k.session is not distinct from w.session and w.quit) or k.key = 'q' end,
    case when k.session is distinct from w.session then len(w.stack) else w.floor end,
    case when (w.quit and k.session = w.session) or len(w.stack) >= w.size then w.stack when k.key in ('k', 'd', '0', '1', '2', '3') then list_append(w.stack, k.n)
      when k.key = 'u' and len(w.stack) > case when k.session is distinct from w.session then len(w.stack) else w.floor end then w.stack[:-2] else w.stack end
  from walk w join keys k on k.who = w.who and k.n = w.n + 1),
done as (select who, unnest(stack) as n, generate_subscripts(stack, 1) as place from (select who, arg_max(stack, n) as stack from walk group by 1))"""


# Each event is a key of one of 50 curators, a week is a session; documents are dealt to the curators.
_KEY = "case event_type when 'view' then 'k' when 'purchase' then 'K' when 'signup' then 'd' when 'click' then 'u' else case when value < 20 then 'q' when value < 80 then 'U' else 'x' end end"
_OPEN = "select doc_id % 50 as who, doc_id from documents where doc_id not in (select doc_id from labels where toxic = 1)"


def _keys(spark: SparkSession, sf_dir: str, lists: int, session: str, key: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % lists).alias("who"), F.expr(session).cast("long").alias("session"), F.col("event_id").alias("seq"), F.expr(key).alias("key"))


@query(
    f"""with recursive {_replay_sql(f"select user_id % 50 as who, (dayofyear(ts) // 7)::bigint as session, event_id as seq, lower({_KEY}) as key from events", f"select who, count(*) as size from ({_OPEN}) group by 1")},
places as (select *, row_number() over (partition by who order by doc_id) as place from ({_OPEN}))
select p.who, p.doc_id, k.session, k.seq, k.key from done d join places p using (who, place) join keys k on k.who = d.who and k.n = d.n"""
)
def curation_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("who"), "doc_id")
    earlier = table(spark, sf_dir, "labels").filter("toxic = 1")
    return replay.replay(_keys(spark, sf_dir, 50, "floor(dayofyear(ts) / 7)", _KEY), docs, ["who"], ["doc_id"], decided=earlier, on=["doc_id"])


# Batches of labelled documents, two of them without a grader; the second round has the events after the 15th.
_GRADE_KEY = "case when event_type = 'signup' then 'u' when event_type = 'error' then 'x' else cast(event_id % 4 as string) end"
_BATCHES = "select doc_id % 12 as who, doc_id from labels"


def _round_sql(days: str, pairs: str) -> str:
    log = f"select user_id % 10 as who, dayofmonth(ts)::bigint as session, event_id as seq, {_GRADE_KEY} as key from events where {days}"
    return _replay_sql(log, f"select who, count(*) as size from ({pairs}) group by 1")


@query(
    f"""with one as (with recursive {_round_sql("dayofmonth(ts) <= 15", _BATCHES)}, places as (select *, row_number() over (partition by who order by doc_id) as place from ({_BATCHES}))
  select p.who, p.doc_id, k.key::integer as grade from places p left join done d using (who, place) left join keys k on k.who = d.who and k.n = d.n),
ready as (select who, doc_id from one where who in (select who from one group by 1 having bool_and(grade is not null))),
two as (with recursive {_round_sql("dayofmonth(ts) > 15", "select * from ready")}, places as (select *, row_number() over (partition by who order by (doc_id * 7919 + 5) % 104729, doc_id) as place from ready)
  select p.who, p.doc_id, k.key::integer as regrade from places p join done d using (who, place) join keys k on k.who = d.who and k.n = d.n)
select one.who as batch, one.doc_id, grade, regrade from one left join two on two.who = one.who and two.doc_id = one.doc_id"""
)
def grading_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "labels").select((F.col("doc_id") % 12).alias("batch"), "doc_id")
    keys = _keys(spark, sf_dir, 10, "dayofmonth(ts)", _GRADE_KEY).withColumnRenamed("who", "batch")
    once = replay.first_round(pairs, keys.filter("session <= 15"), "batch", ["doc_id"])
    return replay.second_round(once, keys.filter("session > 15"), "batch", "doc_id", order=sampling.arithmetic_key("doc_id", 5))
