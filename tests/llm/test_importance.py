import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import importance

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [zlib.crc32(g.encode()) % 10_000 for g in [*words, *map(" ".join, zip(words, words[1:], strict=False))]]


def brute(docs, target):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) pairs, by the contract's words."""
    made = [(i, text, *grams(text)) for i, text in docs]
    s = Counter(b for *_, g in made for b in g)
    t = Counter(b for text in target for b in grams(text)[1])
    S, T = s.total(), t.total()
    out = []
    for i, text, n, g in made:
        gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in g]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(g), weight, score, None, n, text or ""])
    enough = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(enough[: 25 * len(enough) // 100], 1):
        row[4] = rank
    return out


def ordered(rows):
    return sorted(map(repr, map(tuple, rows)))


def test_all_documents(spark, documents, rows):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = importance.resample(documents, target).collect()
    want = brute([(r["doc_id"], r["text"]) for r in rows], [r.text for r in target.collect()])
    assert ordered(got) == ordered(r[:5] for r in want)
    assert sum(r.rank is not None for r in got) > 10


def test_odd_rows(spark, odd):
    """Nulls, repeats, ties, one very long text and clashing names; all twenty times over, so that some are drawn."""
    target = spark.createDataFrame([("The naïve thing",), (None,), ("",)], "text string")
    many = odd.crossJoin(spark.range(4).select(F.col("id").alias("other_id")))
    got = importance.resample(many, target).collect()
    want = brute([(r.doc_id, r.text) for r in many.collect()], ["The naïve thing", None, ""])
    # Rows alike in id only may take either's rank, so these are compared as sets of ranks.
    assert ordered((r.doc_id, r.n_features, r.weight, r.score) for r in got) == ordered(r[:4] for r in want)
    ranks = sorted(r.rank for r in got if r.rank)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == sum(r[4] is not None for r in want)
    by = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    assert [r.score for r in by] == [r[3] for r in sorted((r for r in want if r[4]), key=lambda r: r[4])]


def test_empty_tables(spark, none, odd):
    target = spark.createDataFrame([], "text string, doc_id long, bucket int")
    assert importance.resample(none, target).count() == 0
    want = brute([(r.doc_id, r.text) for r in odd.collect()], [])
    assert ordered(tuple(r)[:4] for r in importance.resample(odd, target).collect()) == ordered(r[:4] for r in want)


def test_one_row_very_often(spark):
    """A row that makes up most of the table is split into words once and takes consecutive ranks."""
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.range(3000).select(F.when(F.col("id") > 20, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.lit(text).alias("text"))
    got = importance.resample(df, df.limit(1)).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 751)) and len(got) == 3000
    assert len({r.weight for r in got}) == 1


def test_three_orders(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    table = importance.positions(df, ["doc_id"], orders=3, buckets=1000)
    want = [zlib.crc32(g.encode()) % 1000 for g in ("a b c", "b c", "c")]
    got = sorted((tuple(r) for r in table.filter("doc_id = 1").collect()), key=lambda r: (r[3] is None, r[2] is None))
    assert [got[0][3], got[1][2], got[2][1]] == want and got[1][3] is None and got[2][2] is None
