import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import prefixhash as ph


@settings(max_examples=150, deadline=None)
@given(st.text("ab", max_size=60), st.text("ab", max_size=60), st.data())
def test_span_equality_and_extensions(a, b, data):
    x, y = ph.PrefixHash(a), ph.PrefixHash(b)
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    n = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    assert (x.span(i, n) == y.span(j, n)) == (a[i : i + n] == b[j : j + n])
    agree = 0
    while i + agree < len(a) and j + agree < len(b) and a[i + agree] == b[j + agree]:
        agree += 1
    assert ph.common_extension(x, i, y, j) == agree


def test_likeness():
    one = " ".join(f"word{i}" for i in range(400))
    near = one.replace("word200", "other")
    prints = [ph.PrefixHash(t).fingerprint() for t in (one, one, near, "something else altogether", "")]
    assert prints[0] == prints[1] != prints[2]
    assert ph.likeness(prints[0], prints[1]) == 1.0
    assert ph.likeness(prints[0], prints[2]) > 0.8
    assert ph.likeness(prints[0], prints[3]) == 0.0
    assert ph.likeness(prints[0], prints[4]) == 0.0


def test_likeness_of_short_and_middling_texts():
    """An edited text keeps its first half, at any length, and a sketch of the same width."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    for n in (30, 50, 100, 500, 1000, 1023, 1024, 1100, 2100, 9000):
        one, other = (" ".join(word() for _ in range(n // 6 + 1))[:n] for _ in range(2))
        for following in (other, other[: n // 4]):
            near = ph.likeness(*(ph.PrefixHash(t).fingerprint() for t in (one, ph.edited(one, following))))
            assert 0.1 < near < 0.8
        assert ph.likeness(*(ph.PrefixHash(t).fingerprint() for t in (one, other))) < 0.1


def expected(texts):
    """texts in order; the next of the last is the first."""
    out = []
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        a, b, c = (ph.PrefixHash(x).fingerprint() for x in (t, changed, following))
        out.append((len(t), hashlib.sha256(changed.encode()).hexdigest(), a, b, ph.likeness(a, b), ph.likeness(a, c)))
    return out


def test_all_documents(spark, documents, rows):
    for partitions in ("1", "4", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = ph.neighbours(documents).orderBy("doc_id").collect()
        assert [tuple(r)[1:7] for r in got] == expected([r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])])
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_rows(odd, none):
    rows = [tuple(r) for r in odd.selectExpr("doc_id", "coalesce(text, '')", "xxhash64(coalesce(text, ''))").collect()]
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    want = sorted((str(r[0]), *e) for r, e in zip(ordered, expected([r[1] for r in ordered]), strict=True))
    assert sorted((str(r.doc_id), *tuple(r)[1:7]) for r in ph.neighbours(odd).collect()) == want
    assert ph.neighbours(none).count() == 0
    one = ph.neighbours(odd.filter("doc_id = 8")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


@pytest.mark.parametrize("repeats", [3, 10])
def test_one_id_and_one_row_very_often(spark, monkeypatch, repeats):
    """Most rows share one id or have none, and one row is repeated; ranges split them by their texts."""
    monkeypatch.setattr(ph, "partitions", lambda df: 13)
    rows = [(7, f"text {i % 40} of the many") for i in range(200)] + [(7, "the same row")] * repeats + [(None, f"none {i}") for i in range(60)]
    rows += [(i, f"some text {i}") for i in range(0, 20)] + [(None, "none 3")] * repeats + [(2**60 + i, f"far {i}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashed = [tuple(r) for r in df.selectExpr("doc_id", "text", "xxhash64(text)").collect()]
    ordered = sorted(hashed, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    want = sorted((str(r[0]), *e) for r, e in zip(ordered, expected([r[1] for r in ordered]), strict=True))
    marked, most = ph._ranges(df.withColumn("h", F.xxhash64("text")), 13)
    assert most >= repeats
    sizes = [r["count"] for r in marked.groupBy("part").count().collect()]
    assert max(sizes) < 60 and marked.agg(F.max("times")).first()[0] >= repeats
    got = ph.neighbours(df)
    assert sorted((str(r.doc_id), *tuple(r)[1:7]) for r in got.collect()) == want
