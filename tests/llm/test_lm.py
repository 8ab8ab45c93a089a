import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import lm


def plain_ppm(train, tests, order=lm.ORDER):
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        data = bytes([255]) * order + t.encode() + b"\xff"
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts[k][data[i - k : i]][data[i]] += 1
    out = []
    for t in tests:
        data, total = bytes([255]) * order + t.encode() + b"\xff", 0.0
        for i in range(order, len(data)):
            excluded, p = set(), 1.0
            for k in range(order, -1, -1):
                seen = {b: n for b, n in counts[k].get(data[i - k : i], {}).items() if b not in excluded}
                if not seen:
                    continue
                n = sum(seen.values()) + len(seen)
                if data[i] in seen:
                    p *= seen[data[i]] / n
                    break
                p *= len(seen) / n
                excluded |= set(seen)
            else:
                p /= 256 - len(excluded)
            total += math.log10(p)
        out.append(total)
    return out


def fit(texts):
    keys, n = lm.gram_counts(texts)
    grams = []
    for k in range(lm._GRAM):
        short, at = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        grams.append((short, np.bincount(at, n).astype(np.int64)))
    return lm.build(grams)


def test_trie_against_plain_ppm(rows):
    texts = [r["text"][:1500] for r in rows[:40]]
    tests = [*texts[30:], "", "日本 Ω", "zzz\x00"]
    assert fit(texts[:30]).score(tests) == pytest.approx(plain_ppm(texts[:30], tests), abs=1e-3)


def test_probabilities_add_up():
    trie = fit(["abracadabra", "abba", ""])
    p = (10.0 ** trie.log_p.astype(np.float64)).sum(1)
    alike = trie.log_p.shape[1] - 1
    p += (256 - alike - 1) * 10.0 ** trie.log_p[:, -1].astype(np.float64)
    assert p == pytest.approx(np.ones(len(p)), abs=1e-5)


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out


def expected(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    count = Counter()
    for (_, text), out in zip(rows, held, strict=True):
        if not out:
            count.update([*words(text), "\n"])
    total, distinct = sum(count.values()), len(count)
    found = []
    for (i, text), out in zip(rows, held, strict=True):
        tokens = [*words(text), "\n"]
        base = sum(math.log10((count[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens)
        found.append((i, out, len(tokens), sum(count[t] > 0 for t in tokens), total, base))
    model = plain_ppm([t or "" for (_, t), out in zip(rows, held, strict=True) if not out], [t or "" for _, t in rows])
    return [(*f, s) for f, s in zip(found, model, strict=True)]


def same(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[5])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert [g[6] for g in got] == pytest.approx([w[6] for w in want], rel=1e-4, abs=1e-3)


def test_all_rows_against_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 20_000)
    small = documents.filter("n_chars < 800")
    same(lm.score(small).collect(), expected([(r.doc_id, r.text) for r in small.collect()]))


def test_odd_rows(odd, none):
    short = odd.filter("doc_id <> 6 or doc_id is null")
    same(lm.score(short).collect(), expected([(r.doc_id, r.text) for r in short.collect()]))
    assert lm.score(none).count() == 0
    only_held = lm.score(odd.filter("doc_id = 8").withColumn("doc_id", odd.doc_id * 0 + 11)).collect()
    assert len(only_held) == 1


def test_the_model_beats_the_baseline_on_held_out_texts(documents):
    rows = [r for r in lm.score(documents).collect() if r.held_out]
    assert sum(r.score for r in rows) < 0
    per_token = sum(r.score for r in rows) / sum(r.n_tokens for r in rows)
    assert per_token > -6


def test_contexts_are_bounded_by_their_counts(spark, monkeypatch):
    totals = spark.createDataFrame([(i, 1 + 7 * i) for i in range(1000)], "context long, total long")
    for most in (1, 50, 999, 1000, 5000):
        monkeypatch.setattr(lm, "MAX_CONTEXTS", most)
        kept = totals.filter(totals.total >= lm._least_total(totals)).count()
        assert most * 0.9 - 45 <= kept <= most or kept == 1000 <= most


def test_no_context_is_left_out(spark):
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrst "))
    texts = [(i, "".join(rng.choice(letters, 4000))) for i in range(24)]
    assert len({t[i : i + lm.ORDER] for _, t in texts for i in range(len(t))}) > lm.MAX_CONTEXTS
    same(lm.score(spark.createDataFrame(texts, "doc_id long, text string")).collect(), expected(texts))
