import random
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, components, simhash, similar


def shingled(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def texts():
    """Clean texts, a common line in most, and copies of six texts edited to a similarity about 0.8."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(3000)}"
    line = " ".join(word() for _ in range(12))
    out = []
    for g in range(6):
        base = [word() for _ in range(60 + 40 * g)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, 3 + g)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    out += [line + " " + " ".join(word() for _ in range(rng.randrange(4, 80))) for _ in range(60)]
    return out + [out[0].upper(), "two words", "Two  words", "a b c d e f g h i", "a b c d e f g h i j"]


@pytest.mark.parametrize("common", [1, 10**6])
def test_pipeline_stage_keeps_one_of_each_group_by_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(similar, "COMMON", common)
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts())]
    sets = [shingled(t) for _, t, *_ in rows]
    least = list(range(len(rows)))
    linked = 0
    for i, j in combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            linked += 1
            a, b = sorted((least[i], least[j]))
            least = [a if x == b else x for x in least]
    assert linked > 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(least))


def test_pairs_across_labels():
    rng = np.random.default_rng(1)
    gram, label = np.sort(rng.integers(0, 9, 200)), rng.integers(0, 4, 200)

    node, n, at = np.arange(200), np.full(200, 10), np.zeros(200, np.int64)
    gram = gram[np.lexsort((label, gram))]
    values = rng.integers(0, 2**63, 40)
    fp = values[rng.integers(0, 40, 200)] ^ (1 << rng.integers(0, 60, 200))
    near = lambda i, j: (int(fp[i]) ^ int(fp[j])).bit_count() <= similar.BUDGET
    got = {(int(a), int(b)) for batch in similar._cross(gram, node, fp, n, at, label) for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
    assert got == {(i, j) for i, j in combinations(range(200), 2) if gram[i] == gram[j] and label[i] != label[j] and near(i, j)}


def test_odd_rows(odd, none):
    kept = similar.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, x) for x in (-5, 1, 3, 6, 7, 8)] + [(True, 0)]
    assert similar.keep_one(none).count() == 0


@pytest.mark.parametrize("links", [10**6, 50])
def test_thinned_links_connect_the_same(spark, monkeypatch, links):
    monkeypatch.setattr(components, "TASK_LINKS", links)
    rng = np.random.default_rng(3)
    groups = [rng.integers(-(2**62), 2**62, n).tolist() for n in (2, 40, 60)]
    pairs = [(int(a), int(b)) for g in groups for a, b in combinations(g, 2)] + [(5, 5)]
    df = spark.createDataFrame(pairs, "a long, b long")
    thin = components.thinned(df)
    assert thin.count() <= 102 * -(-len(pairs) // links)
    assert {(r.node, r.root) for r in components.components(thin).collect()} == {(x, min(g)) for g in groups for x in g}
    assert components.thinned(df.limit(0)).count() == 0


def test_exact_setting_misses_no_pair(spark):
    """Whole prefixes and no budget: the groups are those of all pairs, short texts at 4 of 5 shingles among them."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for n in [8, 8, 8, 12, 13, 30] * 12:
        base = [word() for _ in range(n)]
        rows += [" ".join(base), " ".join([*base, word()])]
    sets = [shingled(t) for t in rows]
    least = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((least[i], least[j]))
            least = [a if x == b else x for x in least]
    df = spark.createDataFrame(list(enumerate(rows)), "k long, text string")
    got = similar.near_duplicates(df, budget=64, most=None).collect()
    assert {r.k: r.component for r in got} == dict(enumerate(least)) and len(set(least)) == len(rows) // 2


@pytest.mark.parametrize("chunk", [512, 3])
def test_dense_group_unlike_its_least_text(spark, monkeypatch, chunk):
    """Near copies of which few are similar to the first, cut into chunks: the groups are those of all pairs."""
    monkeypatch.setattr(similar, "CHUNK", chunk)
    monkeypatch.setattr(similar, "CENTRES", 1)
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, rows = [word() for _ in range(150)], []
    for _ in range(70):
        copy = list(base)
        for _ in range(rng.randrange(1, 7)):
            copy[rng.randrange(len(copy))] = word()
        rows.append(" ".join(copy))
    sets = [shingled(t) for t in rows]
    least, linked = list(range(len(rows))), 0
    for i, j in combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            linked += 1
            a, b = sorted((least[i], least[j]))
            least = [a if x == b else x for x in least]
    assert 100 < linked < 70 * 69 / 2 and len(set(least)) < 70
    df = spark.createDataFrame(list(enumerate(rows)), "k long, text string")
    got = {r.k: r.component for r in similar.near_duplicates(df).collect()}
    assert got == dict(enumerate(least))


def test_links_of_chunks():
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.permutation(30)[: rng.integers(23, 31)]) for _ in range(60)]
    node, label, side = rng.permutation(60) * 7, rng.integers(0, 50, 60), rng.integers(0, 2, 60)
    near = lambda i, j: label[i] != label[j] and 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))
    for one in (False, True):
        got = similar.links_between(node, label, np.zeros(60) if one else side, sets)
        want = [(node[i], node[j]) for i, j in combinations(range(60), 2) if near(i, j) and (one or side[i] != side[j])]
        assert want
        joined = similar._forest(*np.array(want).T)
        assert set(zip(*got, strict=True)) == set(zip(*joined, strict=True))


def test_pipeline_stage_has_an_exact_way(spark, monkeypatch):
    """What the bit budget and the short prefix drop is found by ``exact``, also in the pipeline's stage."""
    monkeypatch.setattr(similar, "near_duplicates", partial(similar.near_duplicates, budget=0, most=1))
    rng = random.Random(12)
    rows = []
    for i in range(20):
        base = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        rows += [(2 * i, " ".join(base), "en", "a", 0), (2 * i + 1, " ".join([*base, "more", "words"]), "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.drop_near_duplicates(spark, docs, "").count() > 20
    exact = corpus_pipeline.drop_near_duplicates(spark, docs, "", exact=True)
    assert sorted(r.doc_id for r in exact.select("doc_id").collect()) == list(range(0, 40, 2))


@pytest.mark.parametrize("most", [10**6, 3])
def test_rows_are_told_apart_before_a_shuffle(spark, monkeypatch, most):
    """Rows without a listed key aren't shuffled; beyond the bound of the broadcast all are."""
    monkeypatch.setattr(common, "BROADCAST_KEYS", most)
    rows = spark.range(100).select(F.struct("id").alias("k"))
    keys = rows.filter("k.id % 10 = 0")
    near, far = common.split_by(rows, keys, keys.count())
    if most == 3:
        assert far is None and near.count() == 100
    else:
        assert near.count() == 10 and far.count() == 90 and "hashpartitioning(k" not in far._jdf.queryExecution().executedPlan().toString()


def random_sets():
    """Sets of 0 to 12,000 hashes, and copies of each that share 95 to 50 %."""
    rng = np.random.default_rng(8)
    draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    out = []
    for n in (0, 1, 5, 64, 65, 300, 500, 520, 1000, 12_000):
        base = np.unique(draw(n))
        out += [base] + [np.unique(np.concatenate((base[: int(n * share)], draw(n - int(n * share) + more)))) for share in (0.95, 0.9, 0.89, 0.8, 0.5) for more in (0, n // 20)]
    return out


def test_bit_maps_drop_no_similar_pair_and_most_others():
    sets = random_sets()
    maps = pa.array([b"", *map(similar.bit_map, sets)], pa.binary()).slice(1)
    assert max(len(m.as_py()) for m in maps) == similar.MAP_BITS // 8
    i, j = np.triu_indices(len(sets), 1)
    n = np.array([len(s) for s in sets])
    may = similar.may_link(maps, maps, n[i], n[j], i, j)
    true = np.array([9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (n[a] + n[b]) for a, b in zip(i, j, strict=True)])
    assert true.sum() > 50 and not (true & ~may).any() and may[~true].mean() < 0.1


def test_pairs_that_chance_brings_together_are_no_candidates():
    """Texts that share a shingle at most hung together in one group, as large as the corpus made it; now none is in one."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64)) for _ in range(100)]
    node, same = np.arange(100), np.zeros(100, np.int64)
    near = [(0, 1)]
    sets[1] = np.unique(np.concatenate((sets[0][:295], sets[1][:5])))
    n = np.array([len(s) for s in sets])
    maps = pa.array(list(map(similar.bit_map, sets)), pa.binary())
    args = (same, node, rng.integers(0, 15, 100), n, same, node)
    assert len(list(similar._candidates(*args, None))[0]) == 99
    got = similar._candidates(*args, maps)
    assert [(b, a) for batch in got for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)] == near


def test_sets_are_sent_in_rounds(spark, monkeypatch):
    """Many rounds give what one does, and none sends more than its share."""
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "k long, text string")
    one = {r.k: r.component for r in similar.near_duplicates(df).collect()}
    for name, value in (("TIMES", 1), ("SENT", 1), ("CHUNK", 3), ("CENTRES", 1)):
        monkeypatch.setattr(similar, name, value)
    rounds, written, real = [], [], similar._in_rounds

    def watched(rows, by, count, *rest):
        rounds.append(count)
        return real(rows, by, count, *rest)

    persist = similar.persist
    monkeypatch.setattr(similar, "_in_rounds", watched)
    monkeypatch.setattr(similar, "persist", lambda df, label: written.append(label) or persist(df, label))
    assert {r.k: r.component for r in similar.near_duplicates(df).collect()} == one and len(set(one.values())) < len(rows)
    assert max(rounds) > 1 and sum(rounds) == sum(x in ("similar-links", "similar-group-links") for x in written)
    assert similar._rounds(1001, 100) == 1001 // 100 + 1 and similar._rounds(0, 0) == 1
