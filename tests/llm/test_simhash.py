import random

import numpy as np
import xxhash

from tessera.llm import components, simhash


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(keys, near):
    least = {k: k for k in keys}

    def find(k):
        while least[k] != k:
            k = least[k]
        return k

    keys = list(keys)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if near(a, b):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_all_documents_against_brute_force(documents, rows):
    got = {r.doc_id: r for r in simhash.query(documents).collect()}
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    want = classes(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {i: (g.fingerprint, g.component_id) for i, g in got.items()} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def random_prints(seed, n, bits=64):
    rng = random.Random(seed)
    bases = [rng.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        x = rng.choice(bases)
        for _ in range(rng.randrange(10)):
            x ^= 1 << rng.randrange(bits)
        out.add(x)
    return np.array(sorted(out), dtype=np.uint64)


def joined(prints, edges):
    at = {int(x): i for i, x in enumerate(prints)}
    pairs = {(at[int(a)], at[int(b)]) for a, b in edges}
    return classes(range(len(prints)), lambda a, b: (a, b) in pairs or (b, a) in pairs)


def test_trie_join_of_one_group():
    for seed in range(8):
        prints = random_prints(seed, 90)
        a, b = simhash.link_groups(prints, np.array([0, len(prints)]))
        want = classes(range(len(prints)), lambda i, j: int(prints[i] ^ prints[j]).bit_count() <= 4)
        assert joined(prints, zip(a, b, strict=True)) == want
        assert len(a) < len(prints)


def test_hot_groups_are_split_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 10)
    monkeypatch.setattr(simhash, "SHARE", 0.01)
    prints = random_prints(3, 200, bits=12)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    edges = [(np.int64(r.a).view(np.uint64), np.int64(r.b).view(np.uint64)) for r in simhash.links(df, len(prints)).collect()]
    want = classes(range(len(prints)), lambda i, j: int(prints[i] ^ prints[j]).bit_count() <= 4)
    assert joined(prints, edges) == want


def test_masks_cover_every_pair_within_the_budget():
    rng = random.Random(2)
    for n in (100, 10**7, 10**9):
        chosen = simhash.masks(n)
        for _ in range(200):
            differ = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not differ & m for m in chosen)


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([((i * 7919) % n, ((i + 1) * 7919) % n) for i in range(n - 1)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}


def test_odd_rows(odd, none):
    got = simhash.query(odd).collect()
    assert len(got) == odd.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert len(by_id[1]) == 3
    assert by_id[2][0].component_id == 1
    assert {r.fingerprint for i in (3, 4, 5) for r in by_id[i]} == {"0" * 16}
    assert {r.component_id for i in (3, 4, 5) for r in by_id[i]} == {3}
    assert simhash.query(none).count() == 0


def test_one_row_of_each_group_stays(odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == [(False, -5), (False, 1), (False, 3), (False, 6), (False, 7), (False, 8), (True, 0)]
    assert simhash.keep_one(none).count() == 0
