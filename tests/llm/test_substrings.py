import random
import re

import numpy as np
import pytest

from tessera.llm import substrings

WORDS = [a + b for a in "ba ce di fo gu ha ki lo".split() for b in "mar nel pit sor tun vek".split()]


def passage(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    """Texts of which two in three share one of four passages of 51 to 90 words."""
    rng = random.Random(8)
    shared = [passage(rng, n) for n in (51, 60, 75, 90)]
    texts, has = [], {}
    for i in range(90):
        text = passage(rng, rng.randrange(20, 120))
        if i % 3:
            k = rng.randrange(4)
            text = f"{text} {shared[k]} {passage(rng, rng.randrange(5, 60))}"
            has[i] = k
        texts.append(text)
    return texts, shared, has


def test_cuts_depend_on_nearby_content_only(planted):
    texts = planted[0]
    for t in texts[:30]:
        data = t.encode()
        edges = substrings.cuts(data)
        assert edges[0] == 0 and edges[-1] == len(data) and (np.diff(edges) > 0).all()
        moved = substrings.cuts(b"Some new words here. " + data) - 21
        assert set(edges[edges > 60]) == set(moved[moved > 60])


def test_gear_hash_rolls():
    data = np.frombuffer(bytes(range(200)), dtype=np.uint8)
    h, got = 0, substrings.gear_hashes(data)
    for i, b in enumerate(data):
        h = (2 * h + int(substrings._gear()[b])) & 0xFFFF
        assert got[i] == h


def test_long_stretches_without_cuts_are_cut_between_characters():
    data = ("é" * 5000).encode()
    edges = substrings.cuts(data)
    assert np.diff(edges).max() <= substrings.LONGEST + 1
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        data[a:b].decode()


def test_planted_passages_are_found_and_clean_texts_left(spark, planted):
    texts, shared, has = planted
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    spans = substrings.repeats(df).collect()
    firsts = {k: min(i for i, x in has.items() if x == k) for k in has.values()}
    assert {s.doc_id for s in spans} == {i for i, k in has.items() if i != firsts[k]}
    for s in spans:
        piece = texts[s.doc_id].encode()[s.span_start : s.span_end].decode().strip()
        assert piece in shared[has[s.doc_id]]
        assert s.first_doc_id < s.doc_id and has[s.first_doc_id] == has[s.doc_id]
        assert s.n_words == len(piece.split()) >= substrings.MIN_WORDS
    cleaned = {r.doc_id: r.text for r in substrings.remove(df).collect()}
    for i, t in enumerate(texts):
        if i in has and i != firsts[has[i]]:
            assert shared[has[i]] not in cleaned[i] and len(cleaned[i]) < len(t)
        else:
            assert cleaned[i] == t


def earlier_places(rows):
    """Of each text, in order, the bytes that lie in runs of 16 words which stand earlier, by a dictionary of all such runs.

    Also the maximal runs: (name, begin, end, name of the earlier text, begin there).
    """
    seen, covered, runs = {}, {}, []
    for name in sorted({(r[0], r[1]): r[2] for r in rows}, key=lambda n: (n[0] is not None, n[0] or 0, n[1])):
        data = next(r[2] for r in rows if (r[0], r[1]) == name).encode()
        words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        inside, open_ = bytearray(len(data)), {}
        for i in range(len(words) - 15):
            a, b = words[i][0], words[i + 15][1]
            key = data[a:b]
            now = {}
            for other, at in seen.get(key, ()):
                now[other, at - a] = open_.pop((other, at - a), a)
                inside[a:b] = b"x" * (b - a)
            runs += [(name, begin, words[i + 14][1], other, begin + apart) for (other, apart), begin in open_.items()]
            open_ = now
            seen.setdefault(key, []).append((name, a))
        runs += [(name, begin, words[-1][1], other, begin + apart) for (other, apart), begin in open_.items()]
        covered[name] = inside
    return covered, runs


@pytest.mark.parametrize(("partitions", "hot"), [(1, 4096), (5, 1)])
def test_all_documents_against_brute_force(spark, documents, odd, monkeypatch, partitions, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 4_000_000 if hot > 1 else 20_000)
    for df in (documents.select("doc_id", "text"), odd.select("doc_id", "text")):
        rows = [tuple(r) for r in df.selectExpr("doc_id", "xxhash64(text)", "text").collect() if r[2]]
        texts = {(r[0], r[1]): r[2].encode() for r in rows}
        covered, runs = earlier_places(rows)
        by_hash = {}
        for (i, h), data in texts.items():
            by_hash.setdefault(i, []).append(data)
        found = {name: bytearray(len(t)) for name, t in texts.items()}
        for s in substrings.repeats(df.repartition(partitions)).collect():
            name = (s.doc_id, s.text_hash)
            piece = texts[name][s.span_start : s.span_end].rstrip()
            words = len(piece.split())
            assert s.n_words == words
            # The source has the same words, at its stated byte, and comes earlier.
            assert any(t[s.first_start : s.first_start + len(piece)].split() == piece.split() for t in by_hash[s.first_doc_id])
            assert (s.first_doc_id is not None, s.first_doc_id or 0) <= (s.doc_id is not None, s.doc_id or 0)
            end = s.span_start + len(piece)
            found[name][s.span_start : end] = b"x" * len(piece)
            if words >= 16 and len(piece.decode()) < 128:
                assert 0 not in covered[name][s.span_start : end]
        assert runs
        for name, a, b, other, at in runs:
            if other == name and at + (b - a) > a:
                continue  # one word again and again overlaps itself: such a stretch has no cuts of its own
            # Cuts that only what lies within the run decides: REACH places, and the hash's bytes, from its ends.
            data = texts[name]
            starts = [m.start() for m in re.finditer(rb"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]", data[a:b])]
            low, high = a + starts[4] + 16, a + starts[-4] - 16
            edges = [e for e in substrings.cuts(data).tolist() if low <= e <= high]
            if len(edges) > 1 and len(data[edges[0] : edges[-1]].split()) >= 16:
                missed = bytes(c for c, x in zip(data[edges[0] : edges[-1]], found[name][edges[0] : edges[-1]], strict=True) if not x)
                assert len(missed.split()) < 16


def test_text_without_spaces_and_short_copies_are_found(spark):
    rng = random.Random(5)
    chinese = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400))
    code = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(3000))
    texts = [chinese, code, "a few words only", "头" + chinese + "尾", "x" + code[:1500] + "y" + code[1500:], "a few words only", "a few words more"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id: r.text for r in substrings.remove(df).collect()}
    assert [kept[i] for i in (0, 1, 2, 5, 6)] == [chinese, code, texts[2], "", texts[6]]
    assert len(kept[3]) < 60 and len(kept[4]) < 400
    assert {(s.doc_id, s.first_doc_id) for s in substrings.repeats(df).collect()} == {(3, 0), (4, 1), (5, 2)}


def test_one_passage_in_nearly_all_texts(spark, monkeypatch):
    """Nine tenths of the rows hold one passage, over many blocks: the split step gives what the plain one does."""
    rng = random.Random(2)
    shared = passage(rng, 60)
    rows = [(i, f"{passage(rng, 30)} {shared if i % 10 else ''} {passage(rng, 20)}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    plain = sorted(map(tuple, substrings.repeats(df).collect()))
    monkeypatch.setattr(substrings, "HOT", 2)
    monkeypatch.setattr(substrings, "SPLIT", 4)
    assert sorted(map(tuple, substrings.repeats(df).collect())) == plain
    assert {r[0] for r in plain} == {i for i, _ in rows if i % 10 and i > 1}


def test_odd_rows(odd, none):
    cut = substrings.remove(odd)
    assert cut.columns == odd.columns
    assert cut.count() == odd.count()
    by_id = {}
    for r in cut.collect():
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[3][0].text is None and by_id[4][0].text == ""
    first = sorted(len(r.text) for r in by_id[1])
    assert first[1] == first[2] > 500 > first[0]  # both repeated rows stay whole, the third loses what they have
    assert all(r.n_chars == len(r.text) for rows in by_id.values() for r in rows if r.text is not None)
    assert substrings.remove(none).count() == 0
    assert substrings.repeats(none).count() == 0
