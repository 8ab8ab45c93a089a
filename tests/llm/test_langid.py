import zlib

from tessera.llm import langid


def test_held_out_accuracy(documents, rows):
    got = {r.doc_id: r for r in langid.identify(documents).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {r["doc_id"] for r in held} == {i for i, g in got.items() if g.held_out}
    assert sum(got[r["doc_id"]].lang_pred == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= g.score <= 1 for g in got.values())


def test_the_vectors_of_trigrams_are_bound_letters():
    first, second, third = langid._letters()
    v = langid._Trigrams().of(langid.np.array([1 << 14 | 2 << 7 | 3]))
    assert (v[0] == first[1] * second[2] * third[3]).all()
    assert (first[5] == langid.np.roll(third[5], 2)).all()


def test_odd_rows(odd, none):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    by_text = {(r.doc_id): r for r in got}
    for i in (3, 4, 5, 7):
        assert (by_text[i].lang_pred, by_text[i].score) == ("und", 0.0)
    assert not by_text[None].held_out
    assert langid.identify(none).count() == 0
    unlabelled = langid.identify(odd.filter("lang is null")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_prediction_ignores_label_source_and_neighbours(odd):
    model = langid.fit(odd)
    whole = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.predict(odd, model, ["doc_id", "text"]).collect()}
    alone = langid.predict(odd.filter("doc_id = 6").drop("lang", "source"), model, ["doc_id", "text"]).first()
    other = whole[alone.doc_id, alone.text]
    assert alone.lang_pred == other[0]
    assert abs(alone.score - other[1]) < 1e-6
