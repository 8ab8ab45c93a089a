import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_the_pattern_is_the_public_one():
    assert bpe.PATTERN == public_tokenizers.PATTERN


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("ab .,'\n\t é日's", max_size=40))
def test_ids_are_those_of_merging_by_rank(text):
    ranks = bpe.load(PATH, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    ids = ranks.encode(text)
    assert ids == library.encode_ordinary(text)
    assert ranks.decode(ids) == text.encode()


def test_long_pieces_take_linear_work():
    ranks = bpe.load(PATH, public_tokenizers.PATTERN)
    assert ranks.decode(ranks.encode("abcdefgh" * 20_000)) == b"abcdefgh" * 20_000


def test_every_document(documents, rows, library):
    got = {r.doc_id: r for r in bpe.encode_documents(documents, PATH, public_tokenizers.PATTERN, ["doc_id"], with_ids=True).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r["text"])
        g = got[r["doc_id"]]
        assert (g.n_tokens, g.ids) == (len(ids), ids)
        assert g.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(r["text"].encode()).hexdigest()


def test_odd_rows(odd, none, library):
    got = bpe.encode_documents(odd, PATH, public_tokenizers.PATTERN, ["doc_id", "text"]).collect()
    assert len(got) == odd.count()
    for r in got:
        assert r.n_tokens == len(library.encode_ordinary(r.text or ""))
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode_documents(none, PATH, public_tokenizers.PATTERN, ["doc_id"]).count() == 0
