import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import tokenfile
from tessera.storage import new_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(rows, library):
    at, out = 0, []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_hold_what_the_library_gives(spark, documents, rows, library):
    folder = new_path(spark, "tokens")
    tokenfile.write(documents, PATH, folder, end_id=1)
    got = [tuple(r) for r in tokenfile.read(spark, folder).orderBy("doc_id").collect()]
    assert got == expected(sorted((r["doc_id"], r["text"]) for r in rows), library)
    about = tokenfile.manifest(folder)
    assert about["width"] == 2
    first = about["shards"][0]
    ids, offsets, doc_ids, null = tokenfile.open_shard(folder, first["name"], 2)
    assert isinstance(ids, np.memmap)
    assert len(doc_ids) == first["n_docs"]
    assert offsets[-1] == len(ids) == first["n_tokens"]
    assert not null.any()
    with_ids = tokenfile.read(spark, folder, with_ids=True).filter("doc_id = 0").first()
    assert with_ids.ids == [*library.encode(rows[0]["text"], add_special_tokens=False).ids, 1]


def test_odd_rows(spark, odd, none, library):
    folder = new_path(spark, "tokens")
    tokenfile.write(odd, PATH, folder, end_id=1)
    got = [tuple(r) for r in tokenfile.read(spark, folder).collect()]
    hashed = odd.selectExpr("doc_id", "text", "xxhash64(coalesce(text, ''))").collect()
    order = sorted(hashed, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    assert sorted(got, key=lambda r: r[1]) == expected([(r[0], r[1]) for r in order], library)
    empty = new_path(spark, "tokens")
    tokenfile.write(none, PATH, empty, end_id=1)
    assert json.loads(json.dumps(tokenfile.manifest(empty)))["shards"] == []
    assert tokenfile.read(spark, empty).count() == 0
