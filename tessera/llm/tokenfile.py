"""Token ids in flat binary files with 64-bit document offsets.

A folder holds, for each shard ``k``,

* ``shard-k.bin``: the ids of its documents one after another, as little-endian
  unsigned integers of 2 bytes where the vocabulary fits, else of 4;
* ``shard-k.idx``: 64-bit integers: the number n of documents, n + 1 offsets
  into the shard (in ids), n document ids; then n bytes, 1 for a null id;

and ``manifest.json`` with the width and, for each shard, how many documents
and ids come before it. Those bases are prefix sums over one row a shard, so
no task needs to know another's data. Readers map the files into memory.
"""

from __future__ import annotations

import io
import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import partitions, short_batches
from tessera.llm.memo import Memo

#: Entries of each half of a worker's memo of words.
MEMO_WORDS, MEMO_CHARS = 350_000, 64
#: Rows of a batch that a reader returns.
READ_ROWS = 50_000
#: The word tokenizers' pattern, and letters that it keeps together, then marks that it keeps together.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[!-&(-/:;=-@\[-`{-~]*)$"


def _byte_characters() -> dict[int, str]:
    """The public byte-level alphabet: a byte that prints stands for itself, the others follow from 256 on."""
    prints = [chr(b).isprintable() and chr(b) != " " for b in range(256)]
    return {b: chr(b if prints[b] else 256 + sum(not x for x in prints[:b])) for b in range(256)}


_BYTES = _byte_characters()


def _local(path: str) -> str | None:
    """The plain path of a local file, None for another store."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def _write(path: str, fill: Callable[[BinaryIO], object]) -> None:
    """Create ``path`` whole or not at all: attempts that run twice don't meet."""
    aside = f"{path}.{uuid.uuid4().hex}"
    local = _local(path)
    if local:
        temporary = _local(aside)
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with open(temporary, "wb") as out:
                fill(out)
            os.replace(temporary, local)
        except BaseException:
            if os.path.exists(temporary):
                os.remove(temporary)
            raise
        return
    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(name))
    temporary = fs.FileSystem.from_uri(aside)[1]
    try:
        with store.open_output_stream(temporary) as out:
            fill(out)
        store.move(temporary, name)  # replaces a file that an earlier attempt left
    except BaseException:
        if store.get_file_info(temporary).type != fs.FileType.NotFound:
            store.delete_file(temporary)
        raise


def _map(path: str, dtype: str) -> np.ndarray:
    """A file as an array: mapped where it is local, else read."""
    local = _local(path)
    if local:
        return np.memmap(local, dtype=dtype, mode="r") if os.path.getsize(local) else np.empty(0, dtype)
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``which`` of ``flat``, one after another, and the length of each."""
    n = sizes[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[which] - (ends - n), n) + np.arange(total)], n


class WordEncoder:
    """Ids of texts by the tokenizers library, which sees each word once.

    For tokenizers that drop white space: no token of theirs spans it, so a
    text's ids are those of its words. A batch of texts is split into words
    and its distinct words are numbered by Arrow; only those are looked up in
    a bounded memo or asked of the library, and ids are gathered by number.

    Most words are Latin letters and then marks, which the pattern keeps
    apart. For tokenizers that only lower-case such letters, the library's
    model is asked for the letters and the marks on their own; any other word
    goes through the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.width = 2 if self.library.get_vocab_size() <= 65_536 else 4
        self.dtype = f"<u{self.width}"
        self.memo = Memo(MEMO_WORDS)
        with open(path, encoding="utf-8") as file:
            about = json.load(file)
        split, bytes_ = [*((about["pre_tokenizer"] or {}).get("pretokenizers") or ()), None, None][:2]
        steps = [x["type"] for x in (about["normalizer"] or {}).get("normalizers", ())]
        self.direct = (
            steps == ["NFC", "Replace", "Lowercase"]
            and (split or {}).get("pattern") == {"Regex": _PATTERN}
            and (bytes_ or {}).get("type") == "ByteLevel"
            and not bytes_["add_prefix_space"]
        )

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has; ``end_id`` ends each."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        first, second, flat, starts, sizes = self._pieces(words.dictionary)
        flat, sizes = _gather(flat, starts, sizes, np.column_stack((first, second)).ravel())
        sizes = sizes[0::2] + sizes[1::2]  # now of whole words
        if end_id is not None:
            flat, sizes = np.append(flat, np.array([end_id], flat.dtype)), np.append(sizes, 1)
        starts = np.cumsum(sizes) - sizes
        bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))))
        which = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if end_id is not None:
            which = np.insert(which, bounds[1:], len(sizes) - 1)
            bounds = bounds + np.arange(len(bounds))
        ids, n = _gather(flat, starts, sizes, which)
        ends = np.concatenate(([0], np.cumsum(n)))
        return ids, np.diff(ends[bounds])

    def _pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two pieces of each word, as numbers, and the pieces' ids: flat, starts and sizes."""
        parts = pc.extract_regex(words, pattern=_PLAIN if self.direct else "^(?P<letters>)(?P<marks>)$")
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        both = parts.filter(pa.array(plain))
        letters, marks = pc.utf8_lower(pc.struct_field(both, 0)).dictionary_encode(), pc.struct_field(both, 1).dictionary_encode()
        odd = words.filter(pa.array(~plain)).to_pylist()
        encoded = [b"", *self._models(letters.dictionary.to_pylist()), *self._models(marks.dictionary.to_pylist()), *self._wholes(odd)]
        first, second = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        first[plain] = 1 + letters.indices.to_numpy(zero_copy_only=False)
        second[plain] = 1 + len(letters.dictionary) + marks.indices.to_numpy(zero_copy_only=False)
        first[~plain] = len(encoded) - len(odd) + np.arange(len(odd))
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // self.width
        return first, second, np.frombuffer(b"".join(encoded), self.dtype), np.cumsum(sizes) - sizes, sizes

    def _known(self, pieces: list[str], ask: Callable[[list[str]], Iterator[list[int]]]) -> list[bytes]:
        """Ids as bytes, from the memo or by ``ask``."""
        out = list(map(self.memo.get, pieces))
        missing = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(missing, ask([pieces[i] for i in missing]), strict=True):
            out[i] = np.array(ids, self.dtype).tobytes()
            if len(pieces[i]) <= MEMO_CHARS:
                self.memo.put(pieces[i], out[i])
        return out

    def _models(self, pieces: list[str]) -> list[bytes]:
        """Pieces that are one match of the pattern and in normal form."""
        tokenize = self.model.tokenize
        return self._known(pieces, lambda new: ([t.id for t in tokenize(w.encode().decode("latin-1").translate(_BYTES))] for w in new))

    def _wholes(self, words: list[str]) -> list[bytes]:
        return self._known(words, lambda new: (x.ids for x in self.library.encode_batch_fast(new, add_special_tokens=False)))


@lru_cache(2)
def load(path: str) -> WordEncoder:
    """The encoder of a tokenizer file, once for each worker."""
    return WordEncoder(path)


def _index(offsets: np.ndarray, ids: list[np.ndarray], null: list[np.ndarray]) -> Callable[[BinaryIO], None]:
    def fill(out: BinaryIO) -> None:
        out.write(np.array([len(offsets) - 1, *offsets], "<i8").tobytes())
        for part in (*ids, *null):
            out.write(part.tobytes())

    return fill


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None) -> None:
    """Encode every text of ``docs`` (doc_id, text) into files below ``folder``.

    Documents are in ascending order of doc_id, null ids first, rows with
    equal ids in order of a hash of the text. A null text counts as an empty
    one; ``end_id``, if given, ends every document. An empty table gives a
    manifest without shards. A task that runs again writes the same files.
    Batches are bounded in bytes, so a very long text costs a few times its
    own size. Other columns of ``docs`` are left out.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(partitions(docs), "doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = load(tokenizer), TaskContext.get().partitionId()
        sizes, ids, null = [np.zeros(1, np.int64)], [], []

        def fill(out: BinaryIO) -> None:
            for batch in batches:
                encoded, n = encoder.encode(batch.column(1), end_id)
                out.write(encoded.tobytes())
                sizes.append(n)
                ids.append(pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False).astype("<i8"))
                null.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))

        name = f"{folder}/shard-{shard:06d}"
        _write(f"{name}.bin", fill)
        offsets = np.cumsum(np.concatenate(sizes))
        _write(f"{name}.idx", _index(offsets, ids, null))
        if ids:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(offsets) - 1], "n_tokens": [int(offsets[-1])]})

    found = sorted(map(tuple, rows.select("doc_id", "text").mapInArrow(run, "shard long, n_docs long, n_tokens long").collect()))
    shards, doc_base, token_base = [], 0, 0
    for shard, n_docs, n_tokens in found:
        shards.append({"name": f"shard-{shard:06d}", "n_docs": n_docs, "n_tokens": n_tokens, "doc_base": doc_base, "token_base": token_base})
        doc_base, token_base = doc_base + n_docs, token_base + n_tokens
    manifest = json.dumps({"width": WordEncoder(tokenizer).width, "n_docs": doc_base, "n_tokens": token_base, "shards": shards})
    _write(f"{folder}/manifest.json", lambda out: out.write(manifest.encode()))


def manifest(folder: str) -> dict:
    """What ``write`` left in ``folder``."""
    return json.load(io.BytesIO(_map(f"{folder}/manifest.json", "u1").tobytes()))


def open_shard(folder: str, name: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, document ids, which ids are null) of one shard, mapped."""
    ids, index = _map(f"{folder}/{name}.bin", f"<u{width}"), _map(f"{folder}/{name}.idx", "u1")
    n = int(index[:8].view("<i8")[0])
    body = index[8 : 8 * (2 * n + 2)].view("<i8")
    return ids, body[: n + 1], body[n + 1 :], index[8 * (2 * n + 2) :].astype(bool)


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row a document: doc_id, start, n_tokens, ids_crc32 and, on request, ids.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is over
    the ids as little-endian unsigned 32-bit integers.
    """
    about = manifest(folder)
    width = about["width"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not about["shards"]:
        return spark.createDataFrame([], schema)
    shards = spark.createDataFrame([(x["name"], x["token_base"]) for x in about["shards"]], "name string, base long").repartition(len(about["shards"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, offsets, doc_ids, null = open_shard(folder, name, width)
                rows = READ_ROWS if not with_ids else 500
                for a in range(0, len(doc_ids), rows):
                    b = min(a + rows, len(doc_ids))
                    sums = [zlib.crc32(ids[offsets[i] : offsets[i + 1]].astype("<u4").tobytes()) for i in range(a, b)]
                    columns = [
                        pa.array(np.array(doc_ids[a:b]), pa.int64(), mask=null[a:b]),
                        pa.array(base + np.array(offsets[a:b])),
                        pa.array(np.diff(offsets[a : b + 1])),
                        pa.array(sums, pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([ids[offsets[i] : offsets[i + 1]].astype(np.int64) for i in range(a, b)], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    return shards.mapInArrow(run, schema)
