"""Byte-level BPE encoding by automaton and backtracking, and decoding.

Bytes are mapped to Latin-1 so that pyahocorasick finds every vocabulary item
in a piece of text. From a position the longest item is tried first; it is
kept if, merged side by side, it and the item before it would stay two items
(``Vocabulary.stay_apart``, memoised), else the next shorter one is tried, and
when none fits, the item before is taken back. Positions that led nowhere are
never entered again, so the work is linear in the piece's length, and the
result is that of merging by rank.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import gives_back, short_batches, with_fields
from tessera.llm.memo import Memo

#: Entries of each half of a worker's memos of units and pieces of text.
MEMO_UNITS, MEMO_PIECES = 100_000, 160_000
#: Longer units are rare; they aren't kept.
MEMO_CHARS = 64
_OPEN = 1 << 62
#: The public pattern that cuts text into pieces, and marks that follow a word.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MARKS = ".,;:!?$*&%|()-"


class Vocabulary:
    """Ranks of byte strings; a rank is both the id and the order of merging."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.apart: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for b, i in sorted(ranks.items(), key=lambda x: x[1]):
            self._learn(b, i)
        self.pieces, self.units = Memo(MEMO_PIECES), Memo(MEMO_UNITS)
        self.plain = pattern == PATTERN

    def _learn(self, b: bytes, i: int) -> None:
        """Find the two items whose merge makes item ``i``; a byte has none."""
        for cut in range(len(b) - 1, 0, -1):
            left, right = self.ranks.get(b[:cut]), self.ranks.get(b[cut:])
            if left is not None and right is not None and left < i and right < i and self.stay_apart(left, right):
                self.halves[i] = left, right
                self.merged[left, right] = i
                self.apart.pop((left, right), None)
                return

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges that make ``left`` and ``right`` leave their seam alone.

        Both items are undone merge by merge, latest first. At every step the
        two items at the seam are tested: a merge of them that comes before
        the one just undone would have been made instead.
        """
        key = (left, right)
        known = self.apart.get(key)
        if known is None:
            known = self.apart[key] = self._stay_apart(left, right)
            if len(self.apart) > 2_000_000:
                self.apart.clear()
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        before = _OPEN  # only merges of a lower rank than this can have come first
        merged, halves = self.merged, self.halves
        while True:
            if merged.get((left, right), _OPEN) < before:
                return False
            inner_left, inner_right = halves.get(left), halves.get(right)
            if inner_left is None and inner_right is None:
                return True
            # Undo the later of the two merges. On equal ranks the left one was made first.
            if inner_right is None or (inner_left is not None and left > right):
                before, left = left, inner_left[1]
            else:
                before, right = right + 1, inner_right[0]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(piece.decode("latin-1")):
            starts[end + 1 - found[0]].append(found)  # by growing length, as the ends grow
        shut = bytearray(n + 1)  # ends of items from which the rest can't be done
        path: list[tuple[int, int]] = []  # (item, where it starts)
        left = [len(x) for x in starts]  # items yet to be tried at each start
        at, last = 0, -1
        while at < n:
            options, k = starts[at], left[at]
            while k:
                k -= 1
                size, item = options[k]
                if not shut[at + size] and (last < 0 or self.stay_apart(last, item)):
                    break
            else:
                if not path:
                    raise ValueError(f"no encoding of {piece!r} from byte {at}")
                shut[at] = 1
                last, at = path.pop()
                last = path[-1][0] if path else -1
                continue
            left[at] = k
            path.append((item, at))
            at += size
            last = item
            if at < n:
                left[at] = len(starts[at])
        return tuple(x for x, _ in path)

    def _encode_unit(self, unit: str) -> tuple[int, ...]:
        ids: list[int] = []
        for piece in self._pieces_of(unit):
            got = self.pieces.get(piece)
            if got is None:
                got = self.encode_piece(piece.encode())
                if len(piece) <= MEMO_CHARS:
                    self.pieces.put(piece, got)
            ids += got
        return tuple(ids)

    def _pieces_of(self, unit: str) -> list[str]:
        """The pattern's matches; a word and the marks after it need no search."""
        word = unit.rstrip(_MARKS) if self.plain else ""
        if (word[1:] if word[:1] == " " else word).isalpha() and max(word) < "\u0250":
            return [word, unit[len(word) :]] if len(word) < len(unit) else [word]
        return self.pattern.findall(unit)

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, each match of the pattern on its own.

        No match of the public pattern spans a space that follows another
        kind of character, so the text is cut there first and each unit
        looked up. Under any other pattern the text is one unit.
        """
        out: list[tuple[int, ...]] = []
        units = _units(text) if self.plain else [text]
        young = self.units.young
        for unit, ids in zip(units, map(young.get, units), strict=True):
            if ids is None:
                ids = self.units.get(unit)
                if ids is None:
                    ids = self._encode_unit(unit)
                    if len(unit) <= MEMO_CHARS:
                        self.units.put(unit, ids)
            out.append(ids)
        return list(chain.from_iterable(out))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the items; an unknown id is a ``KeyError``."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


#: A space after white space: the two may belong to one match.
_MIXED = re.compile(r" (?<=\s )")


def _units(text: str) -> list[str]:
    """The text cut before spaces that end a run of other characters."""
    if text[:1] != " " and "\0" not in text and not _MIXED.search(text):
        return text.replace(" ", "\0 ").split("\0") if text else []
    parts, units = text.split(" "), []
    for i, part in enumerate(parts):
        if not i:
            units.append(part)
        elif units[-1] and not units[-1][-1].isspace():
            units.append(" " + part)
        else:
            units[-1] += " " + part
    return [u for u in units if u]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines with a base64 item and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(2)
def load(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of a rank file, once for each worker."""
    return Vocabulary(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, keep: list[str], text: str = "text", with_ids: bool = False) -> DataFrame:
    """``keep``'s columns of every row with the digests of its encoding.

    Adds n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 (of the bytes that the ids decode to) and, on request, the
    ids themselves. A null text is encoded as an empty one: no ids. Repeated
    rows are encoded each; an empty table gives an empty result. A very long
    text is encoded unit by unit and costs some fifty times its size in
    memory, mostly its ids. ``ranks`` is a path that every machine can open;
    other columns are left out.
    """

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(ranks, pattern)
        decimal = {i: str(i) for i in vocabulary.bytes_of}
        for batch in batches:
            n, encoded, decoded, lists = [], [], [], []
            for value in batch.column(0).to_pylist():
                ids = vocabulary.encode(value or "")
                n.append(len(ids))
                encoded.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(vocabulary.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(pa.array(ids, pa.int32()))
            columns = [*batch.columns[1:], pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
            names = [*batch.schema.names[1:], "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                offsets = pa.array([0, *_running(n)], pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(lists) if lists else pa.array([], pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    short_batches(docs.sparkSession)
    rows = docs.select(F.col(text).cast("string").alias("_text"), *keep)
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, with_fields(rows, rows.columns[1:], added))


def _running(counts: list[int]) -> Iterator[int]:
    total = 0
    for x in counts:
        total += x
        yield total
