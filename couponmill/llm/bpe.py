"""Byte-pair encoding and decoding with a public byte-level vocabulary file.

The vocabulary file (JSON: ``model.vocab``, ``model.merges``, ``added_tokens``)
is read on every worker from ``path``; it is never trained or copied.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from couponmill.llm.shipping import ship
from couponmill.llm.words import slices

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
# A worker remembers the merges of up to twice as many pieces.
REMEMBERED = 150_000
# White space, letters and numbers below U+0180, and how a text is cut into pieces.
_SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_LATIN_LETTERS = r"A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\u017F"
_LATIN_NUMBERS = r"0-9\xB2\xB3\xB9\xBC-\xBE"


def pattern(letters: str, numbers: str) -> str:
    """Pieces of a text: words, numbers, other signs and white space."""
    return (
        rf" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{numbers}]+| ?[^{_SPACE}{letters}{numbers}]+"
        rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )


_beyond_latin = re.compile(r"[^\x00-\u017F]").search
# The standard module is faster but has no Unicode classes.
_latin_pieces = re.compile(pattern(_LATIN_LETTERS, _LATIN_NUMBERS)).findall
_pieces = regex.compile(pattern(r"\p{L}", r"\p{N}")).findall


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Pieces(dict):
    """Ids of pieces seen lately; when full, pieces not used since the last time are forgotten."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            codec = self.codec
            # The bytes of 32-bit integers join fast and take little room.
            ids = array("i", codec.merge([codec.byte_ids[b] for b in piece.encode()])).tobytes()
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """One vocabulary in memory."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary = content["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.byte_ids = [vocabulary[s] for s in symbols]
        self.size = 1 + max([*vocabulary.values(), *(t["id"] for t in content["added_tokens"])])
        # left id * size + right id -> rank; rank -> id of the two joined
        self.ranks: dict[int, int] = {}
        self.joined: list[int] = []
        for rank, pair in enumerate(content["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocabulary[left] * self.size + vocabulary[right]] = rank
            self.joined.append(vocabulary[left + right])
        self.added = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.strings: list[bytes] = [b""] * self.size
        for token, i in vocabulary.items():
            if token not in self.added:
                self.strings[i] = bytes(byte_of[c] for c in token)
        for token, i in self.added.items():
            self.strings[i] = token.encode()
        self._added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self._pieces = _Pieces(self)

    def merge(self, ids: list[int]) -> list[int]:
        """Join adjacent symbols, lowest rank first and then from the left.

        The symbols are a doubly linked list; a queue entry whose two symbols
        have changed since it was made is stale and skipped.
        """
        n, size, rank_of, joined = len(ids), self.size, self.ranks.get, self.joined
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # An entry is the rank above the position in one integer.
        queue = [
            rank << 40 | i for i in range(n - 1) if (rank := rank_of(ids[i] * size + ids[i + 1])) is not None
        ]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            rank, i = entry >> 40, entry & 0xFFFFFFFFFF
            j, left = after[i], ids[i]
            if left < 0 or j >= n or rank_of(left * size + ids[j]) != rank:
                continue
            ids[i] = merged = joined[rank]
            ids[j] = -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (rank := rank_of(merged * size + ids[j])) is not None:
                    heapq.heappush(queue, rank << 40 | i)
            h = before[i]
            if h >= 0 and (rank := rank_of(ids[h] * size + merged)) is not None:
                heapq.heappush(queue, rank << 40 | h)
        return [x for x in ids if x >= 0]

    def _ordinary(self, text: str) -> bytes:
        find = _pieces if _beyond_latin(text) else _latin_pieces
        return b"".join(map(self._pieces.__getitem__, find(text)))

    def encode_ordinary(self, text: str) -> np.ndarray:
        """Ids of a text in which nothing is an added token."""
        return np.frombuffer(self._ordinary(text), np.int32)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; the strings of added tokens become their ids."""
        parts, at = [], 0
        for found in self._added.finditer(text):
            parts += [self._ordinary(text[at : found.start()]), np.int32(self.added[found.group()]).tobytes()]
            at = found.end()
        return np.frombuffer(b"".join([*parts, self._ordinary(text[at:])]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: their vocabulary strings, one after another."""
        return b"".join(map(self.strings.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


# Bytes of text worked on at once.
PART_BYTES = 1 << 20


def _plus(df: DataFrame, names: list[str], **added: T.DataType) -> T.StructType:
    return T.StructType([*[df.schema[c] for c in names], *[T.StructField(c, t) for c, t in added.items()]])


def id_lists(rows: list[np.ndarray]) -> pa.Array:
    """An Arrow list column of 32-bit ids."""
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def encode(
    df: DataFrame, text: str = "text", out: str = "ids", path: str = VOCABULARY, decoded: str | None = None
) -> DataFrame:
    """Add ``out``, the token ids of the whole ``text``; a column of that name is replaced.

    With ``decoded``, also add the text that the ids decode to, made in the same
    pass by the same worker.  NULL and empty texts have no ids.  Equal rows give
    equal rows, an empty table an empty one, and the other columns pass through.
    """
    ship(df.sparkSession)
    names = [c for c in df.columns if c not in (out, decoded)]
    added = {out: T.ArrayType(T.IntegerType()), **({decoded: T.StringType()} if decoded else {})}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch, text, PART_BYTES):
                ids = [c.encode(x.as_py() or "") for x in part.column(text)]
                made = [id_lists(ids)]
                if decoded:
                    made.append(pa.array([c.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*map(part.column, names), *made], [*names, *added])

    return df.mapInArrow(run, _plus(df, names, **added))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str = VOCABULARY) -> DataFrame:
    """Add ``out``, the text of the token ids; NULL ids give an empty text."""
    ship(df.sparkSession)
    names = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_text = codec(path).decode
        none = np.zeros(0, np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [to_text(x.values.to_numpy() if x.is_valid else none) for x in part.column(ids)]
                yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array(texts, pa.string())], [*names, out])
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, _plus(df, names, **{out: T.StringType()}))
