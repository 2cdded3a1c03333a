"""Token ids of texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary files lie; a parameter of every operator here.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Fixed value: how byte_bpe_50k cuts a text into pieces before merging, as published with it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ids of so many pieces are remembered, of pieces up to so many characters.
REMEMBERED, REMEMBERED_CHARS = 200_000, 40


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a line for each token, in base 64, and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class Encoder:
    """Ids of texts. Merging uses a segment tree over the ranks of adjacent pairs."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.piece_at = regex.compile(PIECES)
        self.memory: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece. The root of the tree is the leftmost pair of lowest rank.

        A node holds rank * width + place, so that the minimum prefers the lowest
        rank and then the leftmost place. A merge removes one part and changes the
        pairs on its two sides: three point updates, each as deep as the tree.
        """
        ranks, n = self.ranks, len(piece)
        if n == 1:
            return [ranks[piece]]
        width = 1 << (n - 2).bit_length() if n > 2 else 1
        none = 1 << 62
        end = list(range(1, n + 1))  # where the part that begins here ends
        before = list(range(-1, n))  # where the part before begins
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                tree[width + i] = rank * width + i
        for at in range(width - 1, 0, -1):
            a, b = tree[2 * at], tree[2 * at + 1]
            tree[at] = a if a < b else b

        def put(i: int, key: int) -> None:
            at = width + i
            tree[at] = key
            while at > 1:
                at >>= 1
                a, b = tree[2 * at], tree[2 * at + 1]
                least = a if a < b else b
                if tree[at] == least:
                    break
                tree[at] = least

        def pair(i: int) -> int:
            middle = end[i]
            if middle >= n:
                return none
            rank = ranks.get(piece[i : end[middle]])
            return none if rank is None else rank * width + i

        while tree[1] < none:
            i = tree[1] % width
            gone = end[i]
            end[i] = end[gone]
            if end[i] < n:
                before[end[i]] = i
            if gone < n - 1 and tree[width + gone] < none:
                put(gone, none)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def ids_of(self, piece: str) -> Sequence[int]:
        """The ids of a piece; one that is a token as a whole is that token."""
        known = self.memory.get(piece)
        if known is None:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            known = (whole,) if whole is not None else tuple(self.merge(raw))
            if len(piece) <= REMEMBERED_CHARS:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[piece] = known
        return known

    def encode_into(self, text: str, out: array) -> None:
        """Append the ids of a text to ``out``."""
        get, slow = self.memory.get, self.ids_of
        for piece in self.piece_at.findall(text):
            out.extend(get(piece) or slow(piece))

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        out = array("i")
        self.encode_into(text, out)
        return out.tolist()


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = VOCABULARY, folder: str = TOKENIZERS) -> Encoder:
    """The encoder of a vocabulary, made once in each Python process."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(read_ranks(path))
    return _ENCODERS[path]


def _flat(texts: pa.Array, enc: Encoder) -> tuple[array, array]:
    ids, ends = array("i"), array("i", [0])
    for text in texts:
        value = text.as_py()
        if value:
            enc.encode_into(value, ids)
        ends.append(len(ids))
    return ids, ends


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): the ids of every text, taken exactly as stored, without special tokens.

    A null text and an empty text both give the empty list. Texts may be of any
    length; a piece of n bytes without a break costs n log n. No shuffle.
    ``folder`` must hold the vocabulary on every executor.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for batch in batches:
            ids, ends = _flat(batch.column(1), enc)
            lists = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(ids), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(key, text).mapInArrow(encode, f"{key} {kind}, ids array<int>")


def counter(name: str = VOCABULARY, folder: str = TOKENIZERS) -> Callable[[str], int]:
    """A function that gives the number of a text's tokens."""
    enc = encoder(name, folder)
    get, slow, pieces = enc.memory.get, enc.ids_of, enc.piece_at.findall
    return lambda text: sum(len(get(piece) or slow(piece)) for piece in pieces(text))


def token_counts(docs: DataFrame, text: str = "text", count: str = "tokens", name: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """The columns of ``docs`` without the text, and the number of its tokens (0 for null and empty texts)."""
    keep = [c for c in docs.columns if c not in (text, count)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for batch in batches:
            _, ends = _flat(batch.column(len(keep)), enc)
            sizes = pa.array([b - a for a, b in zip(ends, ends[1:], strict=False)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), sizes], names=[*keep, count])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, text).mapInArrow(measure, f"{schema}, {count} bigint")
