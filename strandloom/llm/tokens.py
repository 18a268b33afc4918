"""Byte-pair encoding with a public vocabulary by prefix dynamic programming.

The encoding of every prefix of a piece ends with exactly one token. It is the token that ends the prefix and, after the
last token of the rest, is a *lasting* pair: the byte-pair merges of both together would leave them apart. So one array
of last tokens holds the encodings of all prefixes; following it backwards gives the encoding. Appending bytes only
appends to the array, and after an edit it is computed anew from there on until it runs as before.

Texts are split by the vocabulary's pattern first, and equal pieces are encoded once per worker.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Splits texts before the merges of byte_bpe_50k and byte_bpe_multi_50k (fixed, public).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers before it forgets them all.
MOST_PIECES = 1_000_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """A rank file of the installed public tokenizers, or the path itself."""
    if os.path.sep in name:
        return name
    found = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(found.origin) if found else "/opt/tokenizers"
    return os.path.join(folder, name)


class Vocabulary:
    """Tokens by rank: ids of bytes, the two parts each token is merged from, and which pairs last."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ids = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._merged(token)
                if len(parts) == 2:
                    self.pairs[parts[0], parts[1]] = i
                    self.parts[i] = parts[0], parts[1]
        self._lasting: dict[tuple[int, int], bool] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}
        self._right: dict[int, list[tuple[int, float]]] = {}

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def _merged(self, data: bytes) -> list[int]:
        """Byte-pair merges by the pairs known so far, least rank first."""
        parts = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(parts) > 1:
            least = min((self.pairs.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if least[0] == 1 << 60:
                break
            parts[least[1] : least[1] + 2] = [least[0]]
        return parts

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts at the left (0) or right (1) edge of a token, largest first, each with the rank that swallows it."""
        known = (self._left, self._right)[side]
        if token not in known:
            out, until = [(token, float("inf"))], token
            while until in self.parts:
                part = self.parts[until][side]
                out.append((part, until))
                until = part
            known[token] = out
        return known[token]

    def lasting(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both gives a and b again.

        It does unless some part at the right edge of a and some part at the left edge of b are merged while both
        are there: before a merge within b takes its part (at equal rank the one further left comes first, so strictly
        before one within a).
        """
        pair = a, b
        known = self._lasting.get(pair)
        if known is None:
            known = True
            for x, x_until in self._edge(a, 1):
                for y, y_until in self._edge(b, 0):
                    rank = self.pairs.get((x, y))
                    if rank is not None and rank < x_until and rank <= y_until:
                        known = False
            if len(self._lasting) > 4_000_000:
                self._lasting.clear()
            self._lasting[pair] = known
        return known

    def extend(self, last: list[int], data: bytes, done: int) -> None:
        """Make last, the last tokens of the prefixes of data up to done bytes, complete."""
        ids, lasting, longest, tokens = self.ids, self.lasting, self.longest, self.tokens
        for end in range(done + 1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = ids.get(data[start:end])
                if token is not None and (lasting(last[start], token) if start else token in self.parts or end == 1):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token for a byte of {tokens}")

    def encode(self, data: bytes) -> list[int]:
        """Tokens of one piece."""
        whole = self.ids.get(data)
        if whole is not None and (whole in self.parts or len(data) == 1):
            return [whole]
        last = [-1]
        self.extend(last, data, 0)
        return self.walk(last)

    def walk(self, last: list[int], until: int = 0) -> list[int]:
        out, at = [], len(last) - 1
        while at > until:
            out.append(last[at])
            at -= len(self.tokens[last[at]])
        return out[::-1]


class Piece:
    """The encoding of one piece of bytes that can be appended to and edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, data, [-1]
        vocabulary.extend(self.last, data, 0)

    def append(self, data: bytes) -> None:
        before = len(self.data)
        self.data += data
        self.vocabulary.extend(self.last, self.data, before)

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put data in place of the bytes from start to stop; returns how many prefixes were encoded anew."""
        v, old, moved = self.vocabulary, self.last, len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        self.last, new = old[: start + 1], 0
        same = 0
        while len(self.last) <= len(self.data):
            end = len(self.last)
            v.extend(self.last, self.data[:end], end - 1)
            new += 1
            past = end - moved
            same = same + 1 if past > stop and old[past] == self.last[end] else 0
            if same >= v.longest:  # a last token depends on the ones up to the longest token before
                self.last += old[past + 1 :]
                break
        return new

    def ids(self) -> list[int]:
        return self.vocabulary.walk(self.last)


class Text:
    """The encoding of a whole text that can be appended to and edited; only pieces near an edit are encoded anew."""

    def __init__(self, encoder: Encoder, text: str = "") -> None:
        self.encoder, self.text = encoder, ""
        self.starts: list[int] = []
        self.tokens: list[tuple[int, ...]] = []
        self.replace(0, 0, text)

    def append(self, text: str) -> int:
        return self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, stop: int, text: str) -> int:
        """Put text in place of the letters from start to stop; returns the number of pieces split anew."""
        moved, self.text = len(text) - (stop - start), self.text[:start] + text + self.text[stop:]
        first = max(0, bisect_left(self.starts, start) - 2)  # a piece may look one letter ahead
        at = self.starts[first] if self.starts else 0
        old, starts, tokens = {s + moved: i for i, s in enumerate(self.starts) if s >= stop}, [], []
        rest = len(self.starts)
        for m in self.encoder.pattern.finditer(self.text, at):
            if m.start() >= start + len(text) and m.start() in old:
                rest = old[m.start()]
                break
            starts.append(m.start())
            tokens.append(self.encoder.piece(m.group()))
        self.starts = self.starts[:first] + starts + [s + moved for s in self.starts[rest:]]
        self.tokens = self.tokens[:first] + tokens + self.tokens[rest:]
        return len(starts)

    def ids(self) -> list[int]:
        return [i for t in self.tokens for i in t]


class _Known(dict):
    """Number of each distinct piece; a new one is encoded when first asked for."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        e = self.encoder
        tokens = e.vocabulary.encode(piece.encode())
        e.flat.extend(tokens)
        e.ends.append(len(e.flat))
        return number


class Encoder:
    """Encodes texts; remembers the tokens of pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN) -> None:
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat, self.ends = _Known(self), [], [0]
        self._arrays: tuple[int, np.ndarray, np.ndarray] = (-1, np.empty(0, np.int32), np.zeros(1, np.int64))

    def piece(self, piece: str) -> tuple[int, ...]:
        n = self.known[piece]
        return tuple(self.flat[self.ends[n] : self.ends[n + 1]])

    def pieces(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(piece numbers of all texts, how many pieces each text has, tokens of all pieces known, where each piece's end)."""
        if len(self.known) > MOST_PIECES:
            self._forget()
        find, number = self.pattern.findall, self.known.__getitem__
        parts = [np.fromiter(map(number, find(t)), np.int32) if t else np.empty(0, np.int32) for t in texts]
        if self._arrays[0] != len(self.ends):
            self._arrays = len(self.ends), np.array(self.flat, np.int32), np.array(self.ends, np.int64)
        return np.concatenate(parts) if parts else np.empty(0, np.int32), np.array([len(p) for p in parts], np.int64), self._arrays[1], self._arrays[2]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts, number of tokens of each)."""
        which, sizes, flat, ends = self.pieces(texts)
        n = ends[which + 1] - ends[which]
        upto = np.cumsum(n)
        at = np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(ends[which] - (upto - n), n)
        return flat[at], np.diff(np.append(0, np.append(0, upto)[np.cumsum(sizes)]))

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text."""
        which, sizes, _, ends = self.pieces(texts)
        upto = np.append(0, np.cumsum(ends[which + 1] - ends[which]))
        return np.diff(np.append(0, upto[np.cumsum(sizes)]))


@cache
def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(Vocabulary.read(path), pattern)


def encode(df: DataFrame, id_col: str, text_col: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, ids): the tokens of every text, as a list of integers; null and empty texts give an empty list.

    No special tokens are made, also where a text spells one. Every row of df comes out, with its id as it is; other
    columns are ignored. No shuffle: each task encodes its own rows.
    """
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            flat, sizes = e.encode(b.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["id", "ids"])

    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, ids array<int>")


def count(df: DataFrame, id_col: str, text_col: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, tokens): the number of tokens of every text; 0 for null and empty texts."""
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(e.counts(b.column(1).to_pylist()), pa.int64())], ["id", "tokens"])

    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, tokens long")
