"""Cutting long texts into overlapping pieces at natural boundaries.

Every place between two tokens has a strength: 3 after a line, 2 after a sentence, 1 after a word, 0 elsewhere. A sparse
table keeps the strongest place of every stretch of 1, 2, 4, ... places; two overlapping stretches cover any window,
so the strongest cut in the permissible window of a piece is found at once, of equals the rightmost. The next piece
begins ``overlap`` tokens before the cut. All texts of a batch lie in one array and advance together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import tokens as T

LINE, SENTENCE, WORD = 3, 2, 1
_ENDS = frozenset(".!?…。！？")
_CLOSING = frozenset("\"'”’»)]")


class Boundaries:
    """What a token tells about the places at its ends, by token id."""

    def __init__(self, vocabulary: T.Vocabulary) -> None:
        n = max(vocabulary.tokens) + 1
        self.sizes = np.zeros(n, np.int32)
        self.continues, self.opens_blank, self.ends_line, self.ends_blank = (np.zeros(n, bool) for _ in range(4))
        self.ends_sentence, self.closes = np.zeros(n, bool), np.zeros(n, bool)
        for i, token in vocabulary.tokens.items():
            self.sizes[i] = len(token)
            self.continues[i] = 0x80 <= token[0] < 0xC0  # begins inside a letter
            text = token.decode("utf-8", "ignore")
            bare = text.rstrip("".join(_CLOSING))
            self.opens_blank[i] = text[:1].isspace()
            self.ends_line[i] = text[-1:] in ("\n", "\r", " ", " ")
            self.ends_blank[i] = text[-1:].isspace()
            self.ends_sentence[i] = bare[-1:] in _ENDS if bare else False
            self.closes[i] = bool(text) and not bare

    def strengths(self, ids: np.ndarray) -> np.ndarray:
        """For the place after each token: its strength, -1 inside a letter. The end of a text is for the caller to set."""
        after = np.append(ids[1:], ids[-1:])
        sentence = self.ends_sentence[ids]
        sentence |= self.closes[ids] & np.append(False, sentence[:-1])
        word = self.opens_blank[after] | self.ends_blank[ids]
        out = np.where(word, np.where(sentence, SENTENCE, WORD), 0).astype(np.int8)
        out[self.ends_line[ids]] = LINE
        out[self.continues[after]] = -1
        return out


class StrongestCut:
    """Sparse table for range maxima of values from -2 on; of equal values the rightmost wins."""

    def __init__(self, values: np.ndarray, widest: int) -> None:
        at = np.arange(len(values), dtype=np.int64)
        self.levels = [(values.astype(np.int64) + 2) << 40 | at]
        width = 1
        while 2 * width <= min(widest, len(values)):
            low = self.levels[-1]
            self.levels.append(np.maximum(low[:-width], low[width:]))
            width *= 2

    def query(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Where the strongest value lies in each window, both ends inclusive."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), np.int64)
        for x in np.unique(level):
            mine = level == x
            table = self.levels[x]
            out[mine] = np.maximum(table[first[mine]], table[last[mine] - (1 << int(x)) + 1])
        return out & ((1 << 40) - 1)


def cuts(ids: np.ndarray, sizes: np.ndarray, strengths: np.ndarray, most: int, overlap: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the pieces, in tokens of the whole array, of all texts longer than most.

    A piece has at most ``most`` tokens and, but for the last, at least ``least``. No piece ends inside a letter unless the
    window has no other place. Cuts whose overlap begins inside a letter come last among the others; if one must be
    taken, the overlap begins with the whole letter, up to 3 tokens earlier.
    """
    upto = np.cumsum(sizes)
    text = np.flatnonzero(sizes > most)
    start, stop = (upto - sizes)[text], upto[text]
    able = strengths.copy()
    if overlap:  # the next piece begins overlap tokens back; that must not be inside a letter either
        inside = np.flatnonzero(strengths < 0) + overlap
        able[inside[inside < len(able)]] = -1
    able[strengths < 0] = -2
    table = StrongestCut(able, most)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(text):
        whole = stop - start <= most
        end = stop.copy()
        if not whole.all():
            cut = table.query(start[~whole] + least - 1, start[~whole] + most - 1)  # the place after token t has number t
            end[~whole] = cut + 1
        out.append((text, start, end))
        begin = start[~whole]
        text, start, stop = text[~whole], end[~whole] - overlap, stop[~whole]
        for _ in range(3 if overlap else 0):
            start = start - ((strengths[start - 1] < 0) & (start > begin + 1))
    if not out:
        return text, start, stop
    text, start, end = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((start, text))
    return text[order], start[order], end[order]


def split(df: DataFrame, id_col: str, text_col: str, limits: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", fill: float = 0.5) -> DataFrame:
    """(limit_id, id, piece, start, tokens, strength, text): the pieces of every text longer than a limit.

    limits (limit_id, max_tokens, overlap_tokens), few rows; a null overlap is 0 and must be less than half the limit. piece counts from 0, start in
    tokens. A piece is cut after the strongest boundary that leaves it at least ``fill`` of the limit; strength tells which
    (3 line, 2 sentence, 1 word, 0 none, null: the end of the text). Texts within the limit, null and empty ones give no rows.
    """
    wanted = [(r[0], r[1], r[2] or 0) for r in limits.select("limit_id", "max_tokens", "overlap_tokens").filter("max_tokens > 0").orderBy("limit_id").collect()]
    for _, most, overlap in wanted:
        if not 0 <= 2 * overlap < most:
            raise ValueError("an overlap must be less than half its limit")
    path = T.vocabulary_path(vocabulary)
    schema = "limit_id int, id long, piece int, start int, tokens int, strength int, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, known = T.encoder(path), None
        for texts, ids_ in _portions(batches):
            known = known or Boundaries(e.vocabulary)
            flat, sizes = e.encode(texts)
            if not len(flat):
                continue
            strengths = known.strengths(flat)
            strengths[(np.cumsum(sizes) - 1)[sizes > 0]] = LINE
            data = np.frombuffer("".join(t for t in texts if t).encode(), np.uint8)
            at = np.append(0, np.cumsum(known.sizes[flat], dtype=np.int64))
            for limit, most, overlap in wanted:
                text, start, end = cuts(flat, sizes, strengths, most, overlap, max(overlap + 1, int(fill * most), 1))
                if not len(text):
                    continue
                n = at[end] - at[start]
                offsets = np.append(0, np.cumsum(n))
                letters = data[np.arange(int(offsets[-1])) + np.repeat(at[start] - offsets[:-1], n)]
                final = end == np.cumsum(sizes)[text]
                first = np.append(True, text[1:] != text[:-1])
                begins = np.flatnonzero(first)
                nth = np.arange(len(text)) - np.repeat(begins, np.diff(np.append(begins, len(text))))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(text), limit), pa.int32()), pa.array(ids_[text]), pa.array(nth, pa.int32()),
                    pa.array(start - (np.cumsum(sizes) - sizes)[text], pa.int32()), pa.array(end - start, pa.int32()),
                    pa.array(np.maximum(strengths[end - 1], 0), pa.int32(), mask=final), _strings(letters, offsets),
                ], ["limit_id", "id", "piece", "start", "tokens", "strength", "text"])

    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    if not wanted:
        return df.sparkSession.createDataFrame([], schema)
    return picked.mapInArrow(run, schema)


def _portions(batches: Iterator[pa.RecordBatch], letters: int = 1_000_000) -> Iterator[tuple[list[str], np.ndarray]]:
    """Texts and ids, about so many letters at a time, which bounds the size of the tables; a text is never divided."""
    for b in batches:
        upto = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False))
        edges = np.append(0, np.flatnonzero(np.diff(upto // letters)) + 1).tolist() + [b.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                yield b.column(1).slice(lo, hi - lo).to_pylist(), b.column(0).slice(lo, hi - lo).to_numpy()


def _strings(letters: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Bytes as strings; a piece that had to be cut inside a letter gets a replacement mark there."""
    array = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(letters))])
    try:
        return array.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in array.to_pylist()], pa.string())
