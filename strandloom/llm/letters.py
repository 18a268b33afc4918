"""Letters of records as flat NumPy arrays: normalising, packing, rolling codes, sampled seeds.

A batch of records is one flat uint8 array. Letters are 0..3 (A, C, G, T) and 4 (N); every record is
followed by one 4, so that no window without an N can cross from one record into the next.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

ALPHABET = "ACGTN"
OTHER = 255
_LUT = np.full(256, OTHER, np.uint8)
for _code, _letter in enumerate(ALPHABET):
    _LUT[ord(_letter)] = _LUT[ord(_letter.lower())] = _code
_LUT[ord("U")] = _LUT[ord("u")] = ALPHABET.index("T")
_NAMES = np.frombuffer(ALPHABET.encode(), np.uint8)

#: Three letters in a byte, base 5, or four, base 4.
_QUADS = np.stack([np.arange(256) >> s & 3 for s in (6, 4, 2, 0)], axis=1).astype(np.uint8)
_TRIPLES = np.stack([np.arange(256) // 25 % 5, np.arange(256) // 5 % 5, np.arange(256) % 5], axis=1).astype(np.uint8)


@dataclass
class Batch:
    """codes: all letters, each record ended by a 4; starts, lengths: where each record's letters lie."""

    codes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        """For each place of codes, the number of its record."""
        return np.repeat(np.arange(len(self), dtype=np.int32), self.lengths + 1)

    def broken(self) -> np.ndarray:
        """Which records hold an N."""
        marks = np.append(0, np.cumsum(self.codes > 3))
        return marks[self.starts + self.lengths] > marks[self.starts]

    def text(self, row: int) -> str:
        s = self.starts[row]
        return _NAMES[self.codes[s : s + self.lengths[row]]].tobytes().decode()


def _laid(letters: np.ndarray, lengths: np.ndarray) -> Batch:
    n = len(lengths)
    starts = np.zeros(n, np.int64)
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    codes = np.full(int(lengths.sum()) + n, 4, np.uint8)
    first = np.cumsum(lengths) - lengths
    codes[np.arange(len(letters)) + np.repeat(starts - first, lengths)] = letters
    return Batch(codes, starts, lengths.astype(np.int64))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and lengths of a string or binary array; nulls have length 0."""
    wide = pa.large_binary()
    column = column.cast(wide) if column.type == pa.binary() else column.cast(pa.large_string()).cast(wide)
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)


def normalise(column: pa.Array) -> Batch:
    """Letters of each text: upper case, U as T, everything but A, C, G, T, N dropped; null has none."""
    data, lengths = _flat(column)
    if len(data) and data.max() >= 128:  # a few marks have A, C, G, T, U or N in upper case
        marked = np.add.reduceat(np.append(data >= 128, False), np.cumsum(lengths) - lengths) > 0 if len(lengths) else []
        if np.any(marked := marked & (lengths > 0)):
            texts = column.to_pylist()
            for i in np.flatnonzero(marked):
                texts[i] = texts[i].upper()
            data, lengths = _flat(pa.array(texts, pa.large_string()))
    codes = _LUT[data]
    kept = codes != OTHER
    before = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(kept, out=before[1:])
    ends = np.cumsum(lengths)
    return _laid(codes[kept], before[ends] - before[ends - lengths])


def pack(batch: Batch) -> pa.Array:
    """Each record as bytes; equal letters, equal bytes. The first byte is the number of letters in the last group, plus 8 if
    groups are of three letters in base 5 (records with N) and not of four in base 4 (all others)."""
    per_row = np.where(batch.broken(), 3, 4)
    groups = (batch.lengths + per_row - 1) // per_row
    offsets = np.zeros(len(batch) + 1, np.int32)
    np.cumsum(groups + 1, out=offsets[1:])
    out = np.empty(int(offsets[-1]), np.uint8)
    out[offsets[:-1]] = batch.lengths - (groups - 1) * per_row * (groups > 0) + 8 * (per_row == 3)
    heads = np.zeros(len(out), bool)
    heads[offsets[:-1]] = True
    letter = np.ones(len(batch.codes), bool)
    letter[batch.starts + batch.lengths] = False
    for size, base in ((4, 4), (3, 5)):
        mine = (per_row == size) & (groups > 0)
        if not mine.any():
            continue
        flat, real = _padded(groups[mine], batch.lengths[mine], size)
        flat[real] = batch.codes[letter & np.repeat(mine, batch.lengths + 1)]
        body = flat.reshape(-1, size) @ (base ** np.arange(size - 1, -1, -1)).astype(np.uint8)
        out[~heads & np.repeat(mine, groups + 1)] = body
    return pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpack(column: pa.Array) -> Batch:
    """The inverse of pack()."""
    data, sizes = _flat(column)
    first = np.cumsum(sizes) - sizes
    groups = np.maximum(sizes - 1, 0)
    head = np.zeros(len(sizes), np.int64)
    head[sizes > 0] = data[first[sizes > 0]]
    per_row = np.where(head >= 8, 3, 4)
    lengths = np.where(groups > 0, (groups - 1) * per_row + (head & 7), 0)
    out = _empty(lengths)
    heads = np.zeros(len(data), bool)
    heads[first[sizes > 0]] = True
    letter = np.ones(len(out.codes), bool)
    letter[out.starts + out.lengths] = False
    several = bool((per_row[groups > 0] == 3).any()) and bool((per_row[groups > 0] == 4).any())
    for size, table in ((4, _QUADS), (3, _TRIPLES)):
        mine = (per_row == size) & (groups > 0)
        if not mine.any():
            continue
        body = data[~heads & np.repeat(mine, sizes)] if several else data[~heads]
        _, real = _padded(groups[mine], lengths[mine], size)
        out.codes[letter & np.repeat(mine, out.lengths + 1) if several else letter] = table[body].reshape(-1)[real]
    return out


def _padded(groups: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Room for records in whole groups of letters, and which places hold letters: the last group may be filled up."""
    flat = np.zeros(size * int(groups.sum()), np.uint8)
    real = np.ones(len(flat), bool)
    ends, pad = size * np.cumsum(groups), groups * size - lengths
    for j in range(size - 1):
        real[ends[pad > j] - 1 - j] = False
    return flat, real


def _empty(lengths: np.ndarray) -> Batch:
    starts = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    return Batch(np.full(int(lengths.sum()) + len(lengths), 4, np.uint8), starts, lengths.astype(np.int64))


def rolling(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every place: the k letters from there, two bits each (k up to 32), and whether they hold no N."""
    n = max(0, len(codes) - k + 1)
    if not n:
        return np.empty(0, np.uint16 if k <= 8 else np.uint32 if k <= 16 else np.uint64), np.empty(0, bool)
    dtype = np.uint16 if k <= 8 else np.uint32 if k <= 16 else np.uint64
    power = (codes & 3).astype(dtype)
    bad = codes > 3
    value, good_until, done, width, rest = None, None, 0, 1, k
    while rest:
        if rest & 1:
            if value is None:
                value, good_until = power[done:], bad[done:]
            else:
                m = len(power) - done
                value = (value[:m] << dtype(2 * width)) | power[done:]
                good_until = good_until[:m] | bad[done:]
            done += width
        rest >>= 1
        if rest:
            power = (power[:-width] << dtype(2 * width)) | power[width:] if len(power) > width else power[:0]
            bad = bad[:-width] | bad[width:] if len(bad) > width else bad[:0]
            width *= 2
    return value[:n], ~good_until[:n]


def spell(codes: np.ndarray, k: int) -> list[str]:
    """The letters of two-bit codes of length k."""
    shifts = np.arange(2 * (k - 1), -1, -2, dtype=np.uint64)
    letters = _NAMES[(codes.astype(np.uint64)[:, None] >> shifts[None, :]) & np.uint64(3)]
    return [x.tobytes().decode() for x in letters]


def mixed(values: np.ndarray) -> np.ndarray:
    """Well spread 64-bit hash, one to one."""
    x = values.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def order_of(values: np.ndarray) -> np.ndarray:
    """Stable order of whole numbers from 0 on; numbers and places are sorted together where both fit 64 bits."""
    n, most = len(values), int(values.max()) if len(values) else 0
    shift = max(1, n.bit_length())
    if most.bit_length() + shift > 63:
        return np.argsort(values, kind="stable")
    keys = (values.astype(np.int64) << shift) | np.arange(n)
    keys.sort()
    return keys & ((1 << shift) - 1)


def distinct_terms(batch: Batch, k: int) -> np.ndarray:
    """Sorted distinct (record << 2k | term) of a batch; k up to 16."""
    value, good = rolling(batch.codes, k)
    place = np.flatnonzero(good)
    rows = batch.rows()[place]
    small = len(batch) << (2 * k) <= 1 << 32
    dtype = np.uint32 if small else np.uint64
    keys = np.sort((rows.astype(dtype) << dtype(2 * k)) | value[place].astype(dtype))
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def distinct_in_windows(codes: np.ndarray, term: int, width: int) -> np.ndarray:
    """Of every place: how many different terms lie in the width letters from there (N counts as A)."""
    value, _ = rolling(codes, term)
    inside = width - term + 1
    n = len(value) - inside + 1
    if n <= 0:
        return np.empty(0, np.uint8)
    back = np.full(len(value), inside, np.uint8)  # steps back to the nearest equal term
    for j in reversed(range(1, inside)):
        back[j:][value[j:] == value[:-j]] = j
    count = np.zeros(n, np.uint8)
    for j in range(inside):
        count += back[j : j + n] > j
    return count


def sampled(codes: np.ndarray, k: int, w: int, term: int = 8, distinct: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: places and codes of the k-letter seeds that have the least hash among w neighbours (w up to 8).

    The third array tells, by bit o, that the stretch of k + w - 1 letters that begins o letters before the seed chose it.
    Any stretch of k + w - 1 letters without N that stands in two records gives both the same seed at the
    same place of the stretch (of equal hashes the leftmost). Stretches with fewer than distinct different
    terms (runs of one letter, short repeats) give none.
    """
    value, _ = rolling(codes, k)
    if len(value) < w:
        return np.empty(0, np.int64), value[:0], np.empty(0, np.uint8)
    n = len(value) - w + 1
    order = (mixed(value) >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFF8)
    least = order[:n].copy()  # the hash of the least seed, its place in the window in the lowest three bits
    for j in range(1, w):
        np.minimum(least, order[j : j + n] | np.uint32(j), out=least)
    at = (least & np.uint32(7)).astype(np.uint8)
    marks = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(codes > 3, out=marks[1:])
    full = marks[k + w - 1 :][:n] == marks[:n]
    if distinct:
        full &= distinct_in_windows(codes, term, k + w - 1)[:n] >= distinct
    chosen = np.zeros(len(value), np.uint8)
    for j in range(w):
        chosen[j : j + n] |= (full & (at == j)).view(np.uint8) << np.uint8(j)
    places = np.flatnonzero(chosen)
    return places, value[places], chosen[places]


def flanks(codes: np.ndarray, places: np.ndarray, k: int, f: int) -> tuple[np.ndarray, np.ndarray]:
    """The f letters left and right of seeds (f up to 8), two bits each, nearest letter lowest."""
    n = len(codes)
    left, right = np.zeros(len(places), np.uint16), np.zeros(len(places), np.uint16)
    for j in range(f):
        near = places - 1 - j
        left |= (np.where(near >= 0, codes[np.maximum(near, 0)], 0) & 3).astype(np.uint16) << np.uint16(2 * j)
        far = places + k + j
        right |= (np.where(far < n, codes[np.minimum(far, n - 1)], 0) & 3).astype(np.uint16) << np.uint16(2 * j)
    return left, right


def readings(batch: Batch, width: int, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(letters, record of each): the surroundings of unread letters, once for each way to read them, each ended by a 4.

    Every window of width letters with one to ``most`` N stands there in all its readings; windows with more N in none.
    """
    parts, rows = [np.empty(0, np.uint8)], [np.empty(0, np.int32)]
    for r in np.flatnonzero(batch.broken()).tolist():
        s, n = int(batch.starts[r]), int(batch.lengths[r])
        codes = batch.codes[s : s + n]
        at = np.flatnonzero(codes > 3).tolist()
        edge = [-1, *at, n]
        for i in range(len(at)):
            for q in range(1, most + 1):
                if i + q > len(at) or at[i + q - 1] - at[i] >= width:
                    break
                lo, hi = max(edge[i] + 1, at[i + q - 1] - width + 1), min(edge[i + q + 1], at[i] + width)
                if hi - lo < width:
                    continue
                ways = 4**q
                piece = np.repeat(np.append(codes[lo:hi], 4)[None, :], ways, axis=0)
                for j in range(q):
                    piece[:, at[i + j] - lo] = np.arange(ways) >> (2 * j) & 3
                parts.append(piece.reshape(-1).astype(np.uint8))
                rows.append(np.full(piece.size, r, np.int32))
    return np.concatenate(parts), np.concatenate(rows)
