"""Columns of unsigned numbers as one compressed block of bytes, for shuffles of many small records."""

from __future__ import annotations

import numpy as np

try:
    import zstandard

    def squeeze(data: bytes) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(data)

    def expand(data: bytes) -> bytes:
        return zstandard.ZstdDecompressor().decompress(data)
except ImportError:  # a cluster without it
    import zlib

    def squeeze(data: bytes) -> bytes:
        return zlib.compress(data, 1)

    def expand(data: bytes) -> bytes:
        return zlib.decompress(data)


def planes(values: np.ndarray) -> tuple[int, bytes]:
    """Numbers below 2 ** 64, byte by byte: all lowest bytes first; bytes that are zero throughout are left out."""
    wide = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    used = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return used, np.ascontiguousarray(wide[:, :used].T).tobytes()


def write(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length, each counted from its least value; columns that are in order are stored as steps."""
    n, head, body = len(columns[0]), [len(columns[0])], []
    for c in columns:
        c = c.astype("<i8")
        least = int(c.min()) if n else 0
        steps = n > 1 and bool((c[1:100] >= c[:99][: len(c[1:100])]).all()) and bool((c[1:] >= c[:-1]).all())
        used, data = planes(np.diff(c, prepend=least) if steps else c - least)
        head += [least, used, int(steps)]
        body.append(data)
    return squeeze(np.array(head, "<i8").tobytes() + b"".join(body))


def read(block: bytes, columns: int) -> list[np.ndarray]:
    """The inverse of write(); all columns come as int64."""
    data = expand(block)
    n, *head = np.frombuffer(data, "<i8", 1 + 3 * columns).tolist()
    at, out = 8 * (1 + 3 * columns), []
    for c in range(columns):
        least, used, steps = head[3 * c : 3 * c + 3]
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :used] = np.frombuffer(data, np.uint8, used * n, at).reshape(used, n).T
        at += used * n
        values = wide.view("<i8").reshape(-1)
        out.append((np.cumsum(values) if steps else values) + least)
    return out


def read_all(blocks: list[bytes], columns: int) -> list[np.ndarray]:
    parts = [read(b, columns) for b in blocks]
    return [np.concatenate([p[c] for p in parts]) for c in range(columns)]


def length(block: bytes) -> int:
    """The number of records in a block."""
    return int.from_bytes(expand(block)[:8], "little")
