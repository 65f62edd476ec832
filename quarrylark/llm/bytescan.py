"""Numpy scanning of Arrow string columns: slices, words, word hashes.

A column's UTF-8 bytes are read in place, a megabyte at a time, so that
memory stays bounded whatever the batch holds; one text longer than the
limit makes a slice of its own. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20
_SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)])


#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z were lower-cased.
ALNUM = _table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: Bytes of `[^\x20\x09-\x0D]+`.
SPACED = _table(lambda b: not (b == 32 or 9 <= b <= 13))
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _powers(base: int) -> np.ndarray:
    out = np.full(_SEGMENT + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets of the rows in the bytes)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, at, body = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offs = np.frombuffer(at, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def runs(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in the table, none over a
    row's end, and for each row the number of runs before it (rows + 1)."""
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offs), np.int64)
    hit = table[data]
    step = np.flatnonzero(hit[1:] != hit[:-1]) + 1
    opens = hit[step]
    starts, ends = step[opens], step[~opens]
    if hit[0]:
        starts = np.concatenate(([0], starts))
    if hit[-1]:
        ends = np.concatenate((ends, [len(data)]))
    cut = np.unique(offs[1:-1])
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[hit[cut - 1] & hit[cut]]
    if len(cut):
        starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
    return starts, ends, np.searchsorted(starts, offs)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; equal bytes give equal hashes."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + _SEGMENT, "right"))
        if j <= i:  # one span longer than a segment
            out[i] = xxhash.xxh3_64_intdigest(data[base : ends[i]].tobytes())
            i += 1
            continue
        part = data[base : ends[j - 1]].astype(np.uint64)
        part += np.uint64(1)
        part *= _UP[: len(part)]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        s = starts[i:j] - base
        out[i:j] = (total[ends[i:j] - base] - total[s]) * _DOWN[s]
        i = j
    return mix64(out)


def hash_bytes(word: bytes) -> int:
    """hash_spans of one word."""
    data = np.frombuffer(word, np.uint8)
    return int(hash_spans(data, np.array([0]), np.array([len(data)]))[0]) if len(data) else 0


def split_words(text: bytes, table: np.ndarray) -> list[bytes]:
    """The words of one text that is lower-cased already."""
    data = np.frombuffer(text, np.uint8)
    s, e, _ = runs(data, np.array([0, len(data)]), table)
    return [text[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]


def counts_of(row_starts: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """How many of the sorted positions each row holds."""
    return np.diff(np.searchsorted(positions, row_starts))
