"""Vectorised text kernels on Arrow string columns (no Spark import).

Everything works on the UTF-8 bytes of many documents at once: a chunk is the
concatenation of whole texts plus an offset array, so Python never loops over
words.  Word separators are the ASCII blanks 0x20 and 0x09-0x0D; UTF-8 never uses
those bytes inside a longer character, so splitting bytes equals splitting text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _trimmer():
    import ctypes

    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


_trim = _trimmer()


def give_back() -> None:
    _trim(0)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INV)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xA0761D6478BD642F)
    x ^= x >> U64(32)
    return x


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash; prefix_hash(b)[i] covers b[:i]."""
    power, _ = _power_tables(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * power[: len(buf)], out=out[1:])
    return out


def hash_spans(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end] for each span; equal bytes get equal hashes."""
    _, inverse = _power_tables(len(prefix))
    raw = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix64(raw + (ends - starts).astype(U64) * U64(0x9FB21C651E98DF25))


def text_chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, offsets from 0) with whole texts; null counts as empty.

    A chunk holds max_bytes at most, or one longer text.  After the last one, memory that is free goes back to the
    system: workers are many and live long, and the allocator would keep the largest chunk's worth in each.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, bytes_[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    give_back()


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of every word, in text order."""
    n = len(buf)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    word = ~BLANK[buf]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:n]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(end) + 1
    return starts, ends, rows_of(starts, offsets)


def rows_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row whose text holds each (ascending) byte position."""
    counts = np.diff(np.searchsorted(positions, offsets, "left"))
    return np.repeat(np.arange(len(offsets) - 1), counts)


def line_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (newline excluded) and row of every \\n-split line; an empty text has one empty line."""
    cuts = np.flatnonzero(buf == 10)
    starts = np.concatenate([offsets[:-1], cuts + 1])
    rows = np.concatenate([np.arange(len(offsets) - 1), rows_of(cuts, offsets)])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.empty_like(starts)
    last = np.ones(len(rows), bool)
    last[:-1] = rows[1:] != rows[:-1]
    ends[:-1] = starts[1:] - 1
    ends[last] = offsets[rows[last] + 1]
    return starts, ends, rows


def window_hash(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of words[i:i+width] for each i; rows are not looked at."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k in range(width):
        out *= U64(0x2545F4914F6CDD1D)
        out += words[k : k + n]
    return mix64(out)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): row r has the sorted distinct shingles hashes[bounds[r]:bounds[r+1]].

    Words are lower-cased for A-Z; a text with 1 to width-1 words has one shingle, its whole sequence.
    """
    starts, ends, rows = word_spans(buf, offsets)
    n_rows = len(offsets) - 1
    words = hash_spans(prefix_hash(LOWER[buf]), starts, ends)
    counts = np.bincount(rows, minlength=n_rows)
    shingles = window_hash(words, width)
    ok = rows[: len(shingles)] == rows[width - 1 :] if len(shingles) else np.zeros(0, bool)
    owner, values = rows[: len(shingles)][ok], shingles[ok]
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        first = np.concatenate([[0], np.cumsum(counts)])
        short = np.zeros(len(few), U64)
        for k in range(width - 1):
            live = counts[few] > k
            short[live] = short[live] * U64(0x2545F4914F6CDD1D) + words[first[few[live]] + k]
        short = mix64(short + counts[few].astype(U64) * U64(0xC2B2AE3D27D4EB4F))
        owner, values = np.concatenate([owner, few]), np.concatenate([values, short])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    owner, values = owner[keep], values[keep]
    return np.searchsorted(owner, np.arange(n_rows + 1)), values


def segment_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags over each row's bytes."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
