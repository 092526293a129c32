"""Words of many texts at once: bytes of an Arrow column to word hashes and line numbers, without a step per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_CHUNK = 1 << 20  # bytes looked at together, or one longer text
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True
#: Of a number's bytes, the first 0 to 8.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_WIDE = 16  # bytes of a word that are its hash's input as they are; longer words go through XXH3


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(30))


def word_hashes(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word data[at:end], together 128 bits of its whole bytes."""
    sizes = end - at
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(_WIDE, np.uint8)]), 8)
    one, two, more = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64), np.flatnonzero(sizes > 8)
    if len(at):
        one = eight[at].view("<u8").reshape(-1) & _FIRST[np.minimum(sizes, 8)]
    if len(more):
        two[more] = eight[at[more] + 8].view("<u8").reshape(-1) & _FIRST[np.minimum(sizes[more] - 8, 8)]
    for i in np.flatnonzero(sizes > _WIDE).tolist():
        one[i], two[i] = np.frombuffer(xxhash.xxh3_128_digest(data[at[i] : end[i]].tobytes()), "<u8")
    size = sizes.astype(np.uint64)
    a = mixed(one + size * np.uint64(0x9E3779B97F4A7C15))
    b = mixed(two ^ (size * np.uint64(0xD6E8FEB86659FD93)))
    return mixed(a + np.uint64(0xC2B2AE3D27D4EB4F) * b), mixed(b + np.uint64(0x165667B19E3779F9) * (a ^ (a >> np.uint64(29))))


@dataclass
class Tokens:
    """The words of rows first to last of a column: hash and line (counted over the chunk) of each."""

    first: int
    last: int
    hash: np.ndarray
    hash2: np.ndarray  # independent of the first
    line: np.ndarray
    lines: int
    lines_of: np.ndarray  # per row
    number: np.ndarray  # of a line in its row


def tokenize(data: np.ndarray, offsets: np.ndarray, first: int) -> Tokens:
    """data: the bytes of texts one after another; offsets: where each begins, and the end of the last."""
    n, starts = len(data), offsets[:-1]
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    opens = starts[offsets[1:] > starts]
    begins[opens] = solid[opens]
    at = np.flatnonzero(begins)
    # a word ends before white space or with its text
    stops = np.zeros(n + 1, bool)
    stops[1:n] = solid[:-1] & ~solid[1:]
    stops[n] = n > 0 and solid[-1]
    closes = offsets[1:][offsets[1:] > starts]
    stops[closes] = solid[closes - 1]
    end = np.flatnonzero(stops)
    h, h2 = word_hashes(data, at, end)
    breaks = np.flatnonzero(data == 10)
    row_of_break = np.searchsorted(offsets, breaks, "right") - 1
    lines_of = np.bincount(row_of_break, minlength=len(starts)) + 1
    before = np.cumsum(lines_of) - lines_of
    row = np.searchsorted(offsets[1:], at, "right")
    line = np.searchsorted(breaks, at) + row  # a row adds a line to the line breaks before it
    number = np.arange(int(lines_of.sum())) - np.repeat(before, lines_of)
    return Tokens(first, first + len(starts), h, h2, line, int(lines_of.sum()), lines_of, number)


def token_chunks(column: pa.Array) -> Iterator[Tokens]:
    """Chunks of about `_CHUNK` bytes over a string column without nulls."""
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _CHUNK, "right")) - 1)
        last = min(last, len(column))
        yield tokenize(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first)
        first = last
