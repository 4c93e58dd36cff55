"""Hashes of many spans of a batch of texts at once, with numpy.

Texts of an Arrow column lie in one buffer. Words are read from it eight bytes at a time, and each
step mixes the bits of the hash so far with the next ones, for all words at once, so words, shingles
and phrases are hashed without a Python step for each. No sum or product of the parts gives a hash:
two different words with one hash can't be put together from known ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text is taken whole.
CHUNK_BYTES = 1 << 20
#: Longer words are hashed each on its own, by a digest.
LONG_WORD = 64

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_SEED = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of a well-known 64-bit hash (fixed constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _digest(part: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(part.tobytes(), digest_size=8).digest(), "big")


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of 64-bit values, equal for equal contents wherever they
    stand; those of over LONG_WORD values by a digest."""
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) + _SEED)
    for i in np.flatnonzero(lengths > LONG_WORD):
        out[i] = _digest(values[starts[i] : ends[i]])
    alive = np.flatnonzero((lengths > 0) & (lengths <= LONG_WORD))
    for j in range(LONG_WORD):
        alive = alive[lengths[alive] > j] if j else alive
        if not len(alive):
            break
        if len(alive) == len(out):
            out = mix(out ^ values[starts + j]) + _SEED
        else:
            out[alive] = mix(out[alive] ^ values[starts[alive] + j]) + _SEED
    return out


class Lanes:
    """Bytes read eight at a time, from any place on."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        self.view = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))

    def at(self, places: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The next bytes at places, `left` of them (at most eight), as numbers."""
        short = np.minimum(left, 8).astype(np.uint64)
        mask = np.where(short == 8, _FULL, (np.uint64(1) << (short * np.uint64(8) & np.uint64(63))) - np.uint64(1))
        return self.view[places] & mask


def bytes_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of bytes; those of over LONG_WORD bytes by a digest."""
    lanes, lengths = Lanes(data), ends - starts
    out = mix(lengths.astype(np.uint64) + _SEED)
    long = np.flatnonzero(lengths > LONG_WORD)
    alive = np.flatnonzero((lengths > 0) & (lengths <= LONG_WORD))
    for j in range(0, LONG_WORD, 8):
        alive = alive[lengths[alive] > j] if j else alive
        if not len(alive):
            break
        out[alive] = mix(out[alive] ^ lanes.at(starts[alive] + j, lengths[alive] - j)) + _SEED
    for i in long:
        out[i] = _digest(data[starts[i] : ends[i]])
    return out


def differing(data: np.ndarray, starts: np.ndarray, other: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which spans of data aren't, byte by byte, those of the same length in `other`."""
    a, b = Lanes(data), Lanes(other)
    out = np.zeros(len(starts), bool)
    long = lengths > LONG_WORD
    for i in np.flatnonzero(long):
        out[i] = not np.array_equal(data[starts[i] : starts[i] + lengths[i]], other[begins[i] : begins[i] + lengths[i]])
    alive = np.flatnonzero((lengths > 0) & ~long)
    for j in range(0, LONG_WORD, 8):
        alive = alive[lengths[alive] > j] if j else alive
        if not len(alive):
            break
        left = lengths[alive] - j
        out[alive] |= a.at(starts[alive] + j, left) != b.at(begins[alive] + j, left)
    return out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes; at least one text each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def _word_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in range(256):
        c = b + 32 if 0x41 <= b <= 0x5A else b
        if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80:
            table[b] = c
    return table


#: Lower-case value of the bytes that belong to words, 0 for the others.
WORD_BYTE = _word_table()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for each text the number of its first word (one more at the end).

    Words are runs of ASCII letters (A-Z as a-z), digits and bytes from 0x80 on.
    """
    folded = WORD_BYTE[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = folded != 0
    step = np.diff(inside)
    begin, end = step[:-1] == 1, step[1:] == -1
    # a text's end parts words too
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[(folded[cuts - 1] != 0) & (folded[cuts] != 0)]
    begin[cuts], end[cuts - 1] = True, True
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return bytes_hashes(folded, starts, ends), np.searchsorted(starts, offsets)
