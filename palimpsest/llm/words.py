"""Words of a column of texts and hashes of word windows, as numpy arrays straight from Arrow buffers.

A word is a maximal run of word bytes in the UTF-8 text. Every separator is an ASCII byte, so working on
bytes gives the same words as working on code points. Null and empty texts have no words.

A word's 64-bit key is made eight bytes at a time, each step multiplying and shifting, so that no pair of words has
equal keys for a structural reason; a long word's is a BLAKE2b digest. A window's hash is a polynomial in its words'
keys; the windows used have far fewer words than such a polynomial needs to be zero by structure.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 18

#: Bytes of words for the pattern [^\x20\x09-\x0D]+ .
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bytes of words for the pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in text whose A-Z are lower-cased.
LETTERS_DIGITS = np.zeros(256, bool)
LETTERS_DIGITS[0x30:0x3A] = LETTERS_DIGITS[0x41:0x5B] = LETTERS_DIGITS[0x61:0x7B] = LETTERS_DIGITS[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

WORD_BASE, WORD_BASE_2 = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5

#: What the keys of a word begin with; the second key is for windows that are told apart by two hashes.
SEED, SEED_2 = 0x9FB21C651E98DF25, 0x2545F4914F6CDD1D

#: Bytes of words whose keys are digests.
LONG_WORD = 256

_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n-1) modulo 2 ** 64; longer tables than PIECE aren't kept."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, PIECE), base, U64)
        got[0] = 1
        np.cumprod(got, out=got)
        if n <= PIECE:
            _powers[base] = got
    return got[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_keys(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """64-bit keys of the words data[start:start+size]; 8 bytes follow the last one in data."""
    view = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    key = mix(view[start] & _MASKS[np.minimum(size, 8)] ^ mix(size.astype(U64) + U64(seed)))
    rest, at = np.flatnonzero(size > 8), 8
    while len(rest) and at < LONG_WORD:
        key[rest] = mix(key[rest] * U64(WORD_BASE) ^ (view[start[rest] + at] & _MASKS[np.minimum(size[rest] - at, 8)]))
        at += 8
        rest = rest[size[rest] > at]
    for i in rest.tolist():
        word = data[start[i] : start[i] + size[i]].tobytes()
        key[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=seed.to_bytes(8, "big")).digest(), "big")
    return key


@dataclass
class Words:
    """start, end: byte positions; doc: row number; key: 64-bit hash; first: number of each row's first word (n+1);
    key_2: another hash, if it was asked for."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    key: np.ndarray
    first: np.ndarray
    key_2: np.ndarray

    def windows(self, length: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers at which a window of so many words of one row starts, and the windows' hashes."""
        key, base = (self.key_2, WORD_BASE_2) if second else (self.key, WORD_BASE)
        n = len(key)
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(np.arange(n) + length <= self.first[self.doc + 1])
        total = np.zeros(n + 1, U64)
        np.cumsum(key * powers(base, n), out=total[1:])
        return at, mix((total[at + length] - total[at]) * powers(inverse(base), n)[at])


def _cut(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, stop: int) -> int:
    """The first position from stop on that isn't inside a word."""
    row = offsets[np.searchsorted(offsets, stop)]
    while stop < row:
        gap = np.flatnonzero(~table[data[stop : min(row, stop + 65536)]])
        if len(gap):
            return stop + int(gap[0])
        stop = min(row, stop + 65536)
    return int(row)


def scan(column: pa.Array | pa.ChunkedArray, table: np.ndarray = NOT_SPACE, lower: bool = False, second: bool = False) -> Words:
    """All words of all rows, in pieces of about PIECE bytes, so that memory doesn't follow a text's length twice over."""
    data, offsets = buffers(column)
    starts, ends, keys, keys_2 = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0, U64)]
    at, n = 0, len(data)
    while at < n:
        stop = _cut(data, offsets, table, min(n, at + PIECE))
        padded = np.zeros(stop - at + 8, np.uint8)
        piece = padded[: stop - at]
        piece[:] = data[at:stop]
        inside = table[piece]
        before, after = np.zeros(len(piece), bool), np.zeros(len(piece), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        rows = offsets[(offsets > at) & (offsets < stop)] - at
        before[rows], after[rows - 1] = False, False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        if lower:
            piece[:] = LOWER[piece]
        keys.append(word_keys(padded, start, end - start))
        if second:
            keys_2.append(word_keys(padded, start, end - start, SEED_2))
        starts.append(start + at)
        ends.append(end + at)
        at = stop
    start = np.concatenate(starts)
    doc = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(doc, np.arange(len(offsets)))
    return Words(start, np.concatenate(ends), doc, np.concatenate(keys), first, np.concatenate(keys_2))
