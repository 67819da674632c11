"""Words, word hashes and window hashes of Arrow text columns, in numpy, a block of documents at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Spans hashed at a time, and bytes from which a span is hashed by itself.
_SPANS, LONG = 1 << 17, 256
#: Bytes of text a block gathers; a single longer document is a block of its own.
BLOCK_BYTES = 4 << 20
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Block:
    """Documents ``row`` to ``row + len(offsets) - 1`` of a batch; positions are bytes of ``data``."""

    row: int
    data: np.ndarray
    offsets: np.ndarray  # of the documents, with the end of the last
    starts: np.ndarray  # of the words
    ends: np.ndarray
    first: np.ndarray  # first word of each document, with the end of the last

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def word_docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.n_words)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a text column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8), offsets


def cut_rows(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, at least one row each."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    data, offsets = utf8(column)
    for a, b in cut_rows(offsets, limit):
        part = data[offsets[a] : offsets[b]]
        at = offsets[a : b + 1] - offsets[a]
        filled = ~_BLANK[part]
        is_start, is_end = filled.copy(), filled.copy()
        is_start[1:] &= ~filled[:-1]
        is_end[:-1] &= ~filled[1:]
        inner = at[(at > 0) & (at < len(part))]  # words never cross documents
        is_start[inner] = filled[inner]
        is_end[inner - 1] = filled[inner - 1]
        starts = np.flatnonzero(is_start)
        yield Block(a, part, at, starts, np.flatnonzero(is_end) + 1, np.searchsorted(starts, at))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit (the published 64-bit finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def multiplier(seed: int) -> int:
    return int(mix(np.array([seed + 77], np.uint64))[0]) | 1


def lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Up to eight bytes of each span as a number; ``data`` has seven bytes more than the spans reach."""
    left = np.minimum(ends - starts, 8)
    found = np.ascontiguousarray(data[starts[:, None] + np.arange(8)]).view("<u8").ravel()
    return found & (~np.uint64(0) >> (np.uint64(64) - (left * 8).astype(np.uint64)))


def padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate((data, np.zeros(8, np.uint8)))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every span; equal bytes hash alike everywhere. No span is empty.

    Eight bytes at a time are mixed in, each step a bijection, so that spans of up to eight bytes and equal size never
    collide and longer ones only by chance; spans over ``LONG`` bytes go through XXH3.
    """
    out = np.empty(len(starts), np.uint64)
    data = padded(data)
    for a in range(0, len(starts), _SPANS):  # in parts, so that a long document takes no more memory
        at, to = starts[a : a + _SPANS], ends[a : a + _SPANS]
        h = mix((to - at).astype(np.uint64) + np.uint64(multiplier(seed)))
        rest = np.flatnonzero(to - at <= LONG)
        for i in np.flatnonzero(to - at > LONG).tolist():
            h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(data[at[i] : to[i]].tobytes(), seed))
        step = 0
        while len(rest):
            h[rest] = mix(h[rest] ^ lanes(data, at[rest] + step, to[rest]))
            step += 8
            rest = rest[to[rest] - at[rest] > step]
        out[a : a + _SPANS] = h
    return out


def word_hashes(block: Block, seed: int = 0) -> np.ndarray:
    return span_hashes(block.data, block.starts, block.ends, seed)


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Rolling hashes of every ``size`` consecutive words, across documents too; one per start."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base, out, done = multiplier(seed), None, 0
    level, length = words, 1  # hashes of windows of 1, 2, 4, ... words
    left = size
    while left:
        if left & length:
            scale = np.uint64(pow(base, done, 1 << 64))
            part = level[done : done + n] * scale
            out = part if out is None else out + part
            done += length
            left ^= length
        if left:
            level = level[:-length] + level[length:] * np.uint64(pow(base, length, 1 << 64))
            length *= 2
    return mix(out)


def inside(block: Block, size: int) -> np.ndarray:
    """For every start of ``window_hashes``: whether the window lies in one document."""
    n = max(0, len(block.starts) - size + 1)
    left = np.repeat(block.first[1:], block.n_words)[:n] - np.arange(n)
    return left >= size
