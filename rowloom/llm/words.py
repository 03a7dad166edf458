"""Words of whole blocks of texts as 64-bit hashes, without a Python object per word.

A word is a run of ASCII letters, ASCII digits and bytes from 0x80 on (all parts of non-ASCII
characters), with A-Z lower-cased. A null text has no words.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x41:0x5B] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Odd multipliers of the polynomial hashes over bytes and over words.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = U64(0xD6E8FEB86659FD93)
#: Bytes hashed at once; the cut is moved on to the next byte that is in no word.
PIECE = 1 << 20

_powers: dict[int, np.ndarray] = {}


class Words(NamedTuple):
    hash: np.ndarray  # of each word
    start: np.ndarray  # its first byte in ``buffer``
    end: np.ndarray  # the byte after its last
    first: np.ndarray  # number of each text's first word, and the number of words at the end
    buffer: np.ndarray  # the bytes of all texts
    offset: np.ndarray  # first byte of each text, and the number of bytes at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """Number of the text that a word stands in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, so that all bits depend on all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_table(base: int, length: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < length:
        table = np.full(max(length, PIECE + 4096), U64(base), U64)
        table[0] = U64(1)
        _powers[base] = table = np.multiply.accumulate(table)
    return table


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: none) and where each text begins."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offset = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buffer = np.frombuffer(data, np.uint8)[offset[0] : offset[-1]] if data is not None else np.zeros(0, np.uint8)
    return buffer, offset - offset[0]


def words_of(texts: pa.Array) -> Words:
    """Split and hash the words of each text."""
    buffer, offset = text_bytes(texts)
    n = len(buffer)
    inside = WORD_BYTE[buffer]
    edge = np.zeros(n + 1, bool)
    edge[offset] = True
    hashes, starts, ends = [], [], []
    a = 0
    while a < n:
        b = min(n, a + PIECE)
        while b < n and inside[b]:
            b = min(n, b + int(np.argmin(inside[b : b + PIECE]) or PIECE))
        w = inside[a:b]
        before = np.concatenate(([False], w[:-1]))
        after = np.concatenate((w[1:], [False]))
        s = np.flatnonzero(w & (~before | edge[a:b]))
        e = np.flatnonzero(w & (~after | edge[a + 1 : b + 1])) + 1
        sums = np.zeros(b - a + 1, U64)
        np.cumsum((LOWER[buffer[a:b]].astype(U64) + U64(1)) * _power_table(BYTE_BASE, b - a)[: b - a], out=sums[1:])
        hashes.append((sums[e] - sums[s]) * _power_table(pow(BYTE_BASE, -1, 1 << 64), b - a)[s])
        starts.append(s + a)
        ends.append(e + a)
        a = b
    none = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else none
    return Words(
        mix(np.concatenate(hashes)) if hashes else np.zeros(0, U64),
        start,
        np.concatenate(ends) if ends else none,
        np.searchsorted(start, offset),
        buffer,
        offset,
    )


def _runs(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    total = np.full(len(at), U64(n), U64)
    for j in range(n):
        total = total * WORD_BASE + hashes[at + j]
    return mix(total)


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of ``n`` words inside one text."""
    m = len(words.hash) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    owner = words.owner
    at = np.flatnonzero(owner[:m] == owner[n - 1 :])
    total = np.full(m, U64(n), U64)
    for j in range(n):
        total = total * WORD_BASE + words.hash[j : j + m]
    return mix(total[at]), at


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of ``n``-word shingles of each text, sorted, how often each occurs, and where each text's begin.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    found, at = windows(words, n)
    parts = np.searchsorted(at, words.first)
    counts = words.counts
    short = {}
    for length in range(1, n):
        texts = np.flatnonzero(counts == length)
        short.update(zip(texts.tolist(), _runs(words.hash, words.first[texts], length), strict=True))
    out, times = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    begin = np.zeros(len(counts) + 1, np.int64)
    for i in range(len(counts)):
        own = found[parts[i] : parts[i + 1]]
        if i in short:
            own = np.array([short[i]], U64)
        if len(own):
            own = np.sort(own)
            new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            times.append(np.diff(np.append(new, len(own))))
            own = own[new]
            out.append(own)
        begin[i + 1] = begin[i] + len(own)
    return np.concatenate(out), np.concatenate(times), begin
