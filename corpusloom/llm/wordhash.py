"""Vectorised hashing of the words and word shingles of whole texts (numpy only)."""

from __future__ import annotations

import re

import numpy as np

_BASE, _MIX1, _MIX2, _FOLD = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


#: Bytes that are hashed at a time, up to the end of a word.
PART = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start byte and 64-bit hash of each word of ``data``, A-Z taken as a-z.

    Words are runs of bytes other than space and 09 to 0D. Long data are hashed in
    parts that end between words, so the memory is that of a part.
    """
    at, starts, hashes = 0, [], []
    while at < len(data) or not starts:
        gap = _GAP.search(data, at + PART) if at + PART < len(data) else None
        end = gap.start() if gap else len(data)
        start, words = _part_hashes(data[at:end])
        starts.append(start + at)
        hashes.append(words)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def _part_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(data, np.uint8)
    upper = (buf >= 65) & (buf <= 90)
    buf = np.where(upper, buf + 32, buf).astype(np.uint8)
    word = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=total[1:])
    return start, mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingle_sets(texts: list[bytes], width: int = 5):
    """Yield for each text the sorted distinct hashes of its ``width``-word shingles.

    A text of fewer words gives the whole sequence as one shingle; a text
    without words gives an empty array.
    """
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    start, words = word_hashes(b" ".join(texts))
    first = np.searchsorted(start, offsets)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        rolled = mix(rolled * _FOLD + words[j : j + len(rolled)])
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                h = mix(h * _FOLD + w)
            yield h
        else:
            yield np.zeros(0, np.uint64)


def sliced(texts: list[bytes], limit: int = 1 << 20):
    """Cut a list of texts into runs of about ``limit`` bytes, one text at least."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run
