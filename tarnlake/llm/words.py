"""Hashes of the words of many texts at once, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from xxhash import xxh3_64_intdigest

from tarnlake.llm.shared import LOWER, give_back, mix

CHUNK = 1 << 21
#: Words of more bytes are hashed one by one.
SHORT, SEED = 48, 0x9E3779B97F4A7C15

_byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_base = 0x5851F42D4C957F2D
_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, 0-9, a-z and all bytes beyond ASCII as they are, everything else a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_white = re.compile(rb"[ \t-\r]")
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))), dtype=np.uint64) for b in (_base, pow(_base, -1, 1 << 64))]
    return _powers[0], _powers[1]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, in order, and the number of words of each text."""
    return located(texts)[3:]


def located(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased texts joined by newlines, start and end of every word in them, the words' hashes, and the number of words of each text."""
    joined = b"\n".join(texts).translate(LOWER)
    data = np.frombuffer(joined, np.uint8)
    up, down = _power(len(data) + 1)
    inside = np.concatenate(([False], ~_space[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_byte[data] * up[: len(data)], dtype=np.uint64)))
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    # sums of powers modulo 2^64 are equal for some long words that are easily made
    for i in np.flatnonzero(end - start > SHORT).tolist():
        h[i] = xxh3_64_intdigest(joined[start[i] : end[i]], SEED)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return joined, start, end, h, np.diff(np.searchsorted(start, begins))


def runs_of(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about CHUNK bytes: the place of the first, the hashes of their words, and the words of each text; null is empty."""
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at + len(part) < len(texts) and (not part or size < CHUNK):
            part.append(texts[at + len(part)] or b"")
            size += len(part[-1])
        yield at, *words_of(part)
        at += len(part)
    give_back()


def pieces(text: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """A text in pieces of about `size` bytes that end before a white-space byte: no word is cut, however long it is."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            m = _white.search(text, end)
            end = m.start() if m else len(text)
        yield text[at:end]
        at = end
