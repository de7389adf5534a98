"""Word shingles of whole texts as sorted arrays of hashes, and minima of universal hashes over them.

A word of up to 16 bytes is hashed as two numbers of 8 bytes, for all words of a
batch at once; a longer one by XXH3. Two words of up to 8 bytes and one length never
share a hash; any others do with a chance of about 2 ** -64. Sets are compared by
these hashes. Batches are cut at white space, so a text of any length takes memory
for a batch and its own hashes only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_U = np.uint64
#: Bytes hashed at a time; a longer word is hashed in one piece.
BATCH = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The lowest k bytes of a number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
#: Bytes of a word that are hashed together with other words.
SHORT = 16


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the words of data."""
    edge = np.diff(_SPACE[data].view(np.int8), prepend=1, append=1)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    wide = np.ndarray(len(data) + 8, "<u8", np.append(data, np.zeros(16, np.uint8)).data, strides=(1,))  # the 8 bytes from each place on
    size = stops - starts
    ahead, behind = wide[starts] & _LOW[np.minimum(size, 8)], wide[np.minimum(starts + 8, len(data))] & _LOW[np.clip(size - 8, 0, 8)]
    hashes = mixed(mixed(ahead + size.astype(_U) * _U(0x9E3779B97F4A7C15)))
    hashes = mixed(mixed(hashes ^ (behind * _U(0xD1342543DE82EF95))))
    whole = memoryview(data)
    for k in np.flatnonzero(size > SHORT).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(whole[starts[k] : stops[k]])
    return hashes


def _cuts(data: bytes) -> Iterator[tuple[int, int]]:
    """Runs of data of about BATCH bytes that end at white space."""
    at = 0
    while at < len(data):
        stop = at + BATCH
        if stop < len(data):
            back = max(data.rfind(b"\n", at, stop), data.rfind(b" ", at, stop))
            if back <= at:
                ahead = [x for x in (data.find(c, stop) for c in (b" ", b"\n")) if x >= 0]
                back = min(ahead, default=len(data) - 1)
            stop = back + 1
        stop = min(stop, len(data))
        yield at, stop
        at = stop


def word_spans(texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, stops, borders): the words of texts in data, which joins them by line ends, A-Z lowered; borders: behind each text's line end."""
    texts = [t or b"" for t in texts]
    data = b"\n".join(texts).lower()  # bytes: lowers A-Z only
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for a, b in _cuts(data):
        starts, stops = _words(np.frombuffer(data, np.uint8, b - a, a))
        found.append((starts + a, stops + a))
    return data, *map(np.concatenate, zip(*found)), np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): hashes of all words, and for each text the place behind its last."""
    texts = [t or b"" for t in texts]
    data = b"\n".join(texts).lower()
    found, hashes = [np.empty(0, np.int64)], [np.empty(0, _U)]
    for a, b in _cuts(data):
        part = np.frombuffer(data, np.uint8, b - a, a)
        starts, stops = _words(part)
        found.append(starts + a)
        hashes.append(_word_hashes(part, starts, stops))
    borders = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return np.concatenate(hashes), np.searchsorted(np.concatenate(found), borders)


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (UTF-8); a text with fewer words is one shingle."""
    hashes, ends = word_hashes(texts)
    k = min(words, max(1, len(hashes)))
    rolled = np.full(len(hashes) - k + 1, words, _U) if len(hashes) else hashes
    for i in range(k if len(hashes) else 0):
        rolled = mixed((rolled ^ hashes[i : len(hashes) - k + 1 + i]) * _U(0x9E3779B97F4A7C15))
    out, at = [], 0
    for end in ends.tolist():
        if end - at >= words:
            out.append(np.unique(rolled[at : end - words + 1]))
        elif end > at:
            short = np.full(1, end - at, _U)
            for i in range(at, end):
                short = mixed((short ^ hashes[i : i + 1]) * _U(0x9E3779B97F4A7C15))
            out.append(short)
        else:
            out.append(np.empty(0, _U))
        at = end
    return out


class Signer:
    """Minima of universal hashes a * x + b modulo 2 ** 32 of a set's hashes."""

    def __init__(self, size: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 31, size, np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, size, np.uint32)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> _U(32)).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 1024):
            for g in range(0, len(low), 64):
                v = np.multiply.outer(self.a[g : g + 64], x[at : at + 1024])
                v += self.b[g : g + 64, None]
                np.minimum(low[g : g + 64], v.min(1), out=low[g : g + 64])
        return low
