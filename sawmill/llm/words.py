"""Word and shingle hashes of whole texts, used inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_MIX1, _MIX2, _MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")
WINDOW = 1 << 20  # bytes hashed at a time
LONG = 64  # bytes from which on a word is hashed by itself
#: Masks of the first 0 to 8 bytes of a block.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX2
    return h ^ (h >> np.uint64(29))


def _absorb(h: np.ndarray, block: np.ndarray) -> np.ndarray:
    """A word's hash after its next 8 bytes; not linear in them, so words don't cancel out."""
    h = (h ^ block) * _MIX3
    h = (h ^ (h >> np.uint64(32))) * _MIX1
    return h ^ (h >> np.uint64(29))


def _window_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of ``data``, taken from blocks of 8 bytes; of long words from the library's 64-bit hash."""
    space = np.concatenate([[True], _SPACE[np.frombuffer(data, np.uint8)], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    size = ends - starts
    blocks = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))  # the 8 bytes from each place on
    h = size.astype(np.uint64) * _MIX1
    rest, at = np.flatnonzero(size <= LONG), 0
    while len(rest):
        left = size[rest] - at
        h[rest] = _absorb(h[rest], blocks[starts[rest] + at] & _FIRST[np.minimum(left, 8)])
        rest, at = rest[left > 8], at + 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(data[starts[i]:ends[i]]))
    return starts, mix(h)


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the 64-bit hashes of its words, A-Z lower-cased."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < WINDOW):
            size += len(texts[end]) + 1
            end += 1
        data = b"\n".join(texts[at:end]).lower()
        lens = np.fromiter(map(len, texts[at:end]), np.int64, end - at)
        starts, hashes, pos = [], [], 0
        while pos < len(data):
            cut = len(data)
            if cut - pos > WINDOW and (gap := _GAP.search(data, pos + WINDOW)):
                cut = gap.start()
            s, h = _window_hashes(data[pos:cut])
            starts.append(s + pos)
            hashes.append(h)
            pos = cut
        if starts:
            bounds = np.searchsorted(np.concatenate(starts), np.cumsum(lens + 1))
            yield from np.split(np.concatenate(hashes), bounds[:-1])
        else:
            yield from (np.empty(0, np.uint64) for _ in range(at, end))
        at = end


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of ``k``-word shingles; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    h = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        h = h * _MIX1 + words[i:n - width + 1 + i]
    return np.unique(mix(h))


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    return (shingles(w, k) for w in word_hashes(texts))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
