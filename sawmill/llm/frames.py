"""Frames: blocks of documents whose tokens are kept as positions in a dictionary of their own.

An operator that must look up every token of the corpus in a table built from the corpus would shuffle
one row per token.  A frame holds about a million tokens: its distinct tokens go to the lookup once,
dealt by hash into parts, and the answers come back to the frame, where the stored positions put
the documents together again.
"""

from __future__ import annotations

from array import array

import numpy as np
import zstandard

FRAME_CHARS = 5_000_000  # bytes of text after which a frame is closed; a document is never split


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their bytes kept apart by significance and compressed."""
    v = np.ascontiguousarray(values, np.uint32)
    return zstandard.ZstdCompressor(level=3).compress(v.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()


def pack_strings(items: list[bytes]) -> bytes:
    lens = np.fromiter(map(len, items), np.uint32, len(items))
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(items)).tobytes() + lens.tobytes() + b"".join(items))


def unpack_strings(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    starts = np.concatenate([[4 + 4 * n], ends[:-1]]).tolist() if n else []
    return [raw[s:e] for s, e in zip(starts, ends.tolist(), strict=True)]


def by_part(parts: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that puts equal parts together, and the ends of each part in it."""
    order = np.argsort(parts, kind="stable")
    return order, np.searchsorted(parts[order], np.arange(n_parts + 1))


class Frame:
    """Documents gathered so far: each token a number in order of first sight."""

    def __init__(self):
        self.ids, self.lens, self.seq, self.bytes = [], [], array("I"), 0

    def add(self, doc_id, tokens, size: int) -> None:
        before = len(self.seq)
        self.seq.extend(tokens)
        self.ids.append(doc_id)
        self.lens.append(len(self.seq) - before)
        self.bytes += size

    def ranked(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens as places in the dictionary ordered by frequency, which compress better; and that order."""
        seq = np.frombuffer(self.seq, np.uint32) if len(self.seq) else np.empty(0, np.uint32)
        order = np.argsort(-np.bincount(seq, minlength=n), kind="stable")
        at = np.empty(n, np.uint32)
        at[order] = np.arange(n, dtype=np.uint32)
        return at[seq], order
