"""Words and word shingles of whole texts as 64-bit hashes, computed in numpy on the executors."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multipliers of the shingle hash.
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


def finish(h: np.ndarray) -> np.ndarray:
    """Spread every bit of h over the whole word."""
    h = h ^ (h >> np.uint64(32))
    h = h * STEP
    h = h ^ (h >> np.uint64(29))
    h = h * MIX
    return h ^ (h >> np.uint64(32))


#: What a worker keeps for the next task of the same operator, by name; a task of another operator drops it.
kept: dict[str, object] = {}


def tidy() -> None:
    """Give memory that is no longer used back to the system: a worker goes on from task to task, with what each one's
    largest arrays once took, and with what is kept."""
    kept.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


class WordHasher:
    """64-bit hashes of a text's words: runs of bytes other than ASCII white space, A to Z lower-cased.

    Hashes of words seen are kept, up to ``room`` of them; then the store starts anew, so memory is bounded. One is made
    at the beginning of a task.
    """

    def __init__(self, room: int = 100_000):
        tidy()
        self.known: dict[bytes, int] = {}
        self.room = room

    def words(self, text: str | None) -> list[bytes]:
        return (text or "").encode("utf-8", "surrogatepass").lower().split()

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            pass
        if len(known) > self.room:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.array([known[w] for w in words], dtype=np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        return self.hashes(self.words(text))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles in order; with fewer than k words the whole sequence is one, none without words."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(k, n)
    h = np.full(n - width + 1, np.uint64(width))
    for i in range(width):
        h = (h ^ hashes[i : n - width + 1 + i]) * MIX
        h = h ^ (h >> np.uint64(31))
    return finish(h)


def batches_of(column, limit_bytes: int = 4 << 20) -> Iterator[tuple[int, list]]:
    """Offsets and lists of an Arrow string column's values, at most about ``limit_bytes`` (or one value) at a time."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths + 64)
    start = 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit_bytes, side="right")))
        yield start, column.slice(start, stop - start).to_pylist()
        start = stop
