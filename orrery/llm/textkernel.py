"""Vectorised text primitives on Arrow string columns.

The concatenated UTF-8 bytes of a batch are tokenised and hashed with numpy,
without a Python object per word. All hashes are deterministic functions of
the bytes, so they agree between executors and between runs.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections import ChainMap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240601))
_BYTES = [_RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INV = pow(_BASE, -1, 2**64)
_A = np.uint64(0xD6E8FEB86659FD93)
_B = np.uint64(0xCA5A826395121157)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: True at bytes of words: `[^\x20\x09-\x0D]+` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.ones(256, bool)
ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; kept for the usual chunk size only."""
    have = _powers.get(base)
    if have is not None and len(have) >= n:
        return have[:n]
    size = max(n, CHUNK_BYTES + 1)
    out = np.empty(size, np.uint64)
    out[0] = 1
    done = 1
    while done < size:
        step = min(done, size - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 2**64))
        done += step
    if size <= 4 * CHUNK_BYTES:
        _powers[base] = out
    return out[:n]


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    arr = batch.column(name)
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    if len(arr) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def released() -> None:
    """Give freed memory back to the system: workers outlive their task and are used again."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], name: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `limit` bytes of text each."""
    try:
        yield from _slices(batches, name, limit)
    finally:
        released()


def _slices(batches: Iterator[pa.RecordBatch], name: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = column(batch, name)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def ids(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """int64 ids (0 where null) and a mask of the valid ones."""
    arr = batch.column(name).cast(pa.int64())
    return arr.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ~arr.is_null().to_numpy(zero_copy_only=False)


#: Digests of recent words of a worker process.
_digests: dict[bytes, int] = {}


class Words:
    """Word spans of a chunk. `first[d]:first[d+1]` are the words of document d."""

    __slots__ = ("data", "offsets", "start", "end", "first", "doc", "prefix")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = False):
        if lower:
            data = LOWER[data]
        n = len(data)
        inside = table[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.prefix: np.ndarray | None = None

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes: each byte is mixed with its place in the word before the sum."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        n = len(self.data)
        at = np.zeros(n, np.int64)
        at[self.start] = self.start
        place = (np.arange(n) - np.maximum.accumulate(at)).astype(np.uint64)
        s = np.empty(n + 1, np.uint64)
        s[0] = 0
        np.cumsum(mix((place << np.uint64(8) | self.data) + np.uint64((1 + seed) * int(_A) % 2**64)), out=s[1:])
        return mix(s[self.end] - s[self.start] + (self.end - self.start).astype(np.uint64) * _B)

    def digests(self) -> np.ndarray:
        """64 bits of a cryptographic hash of each word: words of equal digests can't be made on purpose with less than 2**32 trials."""
        raw = self.data.tobytes()
        words = [raw[a:z] for a, z in zip(self.start.tolist(), self.end.tolist(), strict=True)]
        if len(_digests) > 200_000:
            _digests.clear()
        new = set(words).difference(_digests)
        fresh = {w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in new}
        _digests.update((w, h) for w, h in fresh.items() if len(w) <= 64)
        both = ChainMap(fresh, _digests) if any(len(w) > 64 for w in new) else _digests
        return np.fromiter(map(both.__getitem__, words), np.uint64, len(words))

    def runs(self, k: int) -> np.ndarray:
        """Word indexes at which k consecutive words of one document start."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])


def prefix_sums(data: np.ndarray, seed: int = 0) -> np.ndarray:
    s = np.empty(len(data) + 1, np.uint64)
    s[0] = 0
    np.cumsum(_BYTES[seed][data] * powers(_BASE, len(data)), out=s[1:])
    return s


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """Hash of data[i:i+q] for each i, regardless of document limits."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    s = prefix_sums(data)
    n = len(data) - q + 1
    return mix((s[q:] - s[:n]) * powers(_BASE_INV, n))


def windows(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Order-sensitive hash of h[i:i+k] for each i, in about log2(k) steps."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    a, b = (_A, _B) if not seed else (_B ^ np.uint64(2 * seed), _A ^ np.uint64(2 * seed))
    cur, size = mix(h * a + np.uint64(seed)), 1
    out, done = None, 0
    bits = k
    while bits:
        if bits & 1:
            if out is None:
                out = cur
            else:
                n = min(len(out), len(cur) - done)
                out = mix(out[:n] * a + cur[done : done + n] * b)
            done += size
        bits >>= 1
        if bits:
            cur = mix(cur[:-size] * a + cur[size:] * b)
            size *= 2
    return out[: len(h) - k + 1]


def sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op.reduce over each w consecutive values (op: np.minimum or np.maximum)."""
    if len(x) < w:
        return x[:0]
    cur, size = x, 1
    while 2 * size <= w:
        cur = op(cur[:-size], cur[size:])
        size *= 2
    n = len(x) - w + 1
    return op(cur[:n], cur[w - size : w - size + n])


def window_minima(grams: np.ndarray, doc: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Of k-gram hashes: the least of each w consecutive ones, as keys of windows of k + w - 1 units, and the
    places of the grams that are least in some window. Equal windows have equal keys at equal offsets.

    doc: document of each unit. Keys are for all places, of windows that leave their document too."""
    low = sliding(grams, w, np.minimum)
    whole = doc[: len(low)] == doc[k + w - 2 : k + w - 2 + len(low)]
    padded = np.r_[np.zeros(w - 1, np.uint64), np.where(whole, low, np.uint64(0)), np.zeros(w - 1, np.uint64)]
    at = np.flatnonzero(sliding(padded, w, np.maximum)[: len(grams)] == grams) if len(low) else np.zeros(0, np.int64)
    return low, at


def merged(start: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of half-open intervals in each group, as maximal runs sorted by group and start."""
    if not len(start):
        return start, end, group
    order = np.lexsort((start, group))
    start, end, group = start[order], end[order], group[order]
    # ends are lifted by group, so that one running maximum serves all groups
    lift = (int(end.max()) + 1) * (np.cumsum(np.r_[0, group[1:] != group[:-1]]))
    reach = np.maximum.accumulate(end + lift)
    fresh = np.r_[True, start[1:] + lift[1:] > reach[:-1]]
    at = np.flatnonzero(fresh)
    last = np.r_[at[1:], len(start)] - 1
    return start[at], (reach - lift)[last], group[at]


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Mask of the positions below n that some interval covers."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, np.minimum(end, n), -1)
    return np.cumsum(d[:-1]) > 0
