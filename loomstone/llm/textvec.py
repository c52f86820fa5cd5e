"""Vectorised word segmentation and hashing over a whole Arrow batch of texts.

All functions work on the UTF-8 bytes of the batch at once. A prefix sum of
``(byte + 1) * P**i`` modulo 2**64 gives the polynomial hash of any byte range in O(1),
so hashing every word, line or n-gram of a batch costs a few array passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: The white space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII byte that is not a letter; bytes of other code points count as letters.
NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 1 << 25:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Batch:
    """The texts of one Arrow column as one byte array; null counts as empty."""

    def __init__(self, column, fold: bool = False):
        column = pa.array(column, pa.large_string()) if isinstance(column, list) else column
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string()).fill_null("")
        n = len(column)
        _, offsets, data = column.buffers()
        self.offsets = np.frombuffer(offsets, dtype=np.int64, count=n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
        lo, hi = int(self.offsets[0]), int(self.offsets[-1])
        self.bytes = np.frombuffer(data, dtype=np.uint8, count=hi)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
        self.offsets = self.offsets - lo
        self.n = n
        if fold:
            self.bytes = LOWER[self.bytes]
        self._sums = None

    def _prefix(self) -> np.ndarray:
        if self._sums is None:
            sums = np.zeros(len(self.bytes) + 1, dtype=np.uint64)
            np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * _power(_P, len(self.bytes)), out=sums[1:])
            self._sums = sums
        return self._sums

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range; equal bytes give equal hashes."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        sums = self._prefix()
        return mix((sums[ends] - sums[starts]) * _power(_P_INV, len(self.bytes) + 1)[starts] + (ends - starts).astype(np.uint64))

    def runs(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the maximal runs of non-separator bytes; none crosses two texts."""
        inside = ~separator[self.bytes]
        before = np.empty(len(inside), dtype=bool)
        if len(inside):
            before[0] = False
            before[1:] = inside[:-1]
            cuts = self.offsets[1:-1]
            before[cuts[cuts < len(inside)]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty(len(inside), dtype=bool)
        if len(inside):
            after[-1] = False
            after[:-1] = inside[1:]
            cuts = self.offsets[1:-1]
            after[cuts[cuts > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, self.owner(starts)

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The text that holds each byte position."""
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Starts, ends and text numbers of all \n-split lines, the empty ones too (a text has one more than its \n)."""
        breaks = np.flatnonzero(self.bytes == 0x0A)
        owner = self.owner(breaks)
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        ends = np.concatenate([breaks, self.offsets[1:]])
        who = np.concatenate([np.arange(self.n), owner])
        order = np.lexsort((starts, who))
        end_order = np.lexsort((ends, np.concatenate([owner, np.arange(self.n)])))
        return starts[order], ends[end_order], who[order]


def ngrams(words: np.ndarray, owner: np.ndarray, n: int, gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-gram of word hashes (every ``gap``-th word) and the index of its first word; none crosses two texts."""
    span = (n - 1) * gap
    if len(words) <= span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[: len(owner) - span] == owner[span:])
    h = np.full(len(at), n * 131 + gap, dtype=np.uint64)
    for k in range(n):
        h = h * np.uint64(_P) + words[at + k * gap]
    return mix(h), at


def counts_by(owner: np.ndarray, n: int, weights=None) -> np.ndarray:
    """Number (or sum of weights) of the entries of each text."""
    return np.bincount(owner, weights=weights, minlength=n)[:n] if len(owner) else np.zeros(n)


class Collision(Exception):
    """Equal hashes of unequal entries."""


def equal_ranges(b: Batch, s: np.ndarray, e: np.ndarray, t: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Whether the bytes from s to e are those from t to f, range by range."""
    same = e - s == f - t
    raw = b.bytes.tobytes() + bytes(8)
    words = np.ndarray(shape=(len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    for k in range(0, 64, 8):
        at = np.flatnonzero(same & (e - s > k))
        if not len(at):
            return same
        rest = np.minimum(e[at] - s[at] - k, 8).astype(np.uint64)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest)
        same[at] = (words[s[at] + k] & mask) == (words[t[at] + k] & mask)
    for i in np.flatnonzero(same & (e - s > 64)):
        same[i] = raw[s[i] + 64 : e[i]] == raw[t[i] + 64 : f[i]]
    return same


def check_hashes(b: Batch, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
    """Raises Collision if two unequal ranges have the same hash."""
    order = np.argsort(hashes, kind="stable")
    i, j = order[:-1], order[1:]
    both = hashes[i] == hashes[j]
    i, j = i[both], j[both]
    if not equal_ranges(b, starts[i], ends[i], starts[j], ends[j]).all():
        raise Collision


def exact_keys(b: Batch, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each range, the same for equal bytes and for them only."""
    raw, known = b.bytes.tobytes(), {}
    return np.fromiter((known.setdefault(raw[s:e], len(known)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), dtype=np.uint64, count=len(starts))


def repeated(keys: np.ndarray, owner: np.ndarray, same=None) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: does its key occur elsewhere in the same text, and did it occur earlier there.

    ``same`` tells for two arrays of entries whether they are equal; if keys are but entries are not, Collision is raised.
    """
    n = len(keys)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((keys, owner))
    i, j = order[:-1], order[1:]
    pair = (keys[i] == keys[j]) & (owner[i] == owner[j])
    if same is not None and not same(i[pair], j[pair]).all():
        raise Collision
    again, later = np.zeros(n, bool), np.zeros(n, bool)
    later[j] = pair
    again[j] |= pair
    again[i] |= pair
    return again, later
