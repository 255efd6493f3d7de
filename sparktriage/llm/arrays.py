"""Words of a batch of texts as numpy arrays: places, owners and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.RandomState(20).randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64)
_powers: dict[int, np.ndarray] = {}
LONG_WORD = 64
#: Words are hashed by pieces of so many bytes, so that a long text needs no more room than its bytes and words.
HASHED_BYTES = 1 << 18
_STEPS = [np.uint64(0xA0761D6478BD642F), np.uint64(0xD6E8FEB86659FD93)]


def _power(base: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, for the bytes of one piece."""
    if base not in _powers:
        have = np.full(HASHED_BYTES, base, np.uint64)
        have[0] = 1
        _powers[base] = np.multiply.accumulate(have)
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    raw: np.ndarray  # bytes of the joined texts
    starts: np.ndarray  # of words, in raw
    ends: np.ndarray
    doc: np.ndarray  # index of the text that holds the word
    first: np.ndarray  # of each text, its first word; one more at the end
    text_start: np.ndarray  # of each text, in raw

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word, equal for equal bytes (polynomial over the bytes; words over LONG_WORD by xxhash)."""
        raw, starts, ends = self.raw, self.starts, self.ends
        h = np.empty(len(starts), np.uint64)
        long = ends - starts > LONG_WORD
        at = 0
        while at < len(starts):
            origin = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, origin + HASHED_BYTES, "right")))
            last = min(int(ends[to - 1]), origin + HASHED_BYTES)  # a word beyond it is a long one
            piece = raw[origin:last]
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_VALUES[piece] * _power(_BASE)[: len(piece)], out=sums[1:])
            s, e = starts[at:to] - origin, np.minimum(ends[at:to] - origin, len(piece))
            h[at:to] = mix((sums[e] - sums[s]) * _power(_INVERSE)[s] ^ ((e - s).astype(np.uint64) << np.uint64(56)))
            at = to
        for i in np.flatnonzero(long):
            h[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].tobytes())
        return h


def split_words(texts: list[bytes], lower: bool = False) -> Words:
    joined = b" ".join(texts)
    raw = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    text_start = np.cumsum(sizes) - sizes
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = SPACE[raw]
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = turn[::2], turn[1::2]
    doc = np.searchsorted(text_start, starts, "right") - 1
    first = np.searchsorted(starts, np.append(text_start, len(raw) + 1))
    return Words(raw, starts, ends, doc, first, text_start)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of width consecutive word hashes."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    n = len(h) - width + 1
    out = h[:n]
    for k in range(1, width):
        out = mix(out * _STEPS[k % 2] + h[k : k + n])
    return out


def windows3(h: np.ndarray) -> np.ndarray:
    """Hashes of all three-word windows of consecutive word hashes."""
    return windows(h, 3)
