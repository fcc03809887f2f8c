"""Word windows of many texts at once, as arrays: words, their hashes and hashes of doubled length."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

#: Bytes of text that are turned into arrays at once; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes up to which a word is hashed with all others at once; longer ones one by one by XXH3.
LONG = 64
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits with avalanche."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACES = mix(np.arange(1, LONG + 2, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        both = []
        for b in (_BASE, inverse):
            x = np.full(n, b, np.uint64)
            x[:1] = 1
            both.append(np.multiply.accumulate(x))
        _powers = (both[0], both[1])
    return _powers


def blocks(texts: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_BYTES."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            yield start, k
            start, size = k, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words ([^\\x20\\x09-\\x0D]+) of a block of texts: doc (index of the text), pos (place in it), hash."""

    def __init__(self, texts: Sequence[bytes]):
        buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = _SPACE[buffer]
        starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
        up, down = _powers_to(len(buffer))
        total = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[: len(buffer)], out=total[1:])
        self.hash = mix((total[ends] - total[starts]) * down[starts])
        self._buffer, self._starts, self._ends = buffer, starts, ends
        self._hash_long(self.hash, 1)
        bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.doc = np.searchsorted(bounds, starts, side="right")
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.pos = np.arange(len(starts)) - self.first[self.doc]
        self.count = np.diff(self.first)

    def _hash_long(self, hashes: np.ndarray, seed: int) -> None:
        for k in np.flatnonzero(self._ends - self._starts > LONG):
            hashes[k] = xxhash.xxh3_64_intdigest(self._buffer[self._starts[k] : self._ends[k]].tobytes(), seed)

    def second(self) -> np.ndarray:
        """A second hash of each word, of other values for bytes and another base: with hash, 128 bits."""
        if not len(self._starts):
            return np.zeros(0, np.uint64)
        sizes = self._ends - self._starts
        begins = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) - np.repeat(begins, sizes)
        values = _VALUES[self._buffer[~_SPACE[self._buffer]]] * _PLACES[np.minimum(at, LONG)]
        hashes = mix(np.add.reduceat(values, begins) ^ sizes.astype(np.uint64))
        self._hash_long(hashes, 2)
        return hashes

    def windows(self, n: int, known: dict[int, np.ndarray] | None = None) -> np.ndarray:
        """Hashes of the n words from each word on (not minding ends of texts), by doubling: n words are two runs of ceil(n / 2), which may share one."""
        known = {} if known is None else known
        known.setdefault(1, self.hash)
        if n not in known:
            half = (n + 1) // 2
            h = self.windows(half, known)
            a, b = h[: max(0, len(h) - (n - half))], h[n - half :]
            known[n] = mix(a * np.uint64(0xD6E8FEB86659FD93) + mix(b ^ np.uint64(n)))
        return known[n]

    def valid(self, n: int) -> np.ndarray:
        """Which windows of n words lie in one text."""
        return self.doc[: max(0, len(self.doc) - n + 1)] == self.doc[n - 1 :]


def anchors(half: np.ndarray, n: int, width: int) -> np.ndarray:
    """For each window of n words the place of its least window of ``width`` words, the leftmost if several are."""
    span, count = n - width + 1, len(half) - (n - width)
    if count <= 0:
        return np.zeros(0, np.int64)
    best, at = half[:count].copy(), np.zeros(count, np.int64)
    for j in range(1, span):
        here = half[j : j + count]
        less = here < best
        best[less] = here[less]
        at[less] = j
    return at + np.arange(count)
