"""Words of many texts as arrays: offsets and 64-bit hashes, without a Python loop over words.

Texts are lower-cased (A-Z) and cut at `[\\x20\\x09-\\x0D]+`. A word's hash is a polynomial of its bytes, taken from
wrapping prefix sums and mixed; a run of words hashes as a polynomial of its words' hashes in the same way. Two bases
make two independent hashes of a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Odd bases of the polynomials: of bytes, and of words (two, for runs that are told apart by 128 bits).
_BYTE_BASE, _WORD_BASES = 0xA24BAED4963EE407, (0xD6E8FEB86659FD93, 0x9FB21C651E98DF25)
_GAP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_VALUE = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Bytes of text that are taken at a time, or one longer text.
CHUNK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, wrapping; kept between calls up to a few MB."""
    held = _POWERS.get(base)
    if held is None or len(held) <= n:
        x = np.full(max(n, CHUNK) + 1, np.uint64(base))
        x[0] = 1
        held = np.multiply.accumulate(x)
        if len(held) <= 4 * CHUNK:
            _POWERS[base] = held
    return held


def _sums(x: np.ndarray, base: int) -> np.ndarray:
    """Wrapping prefix sums of x[i] * base ** i, with a zero in front."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.add.accumulate(x * _powers(base, len(x))[: len(x)], out=out[1:])
    return out


def _between(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int) -> np.ndarray:
    """Polynomial of the stretch from start to stop (exclusive), whatever stands before it."""
    return (sums[stop] - sums[start]) * _powers(pow(base, -1, 1 << 64), len(sums))[start]


class Words:
    """Words of a list of byte strings: start and end (bytes in data), text (which one), first (their first words)."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.data = _LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        n = len(self.data)
        gap = _GAP[self.data]
        first = np.ones(n + 1, bool)  # whether a byte follows a gap or begins a text
        first[1:] = np.append(gap[:-1], True) if n else first[1:]
        if n:
            first[1:n] = gap[:-1]
        first[self.begins] = True
        word = ~gap
        self.start = np.flatnonzero(word & first[:n])
        last = np.empty(n, bool)
        if n:
            last[:-1] = gap[1:] | first[1:n]
            last[-1] = True
        self.end = np.flatnonzero(word & last) + 1
        self.text = np.searchsorted(self.ends, self.start, "right")
        self.first = np.searchsorted(self.start, np.append(self.begins, n))
        self.hash = mixed(_between(_sums(_VALUE[self.data], _BYTE_BASE), self.start, self.end, _BYTE_BASE))

    def runs(self, start: np.ndarray, stop: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of runs of words."""
        base = _WORD_BASES[which]
        return mixed(_between(_sums(self.hash, base), start, stop, base) + (stop - start).astype(np.uint64))

    def characters(self) -> np.ndarray:
        """For every byte offset, and the end of data, how many code points lie before it in all texts."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, row after the last, texts as UTF-8) of neighbouring rows of about CHUNK bytes; null is empty."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > CHUNK:
            yield first, i, held
            held, size, first = [], 0, i
        held.append(raw)
        size += len(raw)
    if held:
        yield first, len(texts), held
