"""Word hashes of many texts at once, in NumPy over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .support import text_bytes

_U = np.uint64


def spread(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values: multiply, fold the high half in, multiply."""
    x = x * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2 ** 64
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = spread(np.arange(1, 257, dtype=np.uint64))
#: ASCII letters and digits, and every byte of a character beyond ASCII.
_WORD = np.array([chr(b).isalnum() or b >= 128 for b in range(128)] + [True] * 128)
#: All bytes but the six ASCII spaces; A-Z count as a-z.
_PLAIN = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
FOLDED = _VALUE[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
#: Texts are walked in pieces that fit a core's cache, so a text of any length takes little beside its words.
PIECE = 1 << 17
_UP, _DOWN = powers(_BASE, PIECE), powers(_INVERSE, PIECE)


def walk_runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end) of every run of member bytes in every text.

    A run's hash is its polynomial over the bytes' values: the difference of two running sums, brought back to
    power zero. The sums go on from piece to piece, so runs may cross pieces.
    """
    begins, ends, starts, stops, lifts = [], [], [], [], []
    running, inside = np.zeros(1, np.uint64), False
    for at in range(0, len(data), PIECE):
        part = data[at : at + PIECE]
        n = len(part)
        lift, drop = _U(pow(_BASE, at, 1 << 64)), _U(pow(_INVERSE, at, 1 << 64))
        word = member[part]
        before = np.empty(n, bool)
        before[0], before[1:] = inside, word[:-1]
        first, stop = word & ~before, before & ~word
        edge = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, at + n)] - at
        first[edge], stop[edge] = word[edge], before[edge]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(value[part] * _UP[:n], out=total[1:])
        total = running + total * lift
        begin = np.flatnonzero(first)
        begins.append(begin + at)
        starts.append(total[begin])
        lifts.append(_DOWN[begin] * drop)
        end = np.flatnonzero(stop)
        ends.append(end + at)
        stops.append(total[end])
        running, inside = total[-1:], bool(word[-1])
    if inside:
        ends.append(np.array([len(data)]))
        stops.append(running)
    if not begins:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = spread((np.concatenate(stops) - np.concatenate(starts)) * np.concatenate(lifts))
    return found, np.concatenate(begins), np.concatenate(ends)


def _walk(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, and n + 1 offsets of the texts' runs."""
    found, begin, _ = walk_runs(data, offsets, member, value)
    return found, np.searchsorted(begin, offsets)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One hash for every word of every text, and n + 1 offsets of the texts' words.

    Texts are lower-cased; a word is a run of ASCII letters and digits and of characters beyond ASCII.
    """
    return _walk(*text_bytes(pc.utf8_lower(texts)), _WORD, _VALUE)


def plain_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    r"""The same with A-Z lower-cased and words that are runs of bytes other than \x20 and \x09-\x0D."""
    return _walk(*text_bytes(texts), _PLAIN, FOLDED)


def exact_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same words, unchanged."""
    return _walk(*text_bytes(texts), _PLAIN, _VALUE)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` words from each position on (also across texts: mask those with the offsets)."""
    n = max(len(words) - width + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = spread(out + words[j : j + n] + _U(j + 1))
    return out


class HashSet:
    """Membership of many hashes in a sorted set: a bitmap lets few through, a binary search decides."""

    def __init__(self, members: np.ndarray, bits: int = 20):
        self.members, self.shift = np.unique(members), _U(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self.members >> self.shift] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `hashes` that are members, and their ranks in the set."""
        at = np.flatnonzero(self.maybe[hashes >> self.shift])
        rank = np.searchsorted(self.members, hashes[at])
        found = rank < len(self.members)
        found[found] = self.members[rank[found]] == hashes[at[found]]
        return at[found], rank[found]
