"""Passage encodings of whole texts: byte statistics in NumPy, for the small models trained here."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .support import text_bytes

PASSAGE_BYTES = 1024
_PAIRS = 192


def _classes() -> np.ndarray:
    """Byte -> class: printable ASCII one by one, line feed, other controls, and pairs of bytes from 128 on."""
    out = np.zeros(256, np.int64)
    out[32:127] = np.arange(95)
    out[:32] = out[127] = 95
    out[10] = 96
    out[128:] = 97 + np.arange(128) // 2
    return out


CLASS = _classes()
SINGLES = int(CLASS.max()) + 1
#: Byte pairs share buckets by a multiplicative hash of their classes.
_BUCKET = (np.arange(SINGLES * SINGLES, dtype=np.int64) * 2654435761 % (1 << 32) * _PAIRS) >> 32
WIDTH = SINGLES + _PAIRS + 3


#: Passages, or pieces of a whole text, that are counted at once.
GROUP = 256


def _counts(data: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Byte classes, hashed pairs of neighbours and repeated 8-byte pieces, by stretch of the data; `cut` are the
    stretches' offsets."""
    n = len(cut) - 1
    at = np.repeat(np.arange(n), np.diff(cut))
    kind = CLASS[data]
    out = np.zeros((n, SINGLES + _PAIRS + 1))
    out[:, :SINGLES] = np.bincount(at * SINGLES + kind, minlength=n * SINGLES).reshape(n, SINGLES)
    same = at[1:] == at[:-1]
    pair = _BUCKET[kind[:-1] * SINGLES + kind[1:]]
    out[:, SINGLES:-1] = np.bincount((at[:-1] * _PAIRS + pair)[same], minlength=n * _PAIRS).reshape(n, _PAIRS)
    if len(data) >= 8:
        piece = np.zeros(len(data) - 7, np.uint64)
        for j in range(8):
            piece |= data[j : len(data) - 7 + j].astype(np.uint64) << np.uint64(8 * j)
        whole = at[7:] == at[:-7]
        key = (piece * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        code = np.sort((at[:-7][whole].astype(np.uint64) << np.uint64(32)) | key[whole])
        twice = code[1:][code[1:] == code[:-1]] >> np.uint64(32)
        out[:, -1] = np.bincount(twice.astype(np.int64), minlength=n)
    return out


def _features(counts: np.ndarray, passage_bytes: int) -> np.ndarray:
    single, double, again = counts[:, :SINGLES], counts[:, SINGLES:-1], counts[:, -1]
    length = single.sum(axis=1)
    words = single[:, 0] + single[:, 96] + 1
    safe = np.maximum(length, 1)[:, None]
    extra = np.stack([again / safe[:, 0], length / words / 10, length / passage_bytes], axis=1)
    return np.concatenate([np.sqrt(single / safe), np.sqrt(double / safe), extra], axis=1).astype(np.float32)


def encode(texts: pa.Array, passage_bytes: int = PASSAGE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """A float32 row for every passage of every text, and n + 1 offsets of the texts' passages.

    A passage is passage_bytes of the text, the last one shorter; an empty text has one empty passage.
    Features: frequencies of byte classes and of hashed pairs of neighbours, the share of 8-byte pieces that
    stand again in the passage, mean word length and the passage's fullness. Passages are counted GROUP at a
    time, so beside its rows a text of any length takes little memory.
    """
    data, offsets = text_bytes(texts)
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // passage_bytes))
    at = np.r_[0, np.cumsum(count)]
    text = np.repeat(np.arange(len(size)), count)
    begin = offsets[text] + (np.arange(at[-1]) - at[text]) * passage_bytes
    cut = np.r_[begin, offsets[-1]]
    out = np.empty((len(begin), WIDTH), np.float32)
    for k in range(0, len(begin), GROUP):
        part = cut[k : k + GROUP + 1]
        out[k : k + GROUP] = _features(_counts(data[part[0] : part[-1]], part - part[0]), passage_bytes)
    return out, at


def encode_whole(texts: pa.Array, piece_bytes: int = 1 << 16) -> np.ndarray:
    """One row for every whole text, from the summed counts of its pieces: pairs and repeats across their edges
    don't count."""
    data, offsets = text_bytes(texts)
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // piece_bytes))
    at = np.r_[0, np.cumsum(count)]
    text = np.repeat(np.arange(len(size)), count)
    cut = np.r_[offsets[text] + (np.arange(at[-1]) - at[text]) * piece_bytes, offsets[-1]]
    total = np.zeros((len(size), SINGLES + _PAIRS + 1))
    for k in range(0, len(text), GROUP):
        part = cut[k : k + GROUP + 1]
        # Small texts go together, long ones piece by piece.
        for a, b in _groups(np.diff(part), piece_bytes):
            np.add.at(total, text[k + a : k + b], _counts(data[part[a] : part[b]], part[a : b + 1] - part[a]))
    return _features(total, WHOLE)


def _groups(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of stretches with about `most` bytes."""
    whole = np.cumsum(sizes) // most
    edge = np.flatnonzero(np.diff(whole)) + 1
    return list(zip([0, *edge.tolist()], [*edge.tolist(), len(sizes)], strict=True))


#: As passage length: no text is this long, so fullness is zero.
WHOLE = 1 << 40
