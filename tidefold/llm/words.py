"""Vectorised word hashing over UTF-8 text.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D).
Each word gets a 64-bit hash; runs of words get hashes built from those. All
work is done with numpy on pieces of bounded size, so one very long text needs
memory in proportion to its words, never a multiple of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_M64 = (1 << 64) - 1


def _stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers: the finaliser of splitmix64 over a counter."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & _M64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _stream(11, 256)
_BYTE_LOWER = _BYTE[_LOWER]
_P = 0x2545F4914F6CDD1D | 1


def _powers(p: int, n: int) -> np.ndarray:
    out = np.full(n, p, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_P, PIECE + 1)
_INV = _powers(pow(_P, -1, 1 << 64), PIECE + 1)
WEIGHTS = _stream(23, 128) | np.uint64(1)
WEIGHTS_B = _stream(37, 128) | np.uint64(1)


def _hash_piece(buf: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of a piece that cuts no word."""
    word = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[0::2], edge[1::2]
    if len(buf) >= len(_POW):
        pow_, inv = _powers(_P, len(buf) + 1), _powers(pow(_P, -1, 1 << 64), len(buf) + 1)
    else:
        pow_, inv = _POW, _INV
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[buf] * pow_[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64)), starts, ends


def hash_words(data: bytes, lower: bool) -> np.ndarray:
    """The 64-bit hashes of all words of one text, in order."""
    return np.concatenate([h for h, _, _ in pieces(data, lower)] or [np.zeros(0, np.uint64)])


def pieces(data: bytes, lower: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes, starts and ends (absolute) of words, piece by piece."""
    buf, at = np.frombuffer(data, np.uint8), 0
    while at < len(buf):
        end = min(at + PIECE, len(buf))
        while end < len(buf):  # no piece ends inside a word
            gaps = np.flatnonzero(_SPACE[buf[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(end + PIECE, len(buf))
        h, s, e = _hash_piece(buf[at:end], lower)
        yield h, s + at, e + at
        at = end


def batches(batch: pa.RecordBatch, text: str, limit: int = PIECE) -> Iterator[tuple[slice, list[bytes | None]]]:
    """Row ranges of about `limit` text bytes each, with their texts as UTF-8."""
    col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
    at = 0
    while at < len(col):
        ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset + at : col.offset + len(col) + 1]
        n = max(1, int(np.searchsorted(ends - ends[0], limit, side="right")) - 1)
        n = min(n, len(col) - at)
        yield slice(at, at + n), col.slice(at, n).to_pylist()
        at += n


def hash_texts(texts: list[bytes | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts in one array, and each text's bounds in it (n + 1 numbers)."""
    texts = [x or b"" for x in texts]
    lens = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
    found = list(pieces(b" ".join(texts), lower))
    hashes = np.concatenate([f[0] for f in found] or [np.zeros(0, np.uint64)])
    starts = np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])
    return hashes, np.concatenate([[0], np.searchsorted(starts, np.cumsum(lens))])


def runs(h: np.ndarray, k: int, weights: np.ndarray = WEIGHTS) -> np.ndarray:
    """Hashes of every k consecutive words: max(0, len(h) - k + 1) numbers."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * weights[0]
    for j in range(1, k):
        out += h[j : j + n] * weights[j]
    return mix(out + np.uint64(k))
