"""Vectorised text kernels: words and word n-grams of many documents as 64-bit hashes.

Words are runs of bytes other than 0x20 and 0x09-0x0D. These bytes never occur inside a multi-byte UTF-8 character, so all
work is done on the encoded bytes. All arithmetic is modulo 2**64 and depends on no per-process seed: every executor gets
the same hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes worked on at once; bounds the temporaries, not the documents.
GROUP_BYTES = 1 << 20
_U = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (two multiply and xor-shift rounds)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two hashes."""
    return mix(a * _U(0x9E3779B97F4A7C15) + (b ^ (b >> _U(29))) * _U(0xC2B2AE3D27D4EB4F) + _U(1))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_POWERS = np.ones(1, _U)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 256), 0x5851F42D4C957F2D, _U)
        steps[0] = 1
        _POWERS = np.cumprod(steps, dtype=_U)
    return _POWERS


def _hash_buffer(buf: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of one buffer."""
    word = ~_SEP[buf]
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.zeros(0, _U)
    lens = ends - starts
    data = buf[word]
    if lower:
        data = _LOWER[data]
    first = np.cumsum(lens) - lens
    at = np.arange(len(data)) - np.repeat(first, lens)
    h = np.add.reduceat(_BYTE[data] * _powers(int(lens.max()))[at], first)
    return starts, mix(h + lens.astype(_U) * _U(0x2545F4914F6CDD1D))


def _cuts(data: bytes) -> Iterator[bytes]:
    """Pieces of a very long document, cut at separators only."""
    at = 0
    while len(data) - at > 2 * GROUP_BYTES:
        window = np.frombuffer(data, np.uint8, GROUP_BYTES, at)
        seps = np.flatnonzero(_SEP[window])
        if not len(seps):  # a word longer than the window: take it whole
            rest = np.flatnonzero(_SEP[np.frombuffer(data, np.uint8, -1, at)])
            cut = at + int(rest[0]) + 1 if len(rest) else len(data)
        else:
            cut = at + int(seps[-1]) + 1
        yield data[at:cut]
        at = cut
    yield data[at:]


def word_hashes(texts: list[bytes], lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first document, word hashes of a few documents one after another, bounds) in order.

    Document first + i has the words hashes[bounds[i]:bounds[i + 1]].
    """
    i = 0
    while i < len(texts):
        if len(texts[i]) > GROUP_BYTES:
            parts = [_hash_buffer(np.frombuffer(p, np.uint8), lower)[1] for p in _cuts(texts[i]) if p]
            hashes = np.concatenate(parts) if parts else np.zeros(0, _U)
            yield i, hashes, np.array([0, len(hashes)])
            i += 1
            continue
        j, total = i, 0
        while j < len(texts) and total + len(texts[j]) <= GROUP_BYTES:
            total += len(texts[j]) + 1
            j += 1
        begin = np.cumsum([0] + [len(t) + 1 for t in texts[i:j]])
        starts, hashes = _hash_buffer(np.frombuffer(b" ".join(texts[i:j]), np.uint8), lower)
        yield i, hashes, np.searchsorted(starts, begin)
        i = j


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words: entry i covers words[i:i + n]; made by doubling, in log2(n) steps."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    power, size, done, out = words, 1, 0, None
    while True:
        if n & size:
            piece = power[done : done + m]
            out = piece if out is None else combine(out, piece)
            done += size
        if done == n:
            return out
        power = combine(power[:-size], power[size:])
        size *= 2


def encode(values: list) -> list[bytes]:
    """UTF-8 bytes of texts; null is empty."""
    return [b"" if v is None else v.encode("utf-8", "surrogatepass") for v in values]
