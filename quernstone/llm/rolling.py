"""Prefix polynomial hashes of byte strings modulo 2**64, and hashes of words and shingles from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes that are hashed at once, so that prefix hashes and powers stay small however long a text is.
CHUNK = 1 << 22
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and its inverse for k up to n, kept between calls."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        with np.errstate(over="ignore"):
            for k, base in enumerate((BASE, INVERSE)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """At k the hash of the first k bytes: the sum of (byte + 1) * BASE**place."""
    out = np.zeros(len(data) + 1, np.uint64)
    up, _ = powers(len(data))
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def ranges(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The hash of the bytes from start to stop, the same wherever they stand."""
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return (prefix[stop] - prefix[start]) * down[start]


def grouped(start: np.ndarray, stop: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Groups (from, to) of ascending ranges that together span at most ``most`` bytes, or hold one range."""
    a, most = 0, most or CHUNK
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(stop, start[a] + most, "right")))
        yield a, b
        a = b


def range_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """``ranges`` of ascending ranges of any length, hashed group by group."""
    out = np.zeros(len(start), np.uint64)
    for a, b in grouped(start, stop):
        low, high = int(start[a]), int(stop[b - 1])
        if high - low <= CHUNK:
            out[a:b] = ranges(prefix_hashes(data[low:high]), start[a:b] - low, stop[a:b] - low)
            continue
        total, power = 0, 1  # one range; the hash of xy is that of x plus BASE**len(x) times that of y
        for k in range(low, high, CHUNK):
            part = data[k : min(k + CHUNK, high)]
            total += power * int(prefix_hashes(part)[-1])
            power = power * pow(int(BASE), len(part), 1 << 64) % (1 << 64)
        out[a] = total % (1 << 64)
    return out


_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_BLANK = np.array([c in b" \t\n\x0b\x0c\r" for c in range(256)])
#: What each word of a shingle is multiplied by.
_PLACES = mix(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word shingles of each text, sorted within a text, and their bounds.

    A text of fewer words than ``size``, but not none, has its whole sequence as its one shingle.
    """
    data = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_BLANK[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edges[::2], edges[1::2]
    word = mix(range_hashes(data, start, stop))
    first = np.searchsorted(start, begins)  # of the words of each text
    n = np.diff(first)
    with np.errstate(over="ignore"):
        total = np.zeros(max(0, len(word) - size + 1), np.uint64)
        for k in range(size if len(total) else 0):
            total += word[k : len(word) - size + 1 + k] * _PLACES[k]
    total = mix(total)
    parts: list[np.ndarray] = []
    for a, count in zip(first[:-1].tolist(), n.tolist(), strict=True):
        if count >= size:
            own = total[a : a + count - size + 1]
            own.sort()
            parts.append(own)
        elif count:
            with np.errstate(over="ignore"):
                parts.append(mix((word[a : a + count] * _PLACES[:count]).sum(keepdims=True, dtype=np.uint64) + np.uint64(count)))
        else:
            parts.append(total[:0])
    sizes = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate(parts) if parts else total[:0]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    new[bounds[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return flat[new], kept[bounds]
