"""Words and shingles of many texts at once, hashed with numpy.

A word is a run of letters, digits and non-ASCII characters of the lower-cased text;
ASCII punctuation, white space and control characters separate words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SHINGLE = 5
#: Characters that are hashed at a time, so that arrays of a number for each byte stay small.
_CHARS = 1 << 19
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inverse = pow(int(_PRIME), -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, p, np.uint64)])) for p in (_PRIME, np.uint64(inverse)))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and for each text the number of words before it (with the total at the end)."""
    encoded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(encoded) + b" ", np.uint8)
    ends_of_text = np.cumsum([len(e) + 1 for e in encoded], dtype=np.int64)
    inside = _WORD_BYTE[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(max(20, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    hashes = mix((total[end] - total[start]) * inverse[start])
    return hashes, np.concatenate([np.zeros(1, np.int64), np.searchsorted(start, ends_of_text)])


def shingle_hashes(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of `size` words in order, and the offsets of the texts in them.

    A text of fewer words, but one at least, has one shingle of all its words; a text without words has none.
    """
    ends = np.cumsum([len(t) for t in texts])
    parts, offsets, lo = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _CHARS, "right")))
        hashes, offset = _shingles(texts[lo:hi], size)
        parts.append(hashes)
        offsets.append(offset[1:] + offsets[-1][-1])
        lo = hi
    return np.concatenate(parts), np.concatenate(offsets)


def _shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, offset = word_hashes(texts)
    count = np.diff(offset)
    shingles = np.where(count == 0, 0, np.maximum(count - size + 1, 1))
    out_offset = np.concatenate([np.zeros(1, np.int64), np.cumsum(shingles)])
    text = np.repeat(np.arange(len(texts)), shingles)
    first = np.arange(out_offset[-1]) - out_offset[text] + offset[text]
    out = np.zeros(len(first), np.uint64)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    short = count[text] < size
    for i in range(size):
        part = padded[first + i]
        if short.any():
            part = np.where(short & (first + i >= offset[text + 1]), np.uint64(0), part)
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + part + np.uint64(i + 1))
    return out, out_offset
