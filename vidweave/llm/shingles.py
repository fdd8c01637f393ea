"""Word shingles of many texts at once, as 64-bit hashes, with numpy over the texts' bytes.

Words are runs without ASCII white space, A-Z lower-cased. A word's hash is a polynomial in the values of its
bytes, so that running sums over a block of bytes give the hashes of all its words; blocks are cut at white space,
and a word longer than a block is hashed by itself. A shingle's hash is a polynomial in the hashes of its words.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate

import numpy as np

M1, M2, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 0xD6E8FEB86659FD93
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes are white space, the values of bytes, and the powers of the base and of its inverse."""
    space = np.zeros(256, bool)
    space[list(b" \t\n\x0b\x0c\r")] = True
    values = mix(np.frombuffer(bytes(range(256)).translate(_LOWER), np.uint8) + M1)
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = (np.full(_BLOCK + 1, base, np.uint64) for base in (_BASE, inverse))
    up[0] = down[0] = 1
    return space, values, np.cumprod(up), np.cumprod(down)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and where it starts."""
    import xxhash

    space, values, up, down = _tables()
    data, hashes, places, at = np.frombuffer(raw, np.uint8), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        part = data[at : at + _BLOCK]
        blank = space[part]
        if len(part) == _BLOCK and len(data) > at + _BLOCK:
            last = int(blank[::-1].argmax())
            part, blank = part[: _BLOCK - last], blank[: _BLOCK - last]
        if len(part) == _BLOCK and not blank.any():  # a word that fills a block
            rest = space[data[at:]]
            end = at + int(rest.argmax()) if rest.any() else len(data)
            hashes.append(np.array([xxhash.xxh64_intdigest(raw[at:end].translate(_LOWER))], np.uint64))
            places.append(np.array([at], np.int64))
            at = end
            continue
        edge = np.flatnonzero(np.diff(~blank, prepend=False, append=False))
        starts, ends = edge[0::2], edge[1::2]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * up[: len(part)], out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64)))
        places.append(starts + at)
        at += len(part)
    return np.concatenate(hashes), np.concatenate(places)


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, ends): the sorted hashes of the distinct shingles of `width` words of each text, one text after
    the other, and where each text's end. A text of fewer words has the whole sequence as its only shingle."""
    encoded = [t.encode() for t in texts]
    ends = np.fromiter(accumulate(len(e) + 1 for e in encoded), np.int64, len(encoded))
    h, places = word_hashes(b"\n".join(encoded))
    last = np.searchsorted(places, ends)
    n = np.diff(last, prepend=0)
    windows = np.maximum(n - width + 1, (n > 0).astype(np.int64))
    ends = np.cumsum(windows)
    begin = np.repeat((last - n) - (ends - windows), windows) + np.arange(int(windows.sum()))
    size = np.repeat(np.minimum(n, width), windows)
    out, short = size.astype(np.uint64), bool((size < width).any())
    for k in range(width):
        if short and k:
            on = size > k
            out[on] = out[on] * M2 + h[begin[on] + k]
        else:
            out = out * M2 + h[begin + k]
    out = mix(out)
    for a, b in zip((ends - windows).tolist(), ends.tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[(ends - windows)[windows > 0]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[ends]
