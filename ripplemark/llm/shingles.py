"""Word shingles of texts as sets of 64-bit hashes, computed for whole batches as arrays."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Bytes between words: a space, and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_M = np.uint64(0xBF58476D1CE4E5B9)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; one to one."""
    x = (x ^ (x >> np.uint64(30))) * _M
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte, A-Z as a-z.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BYTE[65:91] = _BYTE[97:123]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    up, down = np.full(n, _ODD), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(1 << 16)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and the number of words of each text."""
    global _UP, _DOWN
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if len(data) > len(_UP):
        _UP, _DOWN = _powers(len(data) + (len(data) >> 2))
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1, append=1))
    starts, ends = edge[::2], edge[1::2]
    if len(edge) % 2:  # the last edge is the end of the data
        ends = np.append(ends, len(data))[: len(starts)]
    total = np.zeros(len(data) + 1, np.uint64)
    np.multiply(_BYTE[data], _UP[: len(data)], out=total[1:])
    total[1:][space] = 0
    np.cumsum(total, out=total)
    hashes = mix((total[ends] - total[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    cuts = np.searchsorted(starts, bounds)
    return hashes, np.diff(cuts, prepend=0)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted: runs of WORDS words, or all words if there are fewer."""
    hashes, counts = word_hashes([t.encode("utf-8") for t in texts])
    n = len(hashes)
    rolled = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rolled = rolled * _ODD + hashes[k : k + len(rolled)]
    rolled = mix(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= WORDS:
            out.append(np.unique(rolled[at : at + c - WORDS + 1]))
        elif c:
            whole = np.full(1, c, np.uint64)
            for k in range(at, at + c):
                whole = whole * _ODD + hashes[k]
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out
