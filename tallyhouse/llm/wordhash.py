"""Words of Arrow string columns as 64-bit hashes, for a whole batch at once with numpy.

A word is a run of anything but the six ASCII white-space characters; A-Z count as
a-z.  Its hash is ``sum(T[byte] * R ** place) mod 2 ** 64``, mixed at the end, with
fixed random T and odd R, so it comes from two prefix sums and no Python loop.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_random = np.random.Generator(np.random.PCG64(20_240_131))
_TABLE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _upper in range(ord("A"), ord("Z") + 1):
    _TABLE[_upper] = _TABLE[_upper + 32]
_R = int(_random.integers(2**62, 2**63, dtype=np.uint64)) | 1
_R_INVERSE = pow(_R, -1, 2**64)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Bytes hashed at once; powers of R and of its inverse are kept up to here.
CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 2**64))
        have += more
    return out


_UP, _DOWN = _powers(_R, CHUNK + 1), _powers(_R_INVERSE, CHUNK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and where each text begins and ends (nulls: empty)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), places - places[0]
    return np.frombuffer(data, np.uint8)[places[0] : places[-1]], places - places[0]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        origin = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, origin + CHUNK, "right")))
        if int(ends[j - 1]) - origin > CHUNK:  # one word longer than a chunk
            total = np.uint64(0)
            for at in range(origin, int(ends[i]), CHUNK):
                part = _TABLE[data[at : min(at + CHUNK, int(ends[i]))]]
                with np.errstate(over="ignore"):
                    total += (part * _UP[: len(part)]).sum(dtype=np.uint64) * np.uint64(pow(_R, at - origin, 2**64))
            out[i] = total
        else:
            part = _TABLE[data[origin : int(ends[j - 1])]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * _UP[: len(part)], out=sums[1:])
            a, b = starts[i:j] - origin, ends[i:j] - origin
            out[i:j] = (sums[b] - sums[a]) * _DOWN[a]
        i = j
    return mix(out)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    data, places = _buffers(texts)
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = len(data) > 0
    edge[places[1:-1]] = True  # a text's end ends a word
    before = np.concatenate([[False], solid])[:-1] if len(solid) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate([solid[1:], [False]]) if len(solid) else solid
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, places))
    return _hashes(data, starts, ends), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of each text, ordered inside a text; how many each text has).

    A text with fewer words than ``width`` is one shingle of all of its words; one without words has none.
    """
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    text = np.repeat(np.arange(len(counts)), n)
    begin = np.concatenate([[0], np.cumsum(n)])[:-1]
    at = np.repeat(first - begin, n) + np.arange(int(n.sum()))
    size = np.minimum(counts, width)[text]
    out = mix(size.astype(np.uint64))
    for k in range(width):
        own = size > k
        out[own] = mix(out[own] * np.uint64(0x9E3779B97F4A7C15) + hashes[at[own] + k])
    order = np.argsort(out)
    number = text[order]
    order = order[np.argsort(number.astype(np.uint16) if len(counts) <= 1 << 16 else number, kind="stable")]
    out, text = out[order], text[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    out, text = out[new], text[new]
    return out, np.bincount(text, minlength=len(counts)).astype(np.int64)
