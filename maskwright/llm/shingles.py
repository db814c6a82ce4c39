"""Hashes of words and word shingles, straight from the UTF-8 bytes of many texts at once.

A word is a run of anything but the six ASCII white-space characters, A-Z lower-cased. Its
hash is a polynomial over its bytes, taken from running sums, so no word becomes a Python
object. Hashes have 64 bits: two of a text's or pair's million shingles being equal by chance
is one in ten million.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes whose words are hashed at once.
BLOCK = 1 << 19
_U = np.uint64
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], _U)
_BASE = 0xD1342543DE82EF95
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)
#: Bytes of words: A-Z count as a-z.
_VALUE = _BYTE.copy()
_VALUE[65:91] = _VALUE[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out, k = np.ones(n, _U), 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * _U(pow(base, k, 1 << 64))
        k *= 2
    return out


_POWER = _powers(_BASE, BLOCK)
_BACK = _powers(pow(_BASE, -1, 1 << 64), BLOCK)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th of a few hash functions of hashes."""
    h = (h ^ (h >> _U(29))) * _MIX[k]
    return h ^ (h >> _U(32))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and the ends between them; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the number of its text, in order."""
    hashes, starts, last_start, last_end = [], [], 0, -1
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        n = len(part)
        space = _SPACE[part]
        bound = np.zeros(n + 1, bool)
        bound[ends[np.searchsorted(ends, at) : np.searchsorted(ends, at + n, "right")] - at] = True
        edge = np.ones(n + 1, bool)
        edge[1:n] = space[:-1] | bound[1:n]
        start = np.flatnonzero(~space & edge[:n])
        edge[:n] = space
        end = np.flatnonzero(~space & (edge[1:] | bound[1:])) + 1
        sums = np.zeros(n + 1, _U)
        np.cumsum(_VALUE[part] * _POWER[:n], out=sums[1:])
        h = (sums[end] - sums[start]) * _BACK[start]
        start, end = start + at, end + at
        if len(h):
            begins, ending = int(start[0]), int(end[-1])
            if begins == at == last_end and not bound[0]:  # a word over the edge of the block
                hashes[-1][-1:] += _U(pow(_BASE, last_end - last_start, 1 << 64)) * h[:1]
                h, start, end = h[1:], start[1:], end[1:]
            hashes.append(h)
            starts.append(start)
            last_start, last_end = (int(start[-1]) if len(h) else last_start), ending
            if not len(h):
                hashes.pop(), starts.pop()
    if not hashes:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = np.concatenate(hashes)
    return mixed(h ^ (h >> _U(32)), 0), np.searchsorted(ends, np.concatenate(starts), "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span of ``data``, which has :data:`BLOCK` bytes at most; every byte counts as it is."""
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * _POWER[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _BACK[starts] + (ends - starts).astype(_U) * _MIX[1]
    return mixed(h ^ (h >> _U(32)), 0)


def shingles(texts: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each ``k`` following words, and the number of its text; repeats stay.

    A text with fewer words has one of all its words; one without words has none.
    """
    data, ends = utf8(texts)
    x, text = words(data, ends)
    counts = np.bincount(text, minlength=len(texts))
    first = np.cumsum(counts) - counts
    m = max(0, len(x) - k + 1)
    places = np.flatnonzero(text[:m] == text[len(text) - m :])
    out, of = [_chain(x, places, k)], [text[places]]
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        out.append(_chain(x, first[short], n))
        of.append(short)
    return np.concatenate(out), np.concatenate(of)


def _chain(x: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    h = np.full(len(places), k, _U)
    for j in range(k):
        h = (h ^ x[places + j]) * _MIX[0]
        h ^= h >> _U(32)
    return h
