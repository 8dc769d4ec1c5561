"""Hashes of words, shingles and character n-grams for many texts at once, with numpy on Arrow's own buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; a longer text is a group of its own.
GROUP_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(20_26)
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _RNG.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        step = np.full(max(n, GROUP_BYTES), base)
        step[0] = 1
        have = _powers[name] = np.cumprod(step)
    return have[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty texts."""
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not wide and not (pa.types.is_string(texts.type) or pa.types.is_binary(texts.type)):
        texts, wide = texts.cast(pa.large_string()), True
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of each run of bytes other than ASCII white space."""
    inside = ~_SPACE[data]
    before = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    if len(data):
        after[:-1] = inside[1:]
        ends = offsets[1:-1]
        after[ends[(ends > 0) & (ends <= len(data))] - 1] = False
    return np.searchsorted(offsets, starts, "right") - 1, starts, np.flatnonzero(inside & ~after) + 1


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("base", _BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("inverse", _INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each word."""
    text, starts, ends = words(data, offsets)
    return text, spans(data, starts, ends)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of `size` words, in order, repeats among them. A shorter text is one shingle of all its words."""
    text, hashes = word_hashes(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(text, minlength=n)
    full = np.zeros(0, np.int64)
    joined = np.zeros(0, np.uint64)
    if len(text) >= size:
        m = len(text) - size + 1
        full = np.flatnonzero(text[:m] == text[size - 1 :])
        for i in range(size):
            part = hashes[full + i] * _PLACE[i]
            joined = part if i == 0 else joined + part
    short = np.flatnonzero(count < size)
    own = np.full(len(short), 0x51ED270B, np.uint64)
    first = np.cumsum(count) - count
    for i in range(size - 1):
        has = count[short] > i
        own[has] += hashes[first[short[has]] + i] * _PLACE[32 + i]
    which = np.concatenate([text[full], short])
    order = np.argsort(which, kind="stable")
    return which[order], mix(np.concatenate([joined, own]))[order]


#: Lower case of each code point below 0x250 that has one of one code point.
_LOWER = np.arange(0x250, dtype=np.uint32)
for _c in range(0x250):
    if len(chr(_c).lower()) == 1:
        _LOWER[_c] = ord(chr(_c).lower())


def code_points(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of UTF-8 texts."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    if len(points) != lead[-1]:  # broken UTF-8: text by text
        parts = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        points, at = np.concatenate([*parts, np.zeros(0, np.uint32)]), np.cumsum([0, *map(len, parts)])
    else:
        at = lead[offsets]
    if lower:
        points = points.copy()
        small = points < len(_LOWER)
        points[small] = _LOWER[points[small]]
    return points, at


_STEP = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def ngrams(points: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket, below 2**bits, of the n-gram that begins at each code point; 2**bits where the text ends before its end."""
    h = np.full(len(points), n * 0x7F4A7C15 & 0xFFFFFFFF, np.uint32)
    for i in range(n):
        h[: len(points) - i] += points[i:] * _STEP[i] if i else points * _STEP[0]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    out = (h >> np.uint32(32 - bits)).astype(np.int32)
    ends = offsets[1:]
    for i in range(1, n):
        at = ends - i
        out[at[at >= offsets[:-1]]] = 1 << bits
    return out


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each text's own values; 0 for empty texts."""
    out = np.zeros(len(offsets) - 1)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full])
    return out


def counted(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, n = np.unique(buckets, return_counts=True)
    return ids.astype(np.uint32), n.astype(np.uint32)
