"""Byte-level text kernels shared by the free-style operators.

Everything here works on the raw UTF-8 buffer of an Arrow string column, so a
batch of documents is tokenised and hashed by a handful of numpy passes instead
of a Python loop over words.  Memory is bounded: callers feed slices of a few
megabytes (:func:`slices`), and inside a slice the hash runs over windows of
``STEP`` bytes cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
MULT = 0x9E3779B97F4A7C15
STEP = 1 << 16
#: Bytes of text that one call handles at a time (longer single texts pass whole).
SLICE_BYTES = 4 << 20

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _table(*spans: tuple[int, int]) -> bytes:
    return bytes(any(a <= x <= b for a, b in spans) for x in range(256))


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
ALNUM = _table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: ``[^\x20\x09-\x0D]+``
NONSPACE = _table((0x00, 0x08), (0x0E, 0x1F), (0x21, 0xFF))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), dtype=U)
    out[0] = 1
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * U(pow(base, have, 1 << 64))
        have += take
    return out


_INVERSE = pow(MULT, -1, 1 << 64)
_POW, _INV = _powers(MULT, STEP + 1), _powers(_INVERSE, STEP + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's constants)."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text (one row at least)."""
    if not len(texts):
        return
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, side="right")) - 1)
        yield a, b
        a = b


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its row offsets (nulls are empty)."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(offs), np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def bounds(buf: np.ndarray, offs: np.ndarray, table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte start and end of each word; words never run across rows."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = np.frombuffer(b"\0" + buf.tobytes().translate(table) + b"\0", np.bool_)
    d = np.flatnonzero(m[1:] != m[:-1])
    st, en = d[::2], d[1::2]
    cut = np.unique(offs[(offs > 0) & (offs < n)])
    cut = cut[m[cut] & m[cut + 1]] if len(cut) else cut
    if len(cut):
        st, en = np.sort(np.concatenate([st, cut])), np.sort(np.concatenate([en, cut]))
    return st, en


def hashes(buf: np.ndarray, st: np.ndarray, en: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased word."""
    out = np.empty(len(st), dtype=U)
    p, n = 0, len(st)
    while p < n:
        base = int(st[p])
        q = max(p + 1, int(np.searchsorted(en, base + STEP, side="right")))
        size = int(en[q - 1]) - base
        pw, iv = (_POW, _INV) if size <= STEP else (_powers(MULT, size), _powers(_INVERSE, size + 1))
        c = np.zeros(size + 1, dtype=U)
        part = np.frombuffer(buf[base : base + size].tobytes().translate(_LOWER), np.uint8).astype(U)
        part += U(1)
        part *= pw[:size]
        np.cumsum(part, out=c[1:])
        s = st[p:q] - base
        out[p:q] = (c[en[p:q] - base] - c[s]) * iv[s]
        p = q
    return mix(out)


def words(texts: pa.Array, table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each row's range in them (``len(texts) + 1`` offsets)."""
    buf, offs = raw(texts)
    st, en = bounds(buf, offs, table)
    return hashes(buf, st, en), np.searchsorted(st, offs)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words that begin at each position (the last ``n - 1`` are of no use)."""
    if n == 1 or not len(h):
        return mix(h * U(MULT))
    out = h.copy()
    for k in range(1, n):
        out *= U(0xD6E8FEB86659FD93)
        out[: len(h) - k] += h[k:]
    return mix(out)


def runs(offs: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that begin at ``offs`` and have ``size`` items: row and index of every item."""
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(offs, size)
    return row, at


def shingles(h: np.ndarray, offs: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles row by row, with row offsets.

    A row of fewer than ``n`` words, but not none, has one shingle of them all.
    """
    count = np.diff(offs)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    row, at = runs(offs[:-1], size)
    out = grams(h, n)[at] if len(h) else np.zeros(0, U)
    for r in np.flatnonzero((count > 0) & (count < n)):
        a, b = offs[r], offs[r + 1]
        x = np.array([b - a], dtype=U)
        for v in h[a:b]:
            x = mix(x * U(MULT) + v)
        out[np.searchsorted(row, r)] = x[0]
    return out, np.concatenate([[0], np.cumsum(size)])
