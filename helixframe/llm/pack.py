"""Compact binary columns for integer arrays: byte planes under zstd."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", 1)


def dump(x: np.ndarray, rising: bool = False) -> bytes:
    """``x`` as bytes; ``rising``: store differences of neighbours."""
    if rising and len(x):
        x = np.concatenate([x[:1], x[1:] - x[:-1]])
    head = np.array([len(x), x.dtype.itemsize, ord(x.dtype.kind)], dtype=np.int64).tobytes()
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return head + (_CODEC.compress(planes.tobytes(), asbytes=True) if len(x) else b"")


def load(data: bytes, rising: bool = False) -> np.ndarray:
    n, width, kind = np.frombuffer(data[:24], np.int64)
    dtype = np.dtype(f"{chr(kind)}{width}")
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(_CODEC.decompress(data[24:], int(n * width), asbytes=True), np.uint8).reshape(width, n)
    x = np.ascontiguousarray(planes.T).view(dtype).reshape(n)
    return np.cumsum(x, dtype=dtype) if rising else x
