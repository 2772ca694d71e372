"""Columns of numbers as compressed byte strings: a shuffle moves a few large values instead of millions of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_HEAD = 16


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of one length."""
    raw = b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
    return np.array([len(columns[0]), len(raw)], "<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    n, size = (int(x) for x in np.frombuffer(blob[:_HEAD], "<i8"))
    raw = pa.decompress(blob[_HEAD:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    out, at = [], 0
    for k in kinds:
        width = np.dtype(k).itemsize * n
        out.append(np.frombuffer(raw, k, n, at))
        at += width
    return out


def split(target: np.ndarray, columns: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    """A packet of the rows of each target, in the order given."""
    if not len(target):
        return [], []
    order = np.argsort(target, kind="stable")
    target = target[order]
    cut = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
    columns = [c[order] for c in columns]
    return target[cut].tolist(), [pack([c[a:b] for c in columns]) for a, b in zip(cut, [*cut[1:], len(target)])]


def gather(blobs: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    parts = [unpack(b, kinds) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, k) for i, k in enumerate(kinds)]
