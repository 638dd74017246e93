"""Hashed byte n-gram counts of texts, a slice of texts at a time."""

from __future__ import annotations

import numpy as np


def gram_counts(texts: list[bytes], dim: int, lengths: tuple[int, ...] = (2, 3)) -> np.ndarray:
    """(texts, dim) counts; an n-gram never crosses texts."""
    out = np.zeros((len(texts), dim), np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    ends = np.cumsum([len(t) for t in texts]).tolist()
    for n in lengths:
        if len(raw) < n:
            continue
        h = np.full(len(raw) - n + 1, n, np.uint32)
        for i in range(n):
            np.bitwise_xor(h, raw[i : len(raw) - n + 1 + i], out=h)
            np.multiply(h, np.uint32(16777619), out=h)
        h ^= h >> np.uint32(15)
        h %= np.uint32(dim)
        for row, end, t in zip(out, ends, texts, strict=True):
            if len(t) >= n:
                row += np.bincount(h[end - len(t) : end - n + 1], minlength=dim)
    return out
