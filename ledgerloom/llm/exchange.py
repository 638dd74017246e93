"""Finding repeated hashes by an exchange of compressed sorted lists.

A sender (a group of rows with a stable number) sorts its distinct hashes, cuts them by owner, an equal
share of the hash range each, and sends each owner one Golomb-Rice coded list. The owner answers with one
bit per hash: whether it was seen more than once in all. A hash costs a sender a few bytes and a bit back,
and however often a hash occurs, an owner gets it once from each sender.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOBS = "sender long, owner long, n long, coded binary, twice binary, check binary"


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned values: gaps, each a quotient in unary and a remainder of fixed width; the two kinds lie apart."""
    n = len(values)
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(int(values[-1]) // n).bit_length() - 1)
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    return np.array([n, k], "<u4").tobytes() + np.packbits(low.ravel()).tobytes() + np.packbits(unary).tobytes()


def rice_decode(blob: bytes) -> np.ndarray:
    n, k = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    raw = np.frombuffer(blob, np.uint8, offset=8)
    cut = (n * k + 7) // 8
    low = np.unpackbits(raw[:cut], count=n * k).reshape(n, k).astype(np.uint64) << np.arange(k, dtype=np.uint64)
    ends = np.flatnonzero(np.unpackbits(raw[cut:]))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    return np.cumsum(gaps + low.sum(1, dtype=np.uint64), dtype=np.uint64)


def owner_starts(owners: int, bits: int) -> np.ndarray:
    """The first hash of each owner's share."""
    return np.array([-((-o << bits) // owners) for o in range(owners)], np.uint64)


def grouped(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, check) pairs in order, the index of each input's pair, and how often each comes."""
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    head = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])) if len(k) else np.zeros(0, bool)
    back = np.empty(len(k), np.int64)
    back[order] = np.cumsum(head) - 1
    return k[head], c[head], back, np.diff(np.append(np.flatnonzero(head), len(k)))


def sent(keys: np.ndarray, counts: np.ndarray, starts: np.ndarray, checks: np.ndarray | None = None) -> Iterator[tuple[int, int, bytes, bytes, bytes | None]]:
    """(owner, n, coded list, bits of those that the sender itself has twice, checks) of sorted keys; keys are distinct, or with their checks."""
    cut = np.append(np.searchsorted(keys, starts), len(keys))
    for o in np.flatnonzero(np.diff(cut)):
        own = slice(cut[o], cut[o + 1])
        twice = np.packbits(counts[own] > 1, bitorder="little").tobytes()
        yield int(o), int(cut[o + 1] - cut[o]), rice_encode(keys[own] - starts[o]), twice, checks[own].astype("<u8").tobytes() if checks is not None else None


def repeated(blobs: DataFrame) -> DataFrame:
    """(sender, owner, bits array<long>): which of a sender's hashes came more than once, with the same check if they have one; lists without any are left out."""

    def answer(group: pa.Table) -> pa.Table:
        coded, twice, checks = (group.column(c).to_pylist() for c in ("coded", "twice", "check"))
        lists = [rice_decode(c) for c in coded]
        own = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(x), bitorder="little") for t, x in zip(twice, lists, strict=True)])
        if checks[0] is None:
            _, back, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        else:
            _, _, back, n = grouped(np.concatenate(lists), np.frombuffer(b"".join(checks), "<u8"))
        more = ((n > 1)[back] | (own > 0)).astype(np.uint8)
        out, at = [], 0
        for x in lists:
            bits = more[at : at + len(x)]
            at += len(x)
            out.append(np.packbits(np.pad(bits, (0, -len(x) % 64)), bitorder="little").view("<i8") if bits.any() else None)
        keep = pa.array([i for i, x in enumerate(out) if x is not None], pa.int64())
        return pa.table({"sender": group.column("sender").take(keep), "owner": group.column("owner").take(keep), "bits": pa.array([x for x in out if x is not None], pa.list_(pa.int64()))})

    return blobs.select("sender", "owner", "coded", "twice", "check").groupBy("owner").applyInArrow(answer, "sender long, owner long, bits array<long>")


def owners_for(df: DataFrame, hashes: int, each: int = 4_000_000) -> int:
    """As many owners as shuffle partitions, more once an owner would get over `each` hashes."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hashes // each))


def answers(bits: DataFrame) -> DataFrame:
    """One row per sender: its owners' bitmaps."""
    return bits.groupBy("sender").agg(F.collect_list(F.struct("owner", "bits")).alias("answers"))


def marked(keys: np.ndarray, starts: np.ndarray, answers: list[dict] | None) -> np.ndarray:
    """The sender's own view: for each of its sorted distinct keys, whether it is repeated."""
    cut = np.append(np.searchsorted(keys, starts), len(keys))
    out = np.zeros(len(keys), bool)
    for a in answers or []:
        lo, hi = cut[a["owner"]], cut[a["owner"] + 1]
        out[lo:hi] = np.unpackbits(np.array(a["bits"], "<i8").view(np.uint8), count=hi - lo, bitorder="little").astype(bool)
    return out
