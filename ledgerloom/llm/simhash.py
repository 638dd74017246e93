"""Near-duplicate groups by SimHash, with deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that, of two fingerprints within the allowed distance, one
segment differs by at most one bit. Each distinct fingerprint is filed under every one-wildcard variant of
every segment; fingerprints that meet under a key are compared in full. In a key's list a search over what
is not yet reached gives a spanning forest of its links, so a dense list yields as many links as it has
members, not all pairs. Components of the links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import connected_components, join_counted, stage, texts_of

BITS = 64
SMALL, LONG = 24, 2048


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of a UTF-8 text: ASCII lower case, words between ASCII white space, repeated shingles counted."""
    words = text.lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(at[: len(words) - k + 1].tolist(), (at[k:] - 1).tolist(), strict=True)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[lo : lo + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the distance // 2 + 1 segments: one of them differs by at most one bit."""
    n = distance // 2 + 1
    cut = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def variants(prints: np.ndarray, distance: int) -> np.ndarray:
    """Keys (prints, 64): for each bit, its segment with that bit blanked, marked with the bit's place."""
    out = np.empty((len(prints), BITS), np.int64)
    for lo, width in segments(distance):
        part = (prints >> np.uint64(lo)) & np.uint64((1 << width) - 1)
        for i in range(width):
            out[:, lo + i] = ((part & ~np.uint64(1 << i)).astype(np.int64) << 6) | (lo + i) if width < 58 else np.bitwise_xor(part & ~np.uint64(1 << i), np.uint64((lo + i) * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.int64)
    return out


def forest(prints: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join all of a list's members that are within reach of each other."""
    left, right = [], []
    rest = prints
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            p = queue.pop()
            near = np.bitwise_count(rest ^ p) <= distance
            if near.any():
                hit, rest = rest[near], rest[~near]
                left.append(np.full(len(hit), p))
                right.append(hit)
                queue.extend(hit)
    return left, right


def links(keys: np.ndarray, prints: np.ndarray, distance: int, split: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Links among sorted complete lists: short ones compared at all offsets at once, long ones searched.

    Very long ones are first cut by the distance + 1 segments of which two fingerprints within reach share one
    unchanged, so that work on a list does not grow with the square of its length.
    """
    left, right = [prints[:0]], [prints[:0]]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, len(keys)))
    for h, n in zip(heads[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        own = prints[h : h + n]
        if n > LONG and split:
            for i in range(distance + 1):
                lo, hi = BITS * i // (distance + 1), BITS * (i + 1) // (distance + 1)
                part = (own >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
                order = np.argsort(part, kind="stable")
                a, b = links(part[order], own[order], distance, False)
                left.append(a)
                right.append(b)
            continue
        a, b = forest(own, distance)
        left += a
        right += b
    short = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    keys, prints = keys[short], prints[short]
    for d in range(1, SMALL):
        if d >= len(keys):
            break
        hit = np.flatnonzero(keys[d:] == keys[:-d])
        if not len(hit):
            break
        hit = hit[np.bitwise_count(prints[hit] ^ prints[hit + d]) <= distance]
        left.append(prints[hit])
        right.append(prints[hit + d])
    return np.concatenate(left), np.concatenate(right)


def simhash_groups(docs: DataFrame, distance: int = 4, shingle: int = 4, row: str | None = None) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hex digits), component_id, group (a fingerprint that names it) and `row`, if named.

    Null, empty and blank texts have fingerprint zero and are linked like any other; component_id is the
    smallest doc_id reachable (null ids never name a group; a group of null ids alone has null). Exact
    copies and repeated rows meet in one fingerprint before any search. An empty table gives no rows; other
    columns are not read. A key's list is in one task, 8 bytes a member; rows of one fingerprint, and fingerprints of one
    component, stay where they are, however many.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = np.array([fingerprint(t, shingle) for t in texts_of(b.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(marks, pa.int64())], names=["doc_id", "row", "mark"])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = b.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(marks), 4096):
                own = marks[lo : lo + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(variants(own, distance).ravel()), pa.array(np.repeat(own, BITS).view(np.int64))], names=["key", "mark"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints, out, n = np.zeros(0, np.int64), np.zeros(0, np.uint64), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            pairs = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)
            if pairs.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        for b in batches:
            keys, prints = np.append(keys, b.column(0).to_numpy()), np.append(prints, b.column(1).to_numpy().view(np.uint64))
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if whole:
                out.append(np.sort(np.stack([x.view(np.int64) for x in links(keys[:whole], prints[:whole], distance)]), axis=0))
                keys, prints, n = keys[whole:], prints[whole:], n + out[-1].shape[1]
            if n > 500_000:
                yield from flush()
                out, n = [], 0
        out.append(np.sort(np.stack([x.view(np.int64) for x in links(keys, prints, distance)]), axis=0))
        yield from flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(row).cast("long") if row else F.lit(None).cast("long")).alias("row"), F.col("text").cast("string").alias("text"))
    marked = stage(rows.mapInArrow(mark, "doc_id long, row long, mark long"), "marks")
    total = marked.count()
    prints = stage(marked.groupBy("mark").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "prints")
    filed = prints.select("mark").mapInArrow(file, "key long, mark long").repartition("key").sortWithinPartitions("key")
    groups = stage(connected_components(filed.mapInArrow(link, "a long, b long")).select(F.col("node").alias("mark"), "component"), "components")
    # only linked fingerprints, fewer than all, meet by component; however many one has
    linked = groups.join(prints.select("mark", "first"), "mark")
    smallest = stage(linked.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("members")), "smallest")
    named = join_counted(linked.select("mark", "component"), smallest, "component", "members", total)
    ids = prints.join(named, "mark", "left").select("mark", "n", F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("component", "mark").alias("group"))
    out = join_counted(marked, stage(ids, "ids"), "mark", "n", total).select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id", "group", "row")
    return out.withColumnRenamed("row", row) if row else out.drop("row")
