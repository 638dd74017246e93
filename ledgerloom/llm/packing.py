"""Packing along a space-filling curve.

Each document's vector of hashed token ids is projected to three dimensions by fixed random directions; the three
coordinates give a Hilbert key. Documents are range-sorted by that key, so neighbours on the curve have like
content, and their ids form one stream which is cut every 1024 ids. Texts are encoded before the sort, so only
ids are shuffled; the ranges hold about as many ids each, by a sample of keys in which a document's chance grows
with its ids. A document's place in the stream is its place in its range plus the ids of all ranges before, from
a prefix sum over ranges; no sequence but the last is short. The last one's ids are dealt to sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import erf

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import mix, slices, stage
from ledgerloom.llm.encoding import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n, dims) below 2**bits: the transposed bits of each axis, interleaved."""
    x = points.astype(np.int64).copy()
    n, dims = x.shape
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        for d in range(dims):
            high = (x[:, d] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, d]) & (q - 1))
            x[:, 0] ^= np.where(high, q - 1, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[:, -1] & (1 << level), turn ^ ((1 << level) - 1), turn)
    x ^= turn[:, None]
    key = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[:, d] >> level) & 1)
    return key


def curve_keys(ids: np.ndarray, counts: np.ndarray, features: int = 512, dims: int = 3, bits: int = 10, seed: int = 11) -> np.ndarray:
    """Hilbert keys of documents, given their ids one after another: counts of hashed ids, damped, centred, normalised and projected."""
    hashed = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - (features - 1).bit_length())
    ends = np.cumsum(counts).tolist()
    v = np.log1p(np.array([np.bincount(hashed[e - n : e], minlength=features) for e, n in zip(ends, counts.tolist(), strict=True)], np.float32).reshape(-1, features))
    v -= v.mean(1, keepdims=True)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    z = v @ np.random.default_rng(seed).standard_normal((features, dims)).astype(np.float32)
    even = 0.5 * (1 + np.vectorize(erf, otypes=[float])(np.round(z, 3) / 2**0.5)) if len(z) else z
    return hilbert_key(np.minimum((even * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def pack_on_curve(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 1024, with_ids: bool = True, range_ids: int = 32_000_000) -> DataFrame:
    """A row per piece of a document: PIECES and, with_ids, ids (the piece, little-endian, of the vocabulary's width).

    Null text counts as empty (the end id alone), null doc_ids are kept, repeated rows are packed as often as
    they come, an empty table gives no rows, and only doc_id and text are read. Ties on the curve follow a hash of
    doc_id, so that copies of a text, which share a key, are dealt to several ranges as well. A range has about
    `range_ids` ids at most; what comes to the driver is its number of ids and about eight sampled keys each.
    """
    schema = "place long, doc_id long, doc_tokens long, ids binary"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seed = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for b in batches:
            column, doc = b.column("text").fill_null(""), b.column("doc_id")
            for lo, hi in slices([n + 500 for n in pc.binary_length(column).to_pylist()], 4_000_000):
                ids, n = enc.encode_column(column.slice(lo, hi - lo), end_id)
                own = doc.slice(lo, hi - lo)
                tie = mix(np.where(own.is_null(), seed + np.arange(hi - lo), own.fill_null(0)).astype(np.uint64)) >> np.uint64(31)
                seed += hi - lo
                place = curve_keys(ids, n) << 33 | tie.astype(np.int64)
                ends = np.append(0, np.cumsum(n * enc.dtype.itemsize)).astype(np.int32)
                coded = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(place), own, pa.array(n), coded], names=["place", "doc_id", "doc_tokens", "ids"])

    dtype = encoder(tokenizer).dtype
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stage(rows.mapInArrow(encoded, schema), "encoded")
    total = rows.agg(F.sum("doc_tokens")).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // range_ids))
    chance = F.col("doc_tokens") * (8.0 * ranges / max(1, total))
    drawn = rows.filter(F.pmod(F.xxhash64("place", "doc_id"), F.lit(1 << 30)) / float(1 << 30) < chance).select("place")
    drawn = np.sort(drawn.toPandas()["place"].to_numpy(np.int64))
    bounds = drawn[np.linspace(0, len(drawn), ranges + 1).astype(int)[1:-1]] if len(drawn) >= ranges else drawn

    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy(), "right").astype(np.int32))

    rows = rows.withColumn("part", range_of("place"))
    sums = dict(map(tuple, rows.groupBy("part").agg(F.sum("doc_tokens")).collect()))
    bases = np.append(0, np.cumsum([sums.get(i, 0) for i in range(len(bounds) + 1)]))
    # the last, short sequence: from where on, and the lengths (powers of two) it is dealt to
    tail = total - total % length
    ends = [tail]
    for k in reversed(range(length.bit_length())):
        if (total - tail) >> k & 1:
            ends.append(ends[-1] + (1 << k))
    edges = np.array(ends, np.int64)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = -1, 0
        for b in batches:
            parts, n = b.column("part").to_numpy(), b.column("doc_tokens").to_numpy()
            for lo, hi in [(x, y) for cut in [[0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]] for x, y in zip(cut, cut[1:], strict=False) if y > x]:
                if parts[lo] != part:
                    part, at = int(parts[lo]), int(bases[parts[lo]])
                own = b.slice(lo, hi - lo)
                starts = at + np.cumsum(n[lo:hi]) - n[lo:hi]
                first, at = at, at + int(n[lo:hi].sum())
                inner = np.append(np.arange(first // length + 1, -(-min(at, tail) // length)) * length, edges[(edges > first) & (edges < at)])
                cuts = np.union1d(starts, inner)
                doc = np.searchsorted(starts, cuts, "right") - 1
                size = np.diff(np.append(cuts, at))
                last = np.searchsorted(edges, cuts, "right") - 1
                sequence = np.where(cuts < tail, cuts // length, tail // length + last)
                offset = np.where(cuts < tail, cuts % length, cuts - edges[np.maximum(last, 0)])
                coded = own.column("ids")
                span = np.frombuffer(coded.buffers()[1], np.int32)[coded.offset : coded.offset + len(coded) + 1]
                raw = np.frombuffer(coded.buffers()[2], np.uint8)[span[0] : span[-1]].view(dtype)
                wide, begin = memoryview(raw.astype("<u4")).cast("B"), (cuts - first).tolist()
                cells = list(zip(begin, size.tolist(), strict=True))
                columns = [own.column("doc_id").take(pa.array(doc)), pa.array(cuts - starts[doc]), pa.array(size), pa.array([zlib.crc32(wide[4 * x : 4 * (x + k)]) for x, k in cells], pa.int64()), pa.array(n[lo:hi][doc]), pa.array(sequence), pa.array(offset)]
                if with_ids:
                    columns.append(pa.array([raw[x : x + k].tobytes() for x, k in cells], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*(x.split()[0] for x in PIECES.split(", ")), *["ids"] * with_ids])

    dealt = rows.select("part", "place", "doc_id", "doc_tokens", "ids").repartitionById(ranges, "part").sortWithinPartitions("part", "place", "doc_id")
    return dealt.mapInArrow(pieces, PIECES + ", ids binary" * with_ids)
