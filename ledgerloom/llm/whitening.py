"""Embedding whitening on the principal components of an exact integer covariance.

Entries become integers, tasks sum their scatter exactly, and one table of d x d sums comes to the driver. Its
characteristic polynomial, the roots and the components follow from `exact_spectrum`; the primes, then the
components, are dealt out as tasks of their own. A second pass projects every vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage
from ledgerloom.llm.exact_spectrum import largest_roots, null_vectors, primes_for, remainder, residues

#: Fixed values of the integer form: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024.0, 100_000
#: Entries are held within this size, so that sums of products fit in three limbs of 40 bits.
LARGEST = 1 << 52
LIMB = 40
#: Rows whose products, of entries below 2^21, sum exactly in doubles.
BLOCK = 1024
RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(SCALE * c)) of the usable vectors of a batch, for each dimension by itself: none null, none with null or non-finite entries, none empty."""
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(pc.list_flatten(vectors), pa.float64()).to_numpy(zero_copy_only=False)  # a null entry becomes nan
    row = np.repeat(np.arange(len(size)), size)
    bad = np.bincount(row[~np.isfinite(flat)], minlength=len(size)) > 0
    first = np.cumsum(size) - size
    for d in np.unique(size[~bad & (size > 0)]):
        rows = np.flatnonzero((size == d) & ~bad)
        c = np.clip(flat[first[rows][:, None] + np.arange(d)] * SCALE, -LARGEST, LARGEST)
        yield rows, np.floor(c).astype(np.int64)


def scatter(x: np.ndarray) -> np.ndarray:
    """x^T x, exactly."""
    d = x.shape[1]
    if np.abs(x).max(initial=0) >= 1 << 21:
        big = x.astype(object)
        return big.T.dot(big)
    total = np.zeros((d, d), object)
    for hi in range(0, len(x), BLOCK * 1024):
        part = np.zeros((d, d), np.int64)
        for lo in range(hi, min(len(x), hi + BLOCK * 1024), BLOCK):
            f = x[lo : lo + BLOCK].astype(np.float64)
            part += (f.T @ f).astype(np.int64)
        total = total + part
    return total


def sums(vectors: DataFrame, vector: str) -> tuple[int, int, list[int], list[list[int]]]:
    """(dimensions, n, S, products): of the dimension that most usable vectors have (of equals the largest), in entries less SHIFT."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for rows, x in integers(b.column(0)):
                d = x.shape[1]
                now = held.setdefault(d, [0, np.zeros(d, object), np.zeros((d, d), object)])
                now[0] += len(rows)
                now[1] = now[1] + x.astype(object).sum(0) if np.abs(x).max() >= 1 << 40 else now[1] + x.sum(0)
                now[2] = now[2] + scatter(x)
        for d, (n, s, xx) in held.items():
            i, j = np.triu_indices(d)
            values = [n, *s, *xx[i, j]]
            at = [-2] + [-1] * d + list(i), [0, *range(d), *j]
            limbs = [[int(v) & ((1 << LIMB) - 1) for v in values], [(int(v) >> LIMB) & ((1 << LIMB) - 1) for v in values], [int(v) >> (2 * LIMB) for v in values]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([d] * len(values), *at, *limbs)], names=["d", "i", "j", "low", "mid", "high"])

    parts = vectors.select(vector).mapInArrow(add, "d long, i long, j long, low long, mid long, high long")
    total = stage(parts.groupBy("d", "i", "j").agg(*(F.sum(c).alias(c) for c in ("low", "mid", "high"))), "sums")
    whole = lambda r: r.low + (r.mid << LIMB) + (r.high << (2 * LIMB))
    chosen = total.filter("i = -2").orderBy(F.desc("low"), F.desc("d")).first()
    if chosen is None:
        return 0, 0, [], []
    d, n, s = chosen.d, whole(chosen), [0] * chosen.d
    xx = [[0] * d for _ in range(d)]
    for r in total.filter((F.col("d") == d) & (F.col("i") >= -1)).collect():
        if r.i < 0:
            s[r.j] = whole(r)
        else:
            xx[r.i][r.j] = xx[r.j][r.i] = whole(r)
    return d, n, s, xx


def spectrum(df: DataFrame, matrix: list[list[int]], most: int) -> list[tuple[int, int, np.ndarray]]:
    """(numerator, bits, unit vector) of the largest eigenvalues but zero, falling."""
    spark, d = df.sparkSession, len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    if not trace:
        return []
    mods = primes_for(trace, d)
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def modular(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_pylist()
            for lo in range(0, len(own), 32):
                yield pa.RecordBatch.from_pydict({"p": pa.array(own[lo : lo + 32], pa.int64()), "c": pa.array(residues(matrix, own[lo : lo + 32]).tolist(), pa.list_(pa.int64()))})

    dealt = spark.createDataFrame([(p,) for p in mods], "p long").repartition(min(slots, -(-len(mods) // 8)))
    poly = remainder((r.p, r.c) for r in dealt.mapInArrow(modular, "p long, c array<long>").sort("p").collect())
    roots, left = [], most
    for k, (at, bits, times) in enumerate(largest_roots(poly, trace, most)):
        roots.append((k, str(at), bits, min(times, left)))
        left -= times

    def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                for v in null_vectors(matrix, int(r["at"]), r["bits"], r["times"]):
                    yield pa.RecordBatch.from_pydict({"k": pa.array([r["k"]], pa.int64()), "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    shared = spark.createDataFrame(roots, "k long, at string, bits long, times long").repartition(min(slots, len(roots)))
    found = shared.mapInArrow(inverted, "k long, v array<double>").collect()
    return [(int(roots[r.k][1]), roots[r.k][2], np.array(r.v)) for r in sorted(found, key=lambda r: r.k)]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", most: int = 8) -> DataFrame:
    """A row per usable vector and component: id, component from 1 by falling eigenvalue, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are left out, as are empty ones and, where dimensions
    differ, all but those of the most frequent one (of equals the largest). Repeated rows count as often as they occur,
    null ids as they are; other columns are not read. Components of eigenvalue zero do not exist, so equal vectors, one
    vector or an empty table give no rows; a repeated eigenvalue has some orthonormal basis of its space. Entries are
    held within 2^52 / 1024. `deviation`, the sum of (n x - S)^2, is null where it does not fit in 64 bits. Only sums by
    dimension, never vectors, reach the driver.
    """
    spark = vectors.sparkSession
    kind = vectors.select(id_col).schema[0].dataType.simpleString()
    d, n, s, xx = sums(vectors, vector)
    matrix = [[n * xx[i][j] - s[i] * s[j] for j in range(d)] for i in range(d)]  # n^2 times the covariance
    found = spectrum(vectors, matrix, most) if d else []
    if not found:
        return spark.createDataFrame([], f"`{id_col}` {kind}, {RESULT}")
    trace = sum(matrix[i][i] for i in range(d))
    size = [(at << 64 >> bits) / 2.0**64 for at, bits, _ in found]
    onto = np.array([v for *_, v in found]).T / np.sqrt(size)
    explained = [at / (trace << bits) for at, bits, _ in found]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in integers(b.column(1)):
                if x.shape[1] != d:
                    continue
                top = int(np.abs(x).max()) * n + max(map(abs, s))
                if top * top * d < 1 << 63:
                    y = x * n - np.array(s, np.int64)
                    far = pa.array((y * y).sum(1))
                else:
                    y = x.astype(object) * n - np.array(s, object)
                    far = pa.array([t if t < 1 << 63 else None for t in (int(r.dot(r)) for r in y)], pa.int64())
                z = y.astype(np.float64) @ onto
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), far, pa.array(z.tolist(), pa.list_(pa.float64()))], names=[id_col, "deviation", "z"])

    out = stage(vectors.select(id_col, vector).mapInArrow(project, f"`{id_col}` {kind}, deviation long, z array<double>"), "whitened")
    k = len(found)
    z = [F.get("z", F.lit(i)) for i in range(k)]
    mean = out.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(z))).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = out.agg(*(F.avg((z[i] - mean[i]) * (z[j] - mean[j])).alias(f"c{i}_{j}") for i, j in pairs)).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs, strict=True))
    each = out.select(id_col, "deviation", F.posexplode("z").alias("at", "whitened"))
    shares = F.array(*map(F.lit, explained))
    return each.select(id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
