"""The spectrum of a positive semidefinite integer matrix, from its exact characteristic polynomial.

The polynomial comes modulo many primes by reduction to Hessenberg form and is put together by Chinese
remaindering; primes are independent, so a job deals them out. All its roots are real and none is negative, hence
the signs of its coefficients, once it is shifted to a point, tell exactly how many roots lie beyond that point
(Descartes' rule is sharp where all roots are real). Halving intervals by that count isolates the largest roots to
any precision, repeated ones together; vectors of the null space then come by inverse iteration in fixed point
with more digits than the roots have.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, isqrt

import numpy as np

#: Digits, in bits, that a root is known to against the largest; eigenvectors are worked out with as many again.
ROOT_BITS = 160


def primes(count: int) -> list[int]:
    """The largest primes below 2^30, whose products fit in 64 bits with room for a sum of eight."""
    small = [p for p in range(2, 1 << 15) if all(p % q for q in range(2, isqrt(p) + 1))]
    out, hi = [], 1 << 30
    while len(out) < count:
        lo = hi - (1 << 20)
        alive = np.ones(hi - lo, bool)
        for p in small:
            alive[-lo % p :: p] = False
        out += [int(x) + lo for x in np.flatnonzero(alive)[::-1]]
        hi = lo
    return out[:count]


def inverse(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """1 / a modulo p by Fermat, element by element."""
    out, base, e = np.ones_like(a), a % p, (p - 2).copy()
    while e.any():
        out = np.where(e & 1, out * base % p, out)
        base, e = base * base % p, e >> 1
    return out


def residues(matrix: list[list[int]], mods: list[int]) -> np.ndarray:
    """The coefficients of det(x - matrix), lowest first, modulo each of the primes: a row a prime.

    All primes go through the reduction together; each chooses its own pivots.
    """
    p, d = np.array(mods, np.int64), len(matrix)
    h = np.array([[[x % q for x in row] for row in matrix] for q in mods], np.int64).reshape(len(mods), d, d)
    every, p1 = np.arange(len(mods)), p[:, None]
    for k in range(d - 2):
        pivot = k + 1 + np.argmax(h[:, k + 1 :, k] != 0, axis=1)
        low = h[every, pivot].copy()
        h[every, pivot], h[:, k + 1] = h[:, k + 1].copy(), low
        low = h[every, :, pivot].copy()
        h[every, :, pivot], h[:, :, k + 1] = h[:, :, k + 1].copy(), low
        lead = h[:, k + 1, k]
        factors = h[:, k + 2 :, k] * np.where(lead != 0, inverse(lead, p), 0)[:, None] % p1
        h[:, k + 2 :] = (h[:, k + 2 :] - factors[:, :, None] * h[:, k + 1 : k + 2]) % p1[:, :, None]
        for i in range(k + 2, d):  # the same the other way round on columns, so that the matrix stays similar
            h[:, :, k + 1] = (h[:, :, k + 1] + factors[:, i - k - 2, None] * h[:, :, i]) % p1
    poly = np.zeros((d + 1, len(mods), d + 1), np.int64)
    poly[0, :, 0] = 1
    for k in range(d):
        poly[k + 1, :, 1:] = poly[k, :, :-1]
        poly[k + 1] = (poly[k + 1] - h[:, k, k, None] * poly[k]) % p1
        chain = np.ones(len(mods), np.int64)
        for i in range(k - 1, -1, -1):
            chain = chain * h[:, i + 1, i] % p
            poly[k + 1] = (poly[k + 1] - (chain * h[:, i, k] % p)[:, None] * poly[i]) % p1
    return poly[d]


def primes_for(trace: int, d: int) -> list[int]:
    """So many that their product exceeds twice any coefficient: none is above comb(d, k) (trace / d)^k, as no eigenvalue is negative."""
    top = max(comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    return primes(2 * top.bit_length() // 59 + 2)


def remainder(parts: Iterator[tuple[int, list[int]]]) -> list[int]:
    """The coefficients from their remainders modulo each prime, with signs; sums over halves keep the numbers short."""
    level = [(p, list(r)) for p, r in parts]
    while len(level) > 1:
        joined = []
        for (m, a), (n, b) in zip(level[::2], level[1::2], strict=False):
            u = pow(m, -1, n)
            joined.append((m * n, [x + m * ((y - x) * u % n) for x, y in zip(a, b, strict=True)]))
        level = joined + level[2 * len(joined) :]
    m, out = level[0]
    return [x - m if x > m // 2 else x for x in out]


def beyond(poly: list[int], at: int, bits: int) -> int:
    """How many roots exceed at / 2^bits, each as often as it occurs: changes of sign of the polynomial in x + at / 2^bits."""
    c, d = [x << (bits * (len(poly) - 1 - i)) for i, x in enumerate(poly)], len(poly) - 1
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def sign(poly: list[int], at: int, bits: int) -> int:
    total = 0
    for i, x in enumerate(reversed(poly)):
        total = total * at + (x << (bits * i))
    return (total > 0) - (total < 0)


def largest_roots(poly: list[int], trace: int, most: int) -> list[tuple[int, int, int]]:
    """(numerator, bits, multiplicity) of the largest roots but zero, falling, until `most` are counted; none is below the truth, nor above it by more than 2^-ROOT_BITS of trace.

    Roots that such an interval does not tell apart count as one repeated root.
    """
    fine = max(0, ROOT_BITS - trace.bit_length())
    top, out, found = (trace + 1) << fine, [], 0
    positive = beyond(poly, 0, 0)
    while found < min(most, positive):
        # the largest lo with more than `found` roots beyond it lies just below the next root
        lo, hi, n_lo, n_hi = 0, top, positive, found
        while hi - lo > 1 and not (n_lo - n_hi == 1):
            mid = (lo + hi) // 2
            n = beyond(poly, mid, fine)
            lo, hi, n_lo, n_hi = (mid, hi, n, n_hi) if n > found else (lo, mid, n_lo, n)
        if n_lo - n_hi == 1:  # a simple root by itself: signs are enough
            right = (-1) ** n_hi
            while hi - lo > 1:
                mid = (lo + hi) // 2
                s = sign(poly, mid, fine)
                lo, hi = (lo, mid) if s in (0, right) else (mid, hi)
        out.append((hi, fine, n_lo - n_hi))
        found += n_lo - n_hi
        top = lo
    return out


def null_vectors(matrix: list[list[int]], root: int, bits: int, many: int) -> list[np.ndarray]:
    """`many` orthonormal vectors that (matrix - root / 2^bits) takes nearest to zero, to double precision.

    Gauss elimination with row pivots and inverse iteration, in integers with 2 * ROOT_BITS binary places.
    """
    d, one = len(matrix), 2 * ROOT_BITS
    a = np.array([[x << one for x in row] for row in matrix], object).reshape(d, d)
    for i in range(d):
        a[i, i] -= root << (one - bits) if one >= bits else root >> (bits - one)
    order = list(range(d))
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i, k]))
        if best != k:
            a[[k, best]], order[k], order[best] = a[[best, k]], order[best], order[k]
        if not a[k, k]:
            a[k, k] = 1  # less than any number that is told apart from zero
        if k + 1 < d:
            a[k + 1 :, k] = (a[k + 1 :, k] << one) // a[k, k]
            a[k + 1 :, k + 1 :] -= (a[k + 1 :, k, None] * a[None, k, k + 1 :]) >> one
    found: list[np.ndarray] = []
    for turn in range(many):
        v = np.array([(1 << one) + ((i * (2 * turn + 1) * 0x9E3779B1 % 65_521) << (one - 16)) for i in range(d)], object)
        for _ in range(3):
            v = clear(v, found, one)
            v = v[order].copy()
            for i in range(1, d):
                v[i] -= int(a[i, :i].dot(v[:i])) >> one
            for i in range(d - 1, -1, -1):
                v[i] = ((int(v[i]) << one) - (int(a[i, i + 1 :].dot(v[i + 1 :])) if i + 1 < d else 0)) // a[i, i]
            v = unit(v, one)
        found.append(unit(clear(v, found, one), one))
    return [np.array([float(x) / 2.0**one if abs(x) < 1 << 1000 else 0.0 for x in v]) for v in found]


def clear(v: np.ndarray, against: list[np.ndarray], one: int) -> np.ndarray:
    for u in against:
        v = v - ((u * (int(u.dot(v)) >> one)) >> one)
    return v


def unit(v: np.ndarray, one: int) -> np.ndarray:
    length = isqrt(int(v.dot(v)))
    return np.array([(int(x) << one) // max(1, length) for x in v], object)
