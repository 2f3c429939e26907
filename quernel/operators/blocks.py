"""The k most similar rows of a block of vectors for each query of a block, by matrix products and a proof.

Cosines are taken as single-precision products of unit vectors, whose error is bounded; every row whose product could still belong to
the k best is scored again in double, in the order that the expression of functions/vectors has, so both give the same bits.
"""

from __future__ import annotations

import numpy as np

#: Queries and rows of one product, and the rows after which the first bound is taken; each further bound comes after twice as many.
QUERIES, ROWS, FIRST = 512, 4_096, 2_048


def norms(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        c = x[:, d].astype(np.float64)
        total += c * c
    return np.sqrt(total)


def unit(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, np.float32)
    for at in range(0, len(x), ROWS):
        out[at : at + ROWS] = x[at : at + ROWS] / norm[at : at + ROWS, None]
    return out


def first_copies(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that have fewer than k equal ones before them: the others can't be among the k best."""
    bits, h = np.uint64 if x.dtype.itemsize == 8 else np.uint32, np.zeros(len(x), np.uint64)
    for d in range(x.shape[1]):
        h = (h ^ (x[:, d] + x.dtype.type(0)).view(bits).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(x), bool)
    twins = np.flatnonzero(h[order][1:] == h[order][:-1])
    for at in range(0, len(twins), ROWS):
        t = twins[at : at + ROWS]
        same[t + 1] = (x[order[t]] == x[order[t + 1]]).all(axis=1)
    place = np.arange(len(x))
    nth = place - np.maximum.accumulate(np.where(same, 0, place))
    return np.sort(order[nth < k])


def nearest(rows: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and of rows, and cosines, of the k best rows for each query; equal ones in the order of rows. All vectors
    are finite and have a norm."""
    places = first_copies(rows, k)
    rows = rows[places]
    n, dims = rows.shape
    of_rows, of_queries = norms(rows), norms(queries)
    u, v = unit(rows, of_rows), unit(queries, of_queries)
    # Roundings of both vectors and of a sum of products in any order, on both of two scores, and of the bound itself.
    slack = 2 * (dims + 8) * 2.0**-24 + 1e-6
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # Products and hits have one place each, as fresh pages cost more than the products.
    products, hits = np.empty(QUERIES * ROWS, np.float32), np.empty(QUERIES * ROWS, bool)
    for a in range(0, len(queries), QUERIES):
        q = v[a : a + QUERIES]
        m, bar = len(q), np.full(len(q), -np.inf, np.float32)
        whose, which, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        lo, stage = 0, max(FIRST, 4 * k)
        while lo < n:
            hi, found = min(n, stage), [(whose, which, score)]
            for t in range(lo, hi, ROWS):
                some = u[t : min(hi, t + ROWS)]
                s = np.matmul(q, some.T, out=products[: m * len(some)].reshape(m, len(some)))
                if t == 0 and k < s.shape[1]:
                    bar = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - np.float32(slack)
                np.greater_equal(s, bar[:, None], out=hits[: s.size].reshape(s.shape))
                hits[s.size : -(-s.size // 8) * 8] = False
                eight = np.flatnonzero(hits[: -(-s.size // 8) * 8].view(np.uint64))  # few hold a hit
                some = np.flatnonzero(hits.reshape(-1, 8)[eight])
                hit = 8 * eight[some // 8] + some % 8
                found.append((hit // s.shape[1], t + hit % s.shape[1], s.reshape(-1)[hit]))
            whose, which, score = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(4.0 * whose - score)
            whose, which, score = whose[order], which[order], score[order]
            start = np.searchsorted(whose, np.arange(m + 1))
            full = np.flatnonzero(np.diff(start) >= k)
            bar[full] = np.maximum(bar[full], score[start[full] + k - 1] - np.float32(slack))
            fine = score >= bar[whose]
            whose, which, score = whose[fine], which[fine], score[fine]
            lo, stage = hi, 2 * hi
        for at in range(0, len(whose), 1 << 16):  # exact products, a bounded number at a time
            i, j = whose[at : at + (1 << 16)], which[at : at + (1 << 16)]
            x, y, dot = rows[j], queries[a + i], np.zeros(len(i))
            for d in range(dims):
                dot += x[:, d].astype(np.float64) * y[:, d].astype(np.float64)
            out.append((a + i, j, dot / (of_rows[j] * of_queries[a + i])))
    whose, which, exact = (np.concatenate([o[c] for o in out]) if out else np.empty(0, np.int64 if c < 2 else np.float64) for c in range(3))
    order = np.lexsort((which, -exact, whose))
    at = whose[order]
    order = order[np.arange(len(at)) - np.searchsorted(at, at) < k]
    return whose[order], places[which[order]], exact[order]
