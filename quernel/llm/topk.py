"""Exact top-k by inner product from an impact-ordered index, score at a time.

Vectors are dealt into blocks. A block's index has posting lists: for each dimension the rows and their values, in segments of
equal quantised impact (the size of the value in LEVELS steps), the largest first. A query takes all segments of all dimensions
in descending order of the impact they can have on its score, its own weight times the segment's level, a stage of them at
a time, and adds their products to the rows' accumulators. After each stage the rows that lead are scored exactly, so the k-th
best of them bounds the result from below; what is left of a row is bounded from above, row by row, by half the squares of what
is left of query and row (the inequality of means). A row stays possible while its upper bound reaches the k-th best score. Each
query stops on its own, once that proof leaves few possible rows, or at the end; possible rows are then scored exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Steps of quantised impact; the factor from one stage's least impact to the next one's; the share of possible rows at which
#: exact scores cost less than further postings.
LEVELS, STAGE, FEW = 255, 0.5, 0.3
#: Components below this size are whole numbers whose sums of products are exact in double, up to MOST_DIMENSIONS of them.
WIDE, MOST_DIMENSIONS = 1 << 20, 1 << 12


class Index:
    """Posting segments of a block of integer rows."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.rows, self.ids = rows.astype(np.float64), ids
        n, dims = rows.shape
        size = np.abs(self.rows)
        self.unit = max(1.0, size.max(initial=0.0)) / LEVELS
        level = np.ceil(size / self.unit).astype(np.int64)
        order = np.argsort(-level, axis=0, kind="stable")
        self.members = np.ascontiguousarray(order.T)
        self.values = np.ascontiguousarray(np.take_along_axis(self.rows, order, axis=0).T)
        # Postings of a dimension at a level or above it: where segments end.
        counts = np.zeros((dims, LEVELS + 2), np.int64)
        for d in range(dims):
            counts[d, : LEVELS + 1] = np.bincount(level[:, d], minlength=LEVELS + 1)[: LEVELS + 1]
        self.ends = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
        self.norms = (self.rows**2).sum(axis=1)
        self.postings = 0

    def exact(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.rows[rows] @ query

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of the k best rows, those of the query's own id left out; ties go to the smaller id."""
        query = query.astype(np.float64)
        n, dims = self.rows.shape
        other = self.ids != own
        weight, take = np.abs(query), min(k, int(other.sum()))
        if not take:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, live = np.arange(dims), weight > 0
        # By the inequality of means, what is left of q and v adds at most half of what is left of (even q^2 + v^2 / even): with
        # the exact products of what is done, one accumulator holds the upper bound, and each posting takes off
        # half of the square of (root(even) q - v / root(even)).
        even = math.sqrt(max(float(self.norms.mean()), 1e-9) / max(float((query**2).sum()), 1e-9))
        above, root = (self.norms / even + even * float((query**2).sum())) / 2, math.sqrt(even)
        slack = 0.5 + 1e-9 * float(above.max())  # more than rounding can take away
        done = np.zeros(dims, np.int64)
        least = float(weight.max(initial=0.0)) * self.unit * LEVELS
        possible = other
        while live.any():
            least = least * STAGE if least > self.unit else 0.0
            # The first level whose segments may add more than `least`.
            cut = np.where(live, np.minimum(np.floor(least / (self.unit * np.where(live, weight, 1.0))) + 1, LEVELS + 1), LEVELS + 1).astype(np.int64)
            upto = np.maximum(done, self.ends[at, cut])
            dims_now = np.flatnonzero(upto > done)
            if len(dims_now):
                spans = [(d, done[d], upto[d]) for d in dims_now.tolist()]
                members = np.concatenate([self.members[d, a:b] for d, a, b in spans])
                values = np.concatenate([self.values[d, a:b] for d, a, b in spans])
                gap = values / root - np.repeat(query[dims_now] * root, (upto - done)[dims_now])
                above = above - np.bincount(members, gap * gap, n) / 2
                self.postings += len(members)
                done = upto
            if least and 4 * done.sum() < n:
                continue  # too little for a bound
            lead = np.argpartition(np.where(other, above, -np.inf), n - take)[n - take :] if take < n else np.arange(n)
            bar = self.exact(query, lead[other[lead]]).min()
            possible = other & (above + slack >= bar)
            if not least or possible.sum() <= max(4 * k, FEW * n):
                break
        rows = np.flatnonzero(possible)
        found = self.exact(query, rows).astype(np.int64)
        order = np.lexsort((self.ids[rows], -found))[:k]
        return rows[order], found[order]


def whole(x: float) -> int:
    """floor(256 x), whatever its size."""
    return math.floor(x * 256) if abs(x) < 1e300 else int(x) * 256


def best_wide(rows: list[list[int]], ids: np.ndarray, query: list[int], own: int, k: int) -> list[tuple[int, int]]:
    """Score and id of the k best rows by sums of any size; scores beyond a long are the largest or least long."""
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    scored = sorted((-clip(sum(a * b for a, b in zip(query, r, strict=False))), i) for r, i in zip(rows, ids.tolist(), strict=True) if i != own)
    return [(-s, i) for s, i in scored[:k]]


def of_width(flat: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Lists of the given sizes, one after another in flat, as rows of one width: cut, or filled with zeros."""
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out, place = np.zeros((len(sizes), width), flat.dtype), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    held = place < width
    out[np.repeat(np.arange(len(sizes)), sizes)[held], place[held]] = flat[held]
    return out


def search(vectors: DataFrame, k: int = 5, every: int = 50, block: int = 8_192, query_block: int = 8_192, key: str = "vec_id", vector: str = "embedding", same_length: bool = True) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each query (a row whose id is divisible by `every`).

    Null ids, null vectors and vectors with null or non-finite components take no part. Vectors are compared with those of
    their length, or, unless same_length, with all, by the products of the places that both have; without any the score is 0,
    as it is of two empty ones. Components of any finite size count in full; a score that no long
    holds is the largest or least long. Rows with a query's id are its own and never its result; repeated query rows are one
    query, rows that share a query's id and differ are a query each; repeated candidate rows are candidates each; ties go to
    the smaller id. Other columns are ignored. Empty tables give no rows.
    """
    numbers = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), numbers.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    narrow = F.forall("v", lambda x: F.abs(x) < WIDE / 256) & (F.size("v") <= MOST_DIMENSIONS)
    small = F.when(narrow, F.transform("v", lambda x: F.floor(x * 256).cast("int")))
    # Vectors of one block have one length, or else lengths below the same power of two.
    dim = F.size("v") if same_length else F.length(F.bin(F.size("v")))
    rows = rows.select("id", dim.alias("dim"), small.alias("v"), F.when(~narrow, F.col("v")).alias("wide"))
    queries = rows.where(F.col("id") % every == 0).dropDuplicates(["id", "v", "wide"])
    n_rows, n_queries = rows.count(), queries.count()
    blocks, groups = max(12, -(-n_rows // block)), max(1, -(-n_queries // query_block))
    # Every block of queries meets every block of rows: queries are all rows whose id fits, a stated set. Rows are dealt by
    # their place in the input, so that no id or vector fills a block. Numbers of blocks have one type on both sides: a cogroup
    # hashes them as they are, and an int doesn't meet an equal long.
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    part = lambda c, n: F.pmod(c, F.lit(n).cast("bigint"))
    left = rows.withColumn("vb", part(F.xxhash64(F.monotonically_increasing_id()), blocks)).withColumn("qb", upto(groups))
    right = queries.withColumn("twin", F.xxhash64("v", "wide")).withColumn("qb", part(F.xxhash64("id", "twin"), groups)).withColumn("vb", upto(blocks))
    if not same_length:
        dims = [r[0] for r in rows.select("dim").distinct().collect()]  # at most 32 numbers
        right = right.withColumn("dim", F.explode(F.array(*map(F.lit, dims)).cast("array<int>")))

    def parts(t: pa.Table, width: int | None) -> tuple[pa.Table, np.ndarray, pa.Table]:
        is_small = t.column("v").is_valid()
        a, b = t.filter(is_small), t.filter(t.column("wide").is_valid())
        flat = pa.chunked_array([c.flatten() for c in a.column("v").chunks], pa.int32()).to_numpy()
        sizes = pc.list_value_length(a.column("v")).to_numpy().astype(np.int64)
        return a, of_width(flat, sizes, int(sizes.max(initial=0)) if width is None else width), b

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "twin": [], "vec_id": [], "score": []}
        if not (a.num_rows and b.num_rows):
            return pa.table({n: pa.array([], pa.int64()) for n in out})

        def told(query: int, twin: int, ids: np.ndarray, scores: np.ndarray) -> None:
            for name, x in zip(out, (np.full(len(ids), query), np.full(len(ids), twin), ids, scores), strict=True):
                out[name].append(np.asarray(x, np.int64))

        v_small, v, v_wide = parts(a, None)
        q_small, q, q_wide = parts(b, v.shape[1])
        v_ids = v_small.column("id").to_numpy()
        for at in range(0, len(v), 2 * block):  # blocks dealt by hash vary a little
            index = Index(v[at : at + 2 * block], v_ids[at : at + 2 * block])
            for i, twin, x in zip(q_small.column("id").to_pylist(), q_small.column("twin").to_pylist(), q, strict=True):
                found, scores = index.best(x, i, k)
                told(i, twin, index.ids[found], scores)
        # Pairs with a vector of very large components, in whole numbers of any size.
        spelled = lambda t: [[whole(x) for x in r] for r in t.column("wide").to_pylist()]
        if v_wide.num_rows or q_wide.num_rows:
            wide_rows, wide_queries = spelled(v_wide), spelled(q_wide)
            every_row, every_id = [*v.tolist(), *wide_rows], np.concatenate([v_ids, v_wide.column("id").to_numpy()])
            for t, own, rows_, ids in ((q_small, q_small.column("v").to_pylist(), wide_rows, v_wide.column("id").to_numpy()), (q_wide, wide_queries, every_row, every_id)):
                for i, twin, x in zip(t.column("id").to_pylist(), t.column("twin").to_pylist(), own, strict=True):
                    best = best_wide(rows_, ids, x, i, k)
                    told(i, twin, np.array([j for _, j in best], np.int64), np.array([s for s, _ in best], np.int64))
        return pa.table({n: pa.array(np.concatenate(x) if x else [], pa.int64()) for n, x in out.items()})

    found = left.groupBy("dim", "vb", "qb").cogroup(right.groupBy("dim", "vb", "qb")).applyInArrow(run, "query_id bigint, twin bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
