"""Nearest neighbours by collision counting over single-projection arrays.

Vectors are dealt to shards of bounded size.  A shard keeps, for each of
``PROJECTIONS`` random lines, its vectors' projections in sorted order.  For a
query, windows centred on its own projections grow in steps (virtual rehashing:
a window of radius r * c stands for a hash bucket c times as wide; nothing is
rebuilt).  A vector that falls into the windows of at least ``THRESHOLD`` of
the lines is verified with its exact distance in double precision.  A shard
stops for a query when its k-th verified distance is within the radius at which
such a vector would almost surely have collided, or when all its vectors have
been verified, so fewer than k finds never come from stopping early.  The k
best of every shard are merged by distance, ties to the smaller id.

Queries go to all shards in blocks of at most ``QUERIES`` rows, one pass each,
so what is broadcast has a fixed bound.

Vectors that are null, zero, or hold null or non-finite components take no
part, and neither do those with a null id; of vectors with the commonest length
and others only equal lengths are compared; repeated rows of one id count as
one candidate row each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize

PROJECTIONS = 24
THRESHOLD = 0.5          # share of the projections that must collide
GROWTH = 1.3
QUERIES = 20_000
SHARD_ROWS = 16_384
SEED = 7


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, in double precision."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    big = F.lit(float("inf"))
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == big)) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and v is not null").where(fine)


def lines(dim: int, m: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    """Random directions (dim, m), the same in every task."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, m))


class Shard:
    """Sorted projection arrays over the vectors of one shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.dirs = lines(x.shape[1])
        p = x @ self.dirs
        self.order = np.argsort(p, axis=0, kind="stable")
        self.sorted = np.take_along_axis(p, self.order, axis=0)
        # a first radius that catches a few vectors on a line
        gap = np.median(self.sorted[-1] - self.sorted[0]) / max(1, len(ids))
        self.start = max(float(gap) * 64, 1e-9)

    def search(self, qid: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the best k vectors other than ``qid``."""
        n, m = len(self.ids), self.dirs.shape[1]
        need = max(1, int(np.ceil(THRESHOLD * m)))
        at = q @ self.dirs
        lo = np.array([np.searchsorted(self.sorted[:, j], at[j]) for j in range(m)])
        hi = lo.copy()
        count = np.zeros(n, np.int32)
        done = np.zeros(n, bool)
        dist = np.full(n, np.inf)
        done[self.ids == qid] = True
        verified = 0
        kth = np.inf
        radius = self.start
        while True:
            new = []
            for j in range(m):
                col, order = self.sorted[:, j], self.order[:, j]
                a, b = np.searchsorted(col, at[j] - radius, "left"), np.searchsorted(col, at[j] + radius, "right")
                a, b = min(a, lo[j]), max(b, hi[j])
                new += [order[a:lo[j]], order[hi[j]:b]]
                lo[j], hi[j] = a, b
            count += np.bincount(np.concatenate(new), minlength=n).astype(np.int32)
            whole = bool((lo == 0).all() and (hi == n).all())
            cand = np.flatnonzero(((count >= need) | whole) & ~done)
            if len(cand):
                done[cand] = True
                d = self.x[cand] - q
                dist[cand] = np.sqrt((d * d).sum(axis=1))
                verified += len(cand)
                if verified >= k:
                    kth = np.partition(dist, k - 1)[k - 1]
            # a vector at distance s projects within s of the query on 68 of
            # 100 lines: once the radius passes the k-th distance, nearer
            # vectors have collided on far more than half of the lines
            if whole or radius >= kth:
                break
            radius *= GROWTH
        got = np.flatnonzero(np.isfinite(dist))
        best = got[np.lexsort((self.ids[got], dist[got]))[:k]]
        return self.ids[best], dist[best]


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every query among all
    other usable vectors.  ``is_query`` is a condition on ``vec_id``."""
    spark = vectors.sparkSession
    v = materialize(usable(vectors, id_col, vec_col).withColumn("dim", F.size("v")), "vectors")
    queries = v.where(is_query)
    rows, asked = v.count(), queries.count()
    shards = max(1, -(-rows // SHARD_ROWS))
    blocks = max(1, -(-asked // QUERIES))
    deal = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard")
    best = None
    for block in range(blocks):
        q = queries.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)) == block).select("vec_id", "dim", "v")
        t = q.toArrow()  # at most about QUERIES rows
        by_dim: dict[int, tuple] = {}
        ids, dims = t["vec_id"].to_numpy(), t["dim"].to_numpy()
        flat = np.concatenate([np.zeros(0), *(np.asarray(c.flatten()) for c in t["v"].chunks)])
        ends = np.cumsum(dims.astype(np.int64))
        for d in np.unique(dims):
            i = np.flatnonzero(dims == d)
            by_dim[int(d)] = ids[i], flat[(ends[i] - d)[:, None] + np.arange(d)]
        shared = spark.sparkContext.broadcast(by_dim)

        def run(t: pa.Table) -> pa.Table:
            ids, dims = t["vec_id"].to_numpy(), t["dim"].to_numpy()
            order = np.argsort(ids, kind="stable")
            flat = np.concatenate([np.asarray(c.flatten()) for c in t["v"].chunks])
            ends = np.cumsum(dims.astype(np.int64))
            out: list[tuple] = []
            for d, (qids, qs) in shared.value.items():
                i = order[dims[order] == d]
                if not len(i):
                    continue
                shard = Shard(ids[i], flat[(ends[i] - d)[:, None] + np.arange(d)])
                for qid, q in zip(qids, qs):
                    got, dist = shard.search(qid, q, k)
                    out.append((np.full(len(got), qid), got, dist))
            cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]
            return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()),
                             "score": pa.array(cols[2], pa.float64())})

        part = v.select("vec_id", "dim", "v", deal).groupBy("shard").applyInArrow(
            run, "query_id bigint, vec_id bigint, score double")
        best = part if best is None else best.union(part)
    # at most k rows of each shard for a query
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
