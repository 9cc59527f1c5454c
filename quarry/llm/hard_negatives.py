"""Hard negatives by exact integer products of anchor and candidate tiles.

Components become integers, floor(scale * x); a row's score for an anchor is
their inner product.  Rows are dealt to *tiles* and anchors to *blocks* of a
bounded number of values; every (tile, block) cell is one matrix product, done
by Strassen's recursion on int64 matrices that are padded with zeros to even
sizes.  Additions and products of 64-bit integers are exact modulo 2**64, so a
score that fits 64 bits is right whatever its intermediate sums did; a cell
whose scores might not fit is multiplied with Python integers instead.

Two passes over the cells:

1. a heap of the best ``positives`` rows of the anchor's label per cell; the
   heaps of all cells merge to the anchor's positives;
2. with those scores known, a heap per (anchor, positive) of the best
   ``negatives`` rows of another label whose score lies in the positive's
   window; again the cells' heaps merge.

A heap holds a fixed number of rows, so merging moves that many rows per cell
and anchor; Spark's ranking keeps the best of each partition before it
shuffles.  A cell holds one tile and one block whatever the labels: a label or
an id that holds a third of all rows is spread over all tiles.

Edge cases: rows without id, label or vector, and those with a null or
non-finite component, take no part; an empty vector scores 0; only vectors of
equal length are compared; a row is never its own positive, but an equal row
is; repeated rows count one each, and a repeated anchor row is mined for
itself; scores beyond 64 bits raise an error; a negative positive score has an
empty window (low < high); an empty table gives no row; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize

TILE_VALUES = 1 << 19      # components in a candidate tile
BLOCK_VALUES = 1 << 16     # components in an anchor block
BAND = 256                 # anchors multiplied at once: bounds the score matrix
LEAF = 32                  # Strassen stops at this side length

_HEAP1 = "a_uid bigint, anchor_id bigint, p_uid bigint, positive_id bigint, positive_score bigint"
_HEAP2 = _HEAP1 + ", n_uid bigint, negative_id bigint, negative_score bigint"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product a @ b of integer matrices."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    h, i, j = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    if (2 * h, 2 * i, 2 * j) != (m, k, n):
        a = np.pad(a, ((0, 2 * h - m), (0, 2 * i - k)))
        b = np.pad(b, ((0, 2 * i - k), (0, 2 * j - n)))
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    out = np.empty((2 * h, 2 * j), a.dtype)
    c11, c12, c21, c22 = out[:h, :j], out[:h, j:], out[h:, :j], out[h:, j:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    c11[...] = p
    c22[...] = p
    p = strassen(a21 + a22, b11, leaf)
    c21[...] = p
    c22 -= p
    p = strassen(a11, b12 - b22, leaf)
    c12[...] = p
    c22 += p
    p = strassen(a22, b21 - b11, leaf)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22, leaf)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    return out[:m, :n]


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as int64 or, where that is too small, as integers."""
    q = np.floor(x * float(scale))
    if not x.size or np.abs(q).max() < 2.0 ** 62:
        return q.astype(np.int64)
    flat = [int(v) * scale if abs(v) >= 2.0 ** 53 else math.floor(v * scale) for v in x.ravel().tolist()]
    return np.array(flat, object).reshape(x.shape)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with the rows of b."""
    if not (a.size and b.size):
        return np.zeros((len(a), len(b)), np.int64)
    bound = a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max())
    if bound >= 1 << 63 or object in (a.dtype, b.dtype):
        a, b = a.astype(object), b.astype(object)
    return strassen(a, np.ascontiguousarray(b.T))


class Side:
    """Rows of one cell side, by vector length and then by (id, row)."""

    def __init__(self, t: pa.Table, scale: int):
        self.ids, self.uid, self.label = (t[c].to_numpy() for c in ("vec_id", "uid", "label"))
        self.order = np.lexsort((self.uid, self.ids))
        chunks = [np.asarray(c.flatten()) for c in t["v"].chunks]
        self.flat = np.concatenate([np.zeros(0), *chunks])
        self.dim = t["dim"].to_numpy().astype(np.int64)
        self.ends = np.cumsum(self.dim)
        self.scale = scale

    def rows(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of vectors of length d, in (id, row) order, and their integers."""
        i = self.order[self.dim[self.order] == d]
        return i, quantised(self.flat[(self.ends[i] - d)[:, None] + np.arange(d)], self.scale)


def _long(values: list) -> pa.Array:
    return pa.array([int(v) for v in values], pa.int64())


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([_long(c) for c in cols], names=names)


def _bands(cand: Side, anch: Side):
    """(anchor row, candidate rows, their scores) of a cell, BAND anchors per product."""
    for d in np.unique(anch.dim).tolist():
        ci, cq = cand.rows(d)
        ai, aq = anch.rows(d)
        if not len(ci):
            continue
        for k in range(0, len(ai), BAND):
            scores = product(aq[k:k + BAND], cq)
            for r, a in enumerate(ai[k:k + BAND].tolist()):
                yield a, ci, scores[r]


def best_positives(cand: Side, anch: Side, keep: int) -> list[tuple]:
    out = []
    for a, ci, s in _bands(cand, anch):
        same = np.flatnonzero((cand.label[ci] == anch.label[a]) & (cand.uid[ci] != anch.uid[a]))
        top = same[np.argsort(~s[same], kind="stable")[:keep]]
        out += [(anch.uid[a], anch.ids[a], cand.uid[ci[j]], cand.ids[ci[j]], s[j]) for j in top.tolist()]
    return out


def best_negatives(cand: Side, anch: Side, wanted: list[list[dict]], keep: int, low: int, high: int) -> list[tuple]:
    out = []
    for a, ci, s in _bands(cand, anch):
        other = np.flatnonzero(cand.label[ci] != anch.label[a])
        down = ~s[other]
        order = np.argsort(down, kind="stable")
        down = down[order]
        for p in wanted[a]:
            score = p["positive_score"]
            least, most = -((-low * score) // 100), (high * score) // 100
            i = int(np.searchsorted(down, ~most, "left"))
            j = min(i + keep, int(np.searchsorted(down, ~least, "right")))
            out += [(anch.uid[a], anch.ids[a], p["p_uid"], p["positive_id"], score,
                     cand.uid[ci[c]], cand.ids[ci[c]], s[c]) for c in other[order[i:j]].tolist()]
    return out


def usable(vectors: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where("vec_id is not null and label is not null and v is not null").where(~F.coalesce(bad, F.lit(False)))


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 10,
         low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id",
         vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``vec_id``; ``label`` an expression on the
    table's columns (default: its ``label``).  A negative n of a positive p has
    ``low * p <= 100 * n <= high * p``."""
    label = F.col("label") if label is None else label
    rows = materialize(usable(vectors, id_col, vec_col, label).withColumn("uid", F.monotonically_increasing_id())
                       .withColumn("dim", F.size("v")), "vectors")
    anchors = rows.where(is_anchor).select(*[F.col(c).alias(c) for c in rows.columns])  # own columns, for the cogroups
    n, asked, width = rows.agg(F.count(F.lit(1)), F.count(F.when(is_anchor, 1)), F.avg("dim")).first()
    width = max(1.0, width or 0.0)
    tiles, blocks = (max(1, math.ceil(k * width / size)) for k, size in ((n, TILE_VALUES), (asked, BLOCK_VALUES)))
    key = ["tile", "block"]
    tile, block = (F.pmod(F.xxhash64("uid", F.lit(s)), F.lit(m)).cast("int") for s, m in ((0, tiles), (1, blocks)))

    def every(m: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    cands = rows.withColumn("tile", tile).withColumn("block", every(blocks))
    asks = anchors.withColumn("block", block)

    def positive(c: pa.Table, a: pa.Table) -> pa.Table:
        found = best_positives(Side(c, scale), Side(a, scale), positives) if c.num_rows and a.num_rows else []
        return _table(found, _HEAP1)

    def negative(c: pa.Table, a: pa.Table) -> pa.Table:
        found = []
        if c.num_rows and a.num_rows:
            found = best_negatives(Side(c, scale), Side(a, scale), a["wanted"].to_pylist(), negatives, low, high)
        return _table(found, _HEAP2)

    def best(df: DataFrame, by: list[str], score: str, ident: str, uid: str, keep: int, rank: str) -> DataFrame:
        # merges the cells' heaps; Spark ranks within each partition first
        w = Window.partitionBy(*by).orderBy(F.desc(score), ident, uid)
        return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= keep)

    heaps = cands.groupBy(*key).cogroup(asks.withColumn("tile", every(tiles)).groupBy(*key)).applyInArrow(positive, _HEAP1)
    chosen = best(heaps, ["a_uid"], "positive_score", "positive_id", "p_uid", positives, "_r")
    wanted = chosen.groupBy(F.col("a_uid").alias("uid")).agg(
        F.collect_list(F.struct("p_uid", "positive_id", "positive_score")).alias("wanted"))  # at most ``positives``
    asks2 = asks.join(wanted, "uid").withColumn("tile", every(tiles))
    heaps = cands.groupBy(*key).cogroup(asks2.groupBy(*key)).applyInArrow(negative, _HEAP2)
    return best(heaps, ["a_uid", "p_uid"], "negative_score", "negative_id", "n_uid", negatives, "rank").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
