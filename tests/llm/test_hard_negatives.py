"""Hard negatives against a brute-force version."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import hard_negatives as H

VECS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                     T.StructField("label", T.IntegerType()),
                     *[T.StructField(c, T.StringType()) for c in ("uid", "v", "tile", "block", "wanted", "rank")]])


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 40, 50), (64, 64, 64), (70, 129, 67), (5, 200, 90)])
def test_strassen_is_the_product(shape):
    m, k, n = shape
    rng = np.random.default_rng(3)
    a, b = rng.integers(-10 ** 6, 10 ** 6, (m, k)), rng.integers(-10 ** 6, 10 ** 6, (k, n))
    assert (H.strassen(a, b, 8) == a @ b).all()


def test_scores_near_the_limit_of_64_bits():
    a = np.array([[2 ** 31, -1] * 40] * 40, np.int64)
    assert H.product(a, a[:1])[0, 0] == 40 * (2 ** 62 + 1) and H.product(a, a).dtype == object
    big = H.quantised(np.array([[1e300, -0.001]]), 256)
    assert big[0, 0] == int(1e300) * 256 and big[0, 1] == -1


def brute(rows, every, positives=5, negatives=10):
    fine = [(i, np.floor(256.0 * np.array(v, np.float64)).astype(np.int64), lab) for i, v, lab, *_ in rows
            if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, (a, av, alab) in enumerate(fine):
        if a % every:
            continue
        got = [(-int(av @ v), i, j, lab) for j, (i, v, lab) in enumerate(fine) if j != k and len(v) == len(av)]
        for ps, p, _, _ in sorted(g for g in got if g[3] == alab)[:positives]:
            neg = sorted(g for g in got if g[3] != alab and 30 * -ps <= 100 * -g[0] <= 90 * -ps)[:negatives]
            out += [(a, p, r + 1, n, -ps, -ns) for r, (ns, n, _, _) in enumerate(neg)]
    return sorted(out)


def data(n=300):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(12) + 0.8 * np.sin(i % 3 + np.arange(12))).astype(np.float32).tolist(), int(i % 3)) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [None] * 12, 1), (n + 2, [float("nan")] * 12, 2), (n + 3, [float("inf")] * 12, 0),
             (n + 4, rows[4][1], None), (None, rows[5][1], 1), (n + 5, [1.0, 2.0], 1), (n + 6, [1.5, 2.0], 1),
             (n + 10, [0.5, 1.0], 0), (n + 8, [0.0] * 12, 1), (n + 20, [], 1), (n + 30, [], 2)]
    rows += [rows[10], rows[10], rows[7]]                       # repeated rows, an anchor among them
    rows += [(n + 40 + k, rows[20][1], k % 3) for k in range(30)]  # ties
    return [(*r, *["x"] * 6) for r in rows]


def test_against_brute_force(spark, monkeypatch):
    rows = data()
    want = brute(rows, 10)
    df = spark.createDataFrame(rows, VECS).repartition(3)
    for tile, block, band in ((1 << 19, 1 << 16, 256), (500, 100, 3)):
        monkeypatch.setattr(H, "TILE_VALUES", tile)
        monkeypatch.setattr(H, "BLOCK_VALUES", block)
        monkeypatch.setattr(H, "BAND", band)
        assert sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % 10 == 0).collect()) == want
    assert len({r[0] for r in want}) > 10


def test_empty_table(spark):
    assert H.mine(spark.createDataFrame([], VECS), F.col("vec_id") % 10 == 0).collect() == []
