import numpy as np
from pyspark.sql import functions as F

from quarry.llm import collision_search as C

S = "vec_id bigint, embedding array<float>, shard string, dim string, v string"


def brute(data, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in data
          if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for q, x in ok:
        if q % 10 == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), j) for j, y in ok if j != q and len(y) == len(x))[:k]
            out += [(q, r + 1, j, s) for r, (s, j) in enumerate(near)]
    return out


def run(spark, data, k):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in data], S)
    return sorted(tuple(r) for r in C.search(df, F.col("vec_id") % 10 == 0, k).collect())


def test_edge_cases(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    data += [(i, data[0][1]) for i in range(100, 130)]  # ties at distance 0
    data += [(200, None), (210, [0.0] * 6), (220, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (230, [float("nan")] * 6), (None, [1.0] * 6),
             (240, [float("inf")] * 6), (250, []), (260, [1.0, 2.0]), (261, [1.0, 3.0])]
    got, want = run(spark, data, 5), sorted(brute(data, 5))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_recall_over_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "SHARD_ROWS", 400)
    monkeypatch.setattr(C, "QUERIES", 40)
    rng = np.random.default_rng(2)
    data = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 32)))]
    got, want = run(spark, data, 10), brute(data, 10)
    hit = len({g[:1] + g[2:3] for g in got} & {w[:1] + w[2:3] for w in want}) / len(want)
    assert hit >= 0.95


def test_fewer_and_empty(spark):
    assert run(spark, [], 3) == []
    assert [r[2] for r in run(spark, [(0, [1.0]), (1, [2.0])], 10)] == [1]
