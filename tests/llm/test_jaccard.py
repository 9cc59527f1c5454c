import random

import numpy as np
import pytest

from quarry.llm import graph
from quarry.llm import jaccard_join as J

from brute import jaccard_components, lower_ascii
from cases import DOCS, docs, rows, sentence


def same(spark, data):
    members, _ = J.join(docs(spark, data))
    got = sorted(map(tuple, J.component_ids(members).collect()), key=str)
    assert got == sorted(jaccard_components([(r[0], r[1]) for r in data]), key=str)


def test_edge_cases(spark):
    same(spark, rows())


def test_large_group_and_shared_passage(spark):
    """Near copies of one text, chains of drifting copies, a passage in all."""
    rng = random.Random(5)
    base, passage = sentence(rng, "en", 60), sentence(rng, "fr", 30)
    data = []
    for i in range(60):
        w = base.split()
        w[rng.randrange(len(w))] = f"w{i}"
        data.append(" ".join(w))
    w = sentence(rng, "en", 50).split()
    for i in range(30):  # neighbours link, ends do not
        w = [*w[1:], f"n{i}"]
        data.append(" ".join(w))
    data += [passage + " " + sentence(rng, "en", rng.randint(1, 40)) for _ in range(60)]
    rng.shuffle(data)
    same(spark, [(i, t, *[None] * 13) for i, t in enumerate(data)])


def test_copies_in_every_batch(spark, tmp_path):
    """A text stands in every file and batch; its one near copy, whose class id
    is larger, is beside it in one batch only."""
    rng = random.Random(11)
    files = 8

    def cid(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return J.class_id(next(J.shingle_sets(raw, np.array([0, len(raw)]))))

    pairs = []
    while len(pairs) < files:
        a = sentence(rng, "en", 60)
        b = a + " end"
        if cid(a) < cid(b):
            pairs.append((a, b))
    data = []
    for f in range(files):
        part = []
        for g, (a, b) in enumerate(pairs):
            part += [a, b if g == f else sentence(rng, "fr", 61)]
        part = [(100 * f + i, t, *[None] * 13) for i, t in enumerate(part)]
        spark.createDataFrame(part, DOCS).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
        data += part
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2", "spark.sql.files.openCostInBytes": "64m",
            "spark.sql.files.maxPartitionBytes": "64m"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = J.component_ids(J.join(spark.read.parquet(str(tmp_path / "docs")))[0]).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = jaccard_components([(r[0], r[1]) for r in data])
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_table(spark):
    members, links = J.join(docs(spark, []))
    assert members.count() == 0 and links.count() == 0


def test_one_of_each(spark):
    data = rows()
    kept = J.one_of_each(docs(spark, data))
    assert kept.columns == docs(spark, []).columns
    comp = jaccard_components([(r[0], r[1]) for r in data])
    empty = sorted((c[0] for c in comp if not c[1]), key=str)
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    n_groups = len({c[2] if c[2] is not None else ("none", i) for i, c in enumerate(comp) if c[1]})
    full = [g for g in got if g[1] and g[1].split()]
    assert sorted((g[0] for g in got if g not in full), key=str) == empty
    # ids 78 (two texts) and null stand in several groups
    assert len(full) >= n_groups and len({lower_ascii(t) for _, t in full}) == len(full)


@pytest.mark.parametrize("n", [1, 2, 200])
def test_components_of_a_chain(spark, n):
    ids = random.Random(n).sample(range(1000), n + 1)
    edges = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:])], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {i: min(ids) for i in ids if i != min(ids)}
