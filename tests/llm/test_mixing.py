import duckdb
import numpy as np
import pytest

from quarry.llm import mixing as M
from quarry.registry.compare import same
from quarry.llm.registry import ORACLE

from cases import docs, rows


def run(spark, data):
    s = M.sized(docs(spark, data), ["doc_id", "row"])
    return M.mix(s, M.targets(s))


@pytest.mark.parametrize("part", ["all", "none", "one"])
def test_against_sql(spark, part):
    data = {"all": rows(), "none": [], "one": rows()[:1]}[part]
    out = run(spark, data).select("row.doc_id", "size", "source_size", "target", "taken")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if data:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], r[1], r[3]) for r in data])
    res = con.execute(ORACLE["op1_mix_sources"])
    ok, msg = same(out.columns, [tuple(r) for r in out.collect()], [d[0] for d in res.description], res.fetchall())
    assert ok, msg


def test_targets_are_met_and_reruns_agree(spark):
    rng = np.random.default_rng(0)
    data = [(i, "w " * int(n), None, f"s{min(i % 10, 6)}", 0, *["x"] * 10) for i, n in enumerate(rng.integers(1, 60, 900))]
    a, b = (sorted(map(tuple, run(spark, data).select("row.doc_id", "size", "source_size", "target", "copies", "taken").collect()))
            for _ in range(2))
    assert a == b
    by = {}
    for (i, size, total, target, copies, taken) in a:
        assert taken == size * copies <= 3 * size
        t = by.setdefault(total, [target, 0, total])
        t[1] += taken
    assert all(abs(t[1] - t[0]) <= 60 and t[0] <= 3 * t[2] for t in by.values())
    assert abs(sum(t[0] for t in by.values()) - sum(t[2] for t in by.values())) < 1e-6
