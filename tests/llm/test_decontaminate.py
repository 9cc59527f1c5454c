import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import decontaminate as D

from brute import lower_ascii
from cases import docs, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(data, bench, window=10):
    phrases = {}
    for item, text in bench:
        w = WORD.findall(lower_ascii(text or ""))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[k:k + window]), set()).add("" if item is None else str(item))
    sizes = {len(p) for p in phrases}
    out = []
    for i, text in data:
        w = WORD.findall(lower_ascii(text or ""))
        hit, items = set(), set()
        for s in sizes:
            for k in range(len(w) - s + 1):
                if (p := tuple(w[k:k + s])) in phrases:
                    hit |= set(range(k, k + s))
                    items |= phrases[p]
        out.append((i, len(w), len(hit), sorted(items)))
    return sorted(out, key=str)


def check(spark, data, bench):
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    out = D.scan(docs(spark, data), b, keep=["doc_id", "row"])
    got = sorted(((r["row"]["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in out.collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in data], bench)


def test_edge_cases(spark, monkeypatch):
    data = rows()
    long = data[-8][1] if data[-8][1] and len(data[-8][1]) > 9999 else max((r[1] or "" for r in data), key=len)
    w = long.split()
    bench = [(1, data[3][1]), (2, " ".join(w[100:130])), (3, "one two"), (4, None), (5, ""), (None, data[7][1]),
             (6, "not in any document at all, never ever seen, anywhere here"), (2, " ".join(w[100:130])), (7, "ÉCOLE")]
    check(spark, data, bench)
    monkeypatch.setattr(D, "PHRASES", 40)  # several blocks give the same
    check(spark, data, bench)


def test_empty_tables(spark):
    check(spark, rows(), [])
    check(spark, [], [(1, "a b c")])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=60), st.lists(st.integers(2, 5), min_size=1, max_size=4))
def test_index_against_scan(seq, pattern):
    seq, pattern = np.array(seq), np.array(pattern)
    fm = D.FMIndex(seq, 6)
    found, lo, hi = fm.search(pattern[None, :])
    got = sorted(fm.locate(np.arange(lo[0], hi[0])).tolist()) if len(found) else []
    want = [i for i in range(len(seq) - len(pattern) + 1) if (seq[i:i + len(pattern)] == pattern).all()]
    assert got == want
