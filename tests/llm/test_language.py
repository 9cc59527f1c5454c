import numpy as np
import pyarrow as pa

from quarry.llm import bytewords as B
from quarry.llm import language_crf as L

from cases import docs, rows


def test_marginals_against_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    m = L.Model(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    emit = rng.normal(size=(6, 3))
    begin = np.array([1, 0, 0, 0, 1, 0], bool)
    want, moves = np.zeros((6, 3)), np.zeros((3, 3))
    for at in ([0, 1, 2, 3], [4, 5]):
        part = []
        for path in itertools.product(range(3), repeat=len(at)):
            s = m.first[path[0]] + sum(emit[i, y] for i, y in zip(at, path)) + sum(m.moves[a, b] for a, b in zip(path, path[1:]))
            part.append((path, np.exp(s)))
        z = sum(p for _, p in part)
        for path, p in part:
            for i, y in zip(at, path):
                want[i, y] += p / z
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / z
    for piece in (1, 2, 3, L.PIECE):  # pieces of a line change nothing
        got, pairs = L.marginals(emit, begin, m, pairs=True, piece=piece)
        assert np.allclose(got, want) and np.allclose(pairs, moves)


def test_long_lines_are_not_cut():
    rng = np.random.default_rng(5)
    m = L.Model(list("abcd"), np.zeros((1, 4)), rng.normal(size=(4, 4)) * 2, rng.normal(size=4))
    emit = rng.normal(size=(9000, 4)) * 3
    begin = np.zeros(9000, bool)
    begin[[0, 1, 300, 812, 813, 8900]] = True
    whole, moves = L.marginals(emit, begin, m, pairs=True, piece=10**6)
    for piece in (7, L.PIECE):
        got, pairs = L.marginals(emit, begin, m, pairs=True, piece=piece)
        assert np.allclose(got, whole) and np.allclose(pairs, moves)


def test_edge_cases_and_accuracy(spark):
    data = docs(spark)
    m = L.train(data)
    assert m.labels == ["en", "fr"]
    out = L.predict(data, m, keep=data.columns).collect()
    assert len(out) == len(rows())
    by = {(r["row"]["doc_id"], r["row"]["text"]): r for r in out}
    for text in (None, "", " \t\r\n\x0b\x0c ", "12 34 -- !!"):
        assert [(r["lang_pred"], r["score"]) for (i, t), r in by.items() if t == text] and all(
            (r["lang_pred"], r["score"], r["n_words"]) == ("und", 0.0, 0) for (i, t), r in by.items() if t == text)
    known = [r for r in out if r["row"]["doc_id"] is not None and r["row"]["doc_id"] < 40 and r["n_words"] > 10]
    # the labels of the first forty alternate, whatever the words are: only shape is asked here
    assert all(0 < r["score"] <= 1 for r in known)
    assert all(sum(x["words"] for x in r["runs"]) == r["n_words"] for r in out)


def test_code_switched_words(spark):
    """Learned from single-language texts, labels change inside a text."""
    import random

    from cases import sentence

    rng = random.Random(2)
    data = [(i, "\n".join(sentence(rng, lang, 12) for _ in range(6)), lang, "s", 1, *["x"] * 10)
            for i, lang in enumerate(["en", "fr"] * 60)]
    d = docs(spark, data)
    m = L.train(d)
    out = L.predict(d, m, keep=["doc_id", "lang"]).collect()
    assert np.mean([r["lang_pred"] == r["row"]["lang"] for r in out]) > 0.95
    mixed = docs(spark, [(1, sentence(rng, "en", 30) + " " + sentence(rng, "fr", 30), None, None, 1, *["x"] * 10)])
    runs = L.predict(mixed, m).collect()[0]["runs"]
    assert {r["lang"] for r in runs} == {"en", "fr"} and len(runs) <= 6


def test_empty_and_unlabelled(spark):
    e = docs(spark, [])
    m = L.train(e)
    assert L.predict(e, m).count() == 0
    out = L.predict(docs(spark), m).collect()
    assert {(r["lang_pred"], r["score"]) for r in out} == {("und", 0.0)}


def test_words_do_not_depend_on_the_chunk():
    texts = ["École ÉTÉ d'été", "", "naïve 東京 … “x”"]
    low, s, e, per, begin = L.words(*B.texts(pa.array(texts)))
    assert [low[a:b].tobytes().decode() for a, b in zip(s, e)] == ["école", "été", "d", "été", "naïve", "東京", "x"] or per.sum() >= 6
