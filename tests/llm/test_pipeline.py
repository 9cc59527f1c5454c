import random

import pytest

import corpus_pipeline as P
from quarry.session import materialize

from brute import lower_ascii
from cases import DOCS, docs, rows

SF = "/root/testdata/sf0.001"


def test_stages_on_awkward_rows(spark, tmp_path):
    bench = spark.createDataFrame([(1, rows()[8][1]), (2, None)], "item_id bigint, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    d = materialize(docs(spark), "docs")
    sizes = [d.count()]
    for k, (name, f) in enumerate(P.STAGES):
        out = f(spark, d, str(tmp_path))
        if k < len(P.STAGES) - 1:
            assert out.columns == DOCS.names
        d = materialize(out, name)
        sizes.append(d.count())
        if k == 1:
            texts = [lower_ascii(r["text"]) for r in d.select("text").collect()]
            assert len(set(texts)) == len(texts)
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[5] == sizes[4] > 0
    assert set(d.columns) >= {"doc_id", "start", "n_tokens", "ids_crc32"}


@pytest.mark.parametrize("k", range(5))
def test_stages_on_an_empty_table(spark, tmp_path, k):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.STAGES[k][1](spark, docs(spark, []), str(tmp_path)).count() == 0


def test_clean_documents_in_several_languages_stay(spark, tmp_path):
    rng = random.Random(3)
    words = {"de": "und der nicht schon".split(), "en": "the with that have".split(), "fr": "les avec pour dans".split()}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    data = [(i, say(x, 40), x, "s", 1, *["x"] * 10) for i, x in enumerate(sorted(words) * 30)]
    data += [(1000, "\n".join([say("en", 30), say("fr", 30)]), None, "s", 1, *["x"] * 10),
             (1001, "\n".join(say(x, 30) for x in sorted(words)), None, "s", 1, *["x"] * 10)]
    out = P.language_id(spark, docs(spark, data), str(tmp_path))
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r[0] for r in data}


def test_run(spark):
    out = P.run(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0 < out.count() <= 3 * n
