"""The registered query of every operator on the smallest driver tables."""

import os

import duckdb
import pytest

from quarry.llm.registry import ORACLE, QUERIES
from quarry.registry.compare import same
from quarry.session import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")

# The columns each contract asks for.
COLUMNS = {
    "op1": "doc_id size source_size target taken", "op2": "doc_id start n_tokens ids_crc32",
    "op4": "doc_id held_out lang_pred score", "op5": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op6": "page_id payload_bytes payload_digest record_type refers_to", "op7": "query_id rank vec_id score",
    "op9": "doc_id n_shingles component_id", "op11": "page_id url text n_chars",
    "op12": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op13": "anchor_id positive_id rank negative_id positive_score negative_score",
}


def test_one_query_per_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    assert set(COLUMNS.get(name.split("_")[0], "").split()) <= set(df.columns)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in ORACLE:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        res = con.execute(ORACLE[name])
        ok, msg = same(df.columns, rows, [d[0] for d in res.description], res.fetchall())
        assert ok, msg


def test_held_out_accuracy(spark):
    out = QUERIES["op4_language_crf"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = out.join(docs, "doc_id").where("held_out")
    n = held.count()
    assert n and held.where("lang_pred = lang").count() >= 0.95 * n
