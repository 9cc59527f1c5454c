import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bytewords as B
from quarry.llm import token_files as T
from quarry.llm.registry import END_ID, vocabulary

from cases import docs, rows


def whole(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(vocabulary())
    return [[*e.ids, END_ID] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="ab'., \n<|>1é", max_size=30)), min_size=1, max_size=6))
def test_words_give_the_ids_of_whole_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    enc = test_words_give_the_ids_of_whole_texts.__dict__.setdefault("enc", T.WordEncoder(vocabulary()))
    flat, n = enc.encode(*B.texts(pa.array(texts)))
    got = np.split(flat, np.cumsum(n)[:-1])
    assert [[*g.tolist(), END_ID] for g in got] == whole(texts)


@pytest.mark.parametrize("n,top", [(1, 1), (5, 40_000), (70_000, 3), (200_001, 49_000)])
def test_coder_round_trip(n, top):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, top).astype(np.uint32)
    image = T.encode_segment(ids, np.array([7]), np.array([False]), np.array([n]))
    back = T.decode_segment(image)
    assert (back[0] == ids).all() and back[1].tolist() == [7] and back[3].tolist() == [n]


def test_damage_is_seen():
    ids = np.arange(5000, dtype=np.uint32) % 17
    image = bytearray(T.encode_segment(ids, np.array([1]), np.array([False]), np.array([5000])))
    image[-3] ^= 1
    with pytest.raises(ValueError):
        T.decode_segment(bytes(image))


def test_files_against_the_library(spark):
    files = T.write_files(docs(spark), vocabulary(), END_ID)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in T.read_digests(files).collect())
    data = sorted(((r[0], r[1]) for r in rows()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    start, want = 0, []
    for (i, _), ids in zip(data, whole([t for _, t in data])):
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert sorted(len(r["ids"]) for r in T.read_ids(files).collect()) == sorted(w[2] for w in want)


def test_empty_table(spark):
    files = T.write_files(docs(spark, []), vocabulary(), END_ID)
    assert T.read_digests(files).count() == 0
