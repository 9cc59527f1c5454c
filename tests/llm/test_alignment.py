"""Cross-tokenizer alignment against whole texts encoded by the libraries."""

import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest

from cases import DOCS, docs, rows
from quarry.llm import tokenizer_alignment as A
from quarry.llm.registry import vocabulary_pair

pytest.importorskip("public_tokenizers")


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) per text, from whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    spec_a, spec_b = vocabulary_pair()
    ta = Tokenizer.from_str(spec_a)
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_proto=spec_b)
    byte = A._byte_of()
    found, count = [], Counter()
    for t in texts:
        links, groups = [], []
        a = ta.encode(" " + t, add_special_tokens=False) if t else None
        b = tb.encode(t) if t else []
        if t:
            pa_ = [bytes(byte[c] for c in x) for x in a.tokens]
            pb = [bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, tb.id_to_piece(i)) for i in b)]
            ok = b"".join(pa_) == b"".join(pb) == (" " + t).encode()
        if not t or not ok:
            found.append(None)
            continue
        ea, eb = np.cumsum([len(x) for x in pa_]), np.cumsum([len(x) for x in pb])
        sa, sb = ea - [len(x) for x in pa_], eb - [len(x) for x in pb]
        j0, ids = 0, a.ids  # a property that copies
        sa, ea, sb, eb = sa.tolist(), ea.tolist(), sb.tolist(), eb.tolist()
        for i in range(len(ea)):
            while eb[j0] <= sa[i]:
                j0 += 1
            j = j0
            while j < len(eb) and sb[j] < ea[i]:
                links.append((b[j], ids[i]))
                j += 1
        both = sorted(set(ea) & set(eb))
        for lo, hi in zip([0, *both], both):
            x, y = (slice(bisect_left(s, lo), bisect_left(s, hi)) for s in (sa, sb))
            groups.append(",".join(map(str, ids[x])) + "|" + ",".join(map(str, b[y])))
        found.append((len(ids), len(b), len(groups), links, ";".join(groups)))
        count.update(links)
    top = Counter()
    for (b, _), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((*f[:3], len(f[3]), sum(count[k] == top[k[0]] for k in f[3]), sum(count[k] for k in f[3]), f[4]))
    return out


AWKWARD = ["a  b   c ", " lead", "tail  ", "  ", " ", "x\n y \n\n z", "tab\there\r\n", "nb  sp  em", "　 wide", "it's 3.14, don't! <s> </s> <unk>",
           "under▁score", "zero\x00byte", "emoji \U0001f600\U0001f468‍\U0001f469 café", "<|endoftext|> <|endoftext|>", "a" * 3000, "́ mark",
           "日本語 の text", "x \u0085 y", "foo\x1f bar", "--- === >>> \\\\ //"]


def data():
    extra = [(1000 + k, t, "en", "z", len(t), *["x"] * 10) for k, t in enumerate(AWKWARD)]
    return rows() + extra


def test_against_whole_texts(spark, monkeypatch):
    given = data()
    want = brute([r[1] for r in given])
    want = sorted(((r[0] is None, r[0] or 0, *w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for r, w in zip(given, want)))
    assert sum(w[2] > 0 for w in want) > 60 and any(w[5] and w[6] < w[5] for w in want)
    df = spark.createDataFrame(given, DOCS).repartition(5)
    got, totals = A.align(df, *vocabulary_pair())
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
                 for r in got.collect())
    assert got == want
    lexicon = A.pairs(totals)
    assert lexicon.groupBy("b", "a").count().where("count > 1").count() == 0
    assert lexicon.agg({"links": "sum"}).first()[0] == sum(w[5] for w in want)
    texts = {r.doc_id: r.groups for r in A.groups(df, *vocabulary_pair()).where("doc_id between 1 and 30").collect()}
    by_id = {w[1]: w for w in want if not w[0]}
    assert all(hashlib.sha256(g.encode()).hexdigest() == by_id[i][8] for i, g in texts.items())


def test_small_blocks_and_salts(spark, monkeypatch):
    """The same result with many blocks, few pairs per frame and split radixes."""
    given = data()
    df = spark.createDataFrame(given, DOCS)
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    whole = sorted((tuple(r) for r in A.align(df.coalesce(1), *vocabulary_pair())[0].collect()), key=key)
    monkeypatch.setattr(A, "GROUP_BYTES", 500)
    split = sorted((tuple(r) for r in A.align(df.repartition(40), *vocabulary_pair())[0].collect()), key=key)
    assert split == whole


def test_merge_of_runs(monkeypatch):
    monkeypatch.setattr(A, "FRAME", 7)
    monkeypatch.setattr(A, "FAN", 4)
    rng = np.random.default_rng(2)
    merger, want = A.Merger(), Counter()
    for _ in range(23):
        keys = np.unique(rng.integers(0, 200, rng.integers(1, 90)) << 20)
        counts = rng.integers(1, 9, len(keys))
        merger.add(A.loaded(A.stored(A.frames(keys, counts))))
        want.update(dict(zip(keys.tolist(), counts.tolist())))
    got = [(k, c) for keys, counts in A.merge_runs(merger.runs) for k, c in zip(keys.tolist(), counts.tolist())]
    assert got == sorted(want.items())


def test_empty_table(spark):
    got, totals = A.align(docs(spark, []), *vocabulary_pair())
    assert got.collect() == [] and A.pairs(totals).collect() == []
