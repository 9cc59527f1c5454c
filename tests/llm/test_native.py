"""Licence scan, token rollups and line templates."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.llm import license_scan as S
from quarry.llm import line_templates as L
from quarry.llm import token_rollup as R
from quarry.llm.registry import ORACLE
from quarry.registry.compare import same
from quarry.session import ensure_checkpoint_dir

from cases import docs, rows


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# ---- line templates

def lined():
    data = rows()
    for k in range(14):
        text = [f"Posted on 2024-01-{k:02d} by user{k}", f"{'abc'[k % 3] * (k + 1)} is a unique line", "short",
                f"today the visitor {'xyzw'[k % 4]}name read this page again", ""]
        data.append((500 + k, "\n".join(text), "en", "s", 1, *["x"] * 10))
    return data


def passages():
    """A passage of 60 words in two documents, one in three that differs in a
    tenth of its words, one of 40 words in nine, and lines of their own."""
    long = [f"word{'abcdefghij'[k % 10]}{'klmnop'[k // 10]}" for k in range(60)]
    near = ["near", *long[1:]]
    data = []
    for k in range(9):
        text = [" ".join(f"own{'abcdefghi'[k]}{w}" for w in long), "brief " + " ".join(long[:39])]
        if k < 2:
            text.append(" ".join(long))
        elif k < 5:
            text.append(" ".join(f"{w}{'xyz'[k - 2]}" if i > 3 and i % 10 == 0 else w for i, w in enumerate(near)))
        data.append((700 + k, "\n".join(text), "en", "s", 1, *["x"] * 10))
    return data


def leaf_of_twelve():
    """Twelve templates of one leaf, of twelve different lines each, and lines
    that no other agrees with."""
    data = []
    for k in range(12):
        text = [f"12 34 56 {' '.join(f'kind{chr(97 + t)}{w}' for w in 'abcdef')} {'xyzuvwrstopq'[k]}var" for t in range(12)]
        text.append(f"12 34 56 {' '.join(chr(97 + k) * 2 + w for w in 'abcdefg')}")
        data.append((800 + k, "\n".join(text)))
    return data


def test_long_passages_recur_from_two_documents(spark):
    got = {r["row"]["doc_id"]: (r["n_dropped"], r["clean_text"]) for r in L.drop_recurring(docs(spark, passages())).collect()}
    assert {i: n for i, (n, _) in got.items()} == {700 + k: int(k < 5) for k in range(9)}
    assert all(t == "\n".join(d[1].split("\n")[:2]) for d in passages() for t in [got[d[0]][1]])


@pytest.mark.parametrize("part", ["all", "none"])
def test_templates_against_sql(spark, part):
    more = [(*r, "en", "s", 1, *["x"] * 10) for r in leaf_of_twelve()]
    data = [r for r in lined() + passages() + more if r[0] not in (78, None)] if part == "all" else []
    out = L.drop_recurring(docs(spark, data).select("doc_id", "text")).select(
        "row.doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("clean_text", F.lit(""))).alias("clean_md5"))
    no_python(out)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    if data:
        con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in data])
    res = con.execute(ORACLE["op10_line_templates"])
    ok, msg = same(out.columns, [tuple(r) for r in out.collect()], [d[0] for d in res.description], res.fetchall())
    assert ok, msg


def test_template_texts_and_repeated_ids(spark):
    d = docs(spark, lined())
    lines = L.parse(d)
    text = {r["text"] for r in L.template_texts(lines, L.templates(lines)).collect()}
    assert "Posted on <*> by <*>" in text and "today the visitor <*> read this page again" in text
    assert not any("unique" in t for t in text)
    out = L.drop_recurring(d)
    assert out.count() == len(lined()) and out.select("row.*").columns == d.columns
    kept = {r["row"]["doc_id"]: r["clean_text"] for r in out.collect()}
    assert "unique line" in kept[500] and "Posted" not in kept[500] and kept[70] is None


def test_every_template_of_a_leaf(spark):
    """Against one template at a time in plain Python."""
    data = leaf_of_twelve()
    d = spark.createDataFrame(data, "doc_id bigint, text string")
    docs_of = {}
    for i, text in data:
        for line in text.split("\n"):
            docs_of.setdefault(tuple("<*>" if any(c.isdigit() for c in t) else t for t in line.split()), set()).add(i)
    todo, gone = sorted(docs_of, key=lambda t: (len(docs_of[t]), " ".join(t)), reverse=True), set()
    while todo:
        near = [t for t in todo if sum(a == b for a, b in zip(t, todo[0])) >= L.ALIKE * len(t)]
        if len(set().union(*(docs_of[t] for t in near))) >= L.LEAST_DOCS:
            gone |= set(near)
        todo = [t for t in todo if t not in near]
    assert len(gone) == 144
    for seeds in (3, L.SEEDS):
        found = L.templates(L.parse(d), seeds=seeds)
        assert found.count() == 144 and found.select("template").distinct().count() == 12
    out = L.drop_recurring(d)
    no_python(out)
    for r in out.collect():
        assert r["n_dropped"] == 12 and r["clean_text"] == data[r["row"]["doc_id"] - 800][1].split("\n")[-1]


# ---- rollups

CH = "source string, lang string, tokenizer string, op string, n_tokens bigint, old_tokens bigint, n_docs bigint, batch string"


def test_rollup_batches(spark):
    import uuid

    roll = R.Rollup(spark, f"{ensure_checkpoint_dir(spark)}/roll-{uuid.uuid4().hex}")
    one = [("a", "en", "t1", "insert", 10, None, 1, "x"), ("a", "en", "t1", "insert", 10, None, 1, "x"),
           (None, None, "t1", "insert", None, None, 1, "x"), ("b", "fr", "t2", "insert", 7, None, 1, "x")]
    two = [("a", "en", "t1", "revise", 25, 10, 1, "x"), ("b", "fr", "t2", "delete", 7, None, 1, "x")]
    assert roll.commit("one", spark.createDataFrame(one, CH))
    assert roll.commit("two", spark.createDataFrame(two, CH))
    assert not roll.commit("two", spark.createDataFrame(two, CH))
    assert not roll.commit("one", spark.createDataFrame(one, CH))
    assert roll.commit("none", spark.createDataFrame([], CH))
    got = {tuple(r) for r in roll.totals().collect()}
    assert got == {("a", "en", "t1", 2, 35), (None, None, "t1", 1, 0)}
    again = R.Rollup(spark, roll.root)  # a new driver sees the same
    assert again.committed() == {"one", "two", "none"} and {tuple(r) for r in again.totals().collect()} == got
    with pytest.raises(Exception, match="unknown change"):
        roll.commit("bad", spark.createDataFrame([("a", "en", "t1", "drop", 1, 1, 1, "x")], CH))
    assert {tuple(r) for r in roll.totals().collect()} == got


def test_counters(spark):
    from quarry.llm.registry import vocabulary
    from tokenizers import Tokenizer

    n = {r["doc_id"]: r["n_tokens"] for r in R.count_tokens(docs(spark).where("doc_id < 78"), vocabulary()).collect()}
    tok = Tokenizer.from_str(vocabulary())
    assert n == {r[0]: len(tok.encode(r[1] or "", add_special_tokens=False).ids) for r in rows() if r[0] is not None and r[0] < 78}
    got = docs(spark).where("doc_id = 76").select(R.count_by_rule("text", "words-1")).first()[0]
    assert got == len(rows()[[r[0] for r in rows()].index(76)][1].split())


# ---- licences

def test_licences(spark):
    data = [r for r in rows() if r[0] != 60]
    for k, (family, notes) in enumerate(sorted(S.NOTICES.items())):
        data.append((300 + k, f"{data[k][1]}\n{notes[0]}\n{data[k + 1][1]}", "en", "s", 1, *["x"] * 10))
    data.append((400, "he is licensed to drive a car of any version", "en", "s", 1, *["x"] * 10))
    d = docs(spark, data)
    out = S.by_document(d, S.train(d))
    no_python(out)
    got = {r["doc_id"]: r["families"] for r in out.collect()}
    assert len(got) == len({r[0] for r in data})
    want = {300 + k: f for k, f in enumerate(sorted(S.NOTICES))}
    assert {i: f for i, f in got.items() if f} == want


def test_wrapped_notices(spark):
    """Each notice as a comment cut at 72 columns and, if it is short, over two
    lines; between lines of prose, with a blank line or without."""
    import textwrap

    data, want = [r for r in rows() if r[0] != 60], {}
    for family, notes in sorted(S.NOTICES.items()):
        for note in notes:
            lines = textwrap.wrap(note, 70 if len(note) > 70 else max(len(note) * 2 // 3, 20), break_long_words=False)
            for mark, gap in (("# ", "\n"), (" * ", "\n\n")):
                i = 300 + len(want)
                data.append((i, gap.join([data[i % 30][1], "\n".join(mark + x for x in lines), data[i % 30 + 1][1]]), "en", "s", 1, *["x"] * 10))
                want[i] = family
    far = S.NOTICES["bsd"][0].split()
    data.append((600, "\n\n".join(" ".join(far[k:k + 5]) for k in range(0, len(far), 5)), "en", "s", 1, *["x"] * 10))
    d = docs(spark, data)
    out = S.by_document(d, S.train(d))
    no_python(out)
    got = {r["doc_id"]: (r["families"], r["n_confirmed"]) for r in out.collect()}
    assert not {i: (f, got[i]) for i, f in want.items() if f not in got[i][0].split(",")}
    assert {i for i, (f, _) in got.items() if f} == set(want)


def test_licences_of_an_empty_table(spark):
    e = docs(spark, [])
    assert S.by_document(e, S.train(e)).count() == 0
