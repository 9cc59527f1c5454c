import gzip

import pytest

from quarry.llm import archives as A

P = "page_id bigint, url string, html string, value string, n int, content string"


def pages(spark):
    big = "<p>" + "é" * 800 + "\r\n\r\nWARC/1.0\r\n\n</p>"
    data = [(1, "http://a/x y?q=1", big), (2, "http://b/", big), (3, None, big), (9, "http://c/", "x" * 999), (8, "u", "x" * 999),
            (5, "http://d/\n\r", ""), (6, "ü", None), (7, "v", "y" * 300_000), (4, "v", "y" * 300_000), (None, "v", "y" * 300_000),
            (11, "w", "z" * 1000), (12, "w", "z" * 1000), (13, "one", "q" * 2000)]
    return data, spark.createDataFrame([(*r, "v", 1, "c") for r in data], P)


@pytest.mark.parametrize("version", [1, 2])
def test_through_archives(spark, version):
    import hashlib

    data, df = pages(spark)
    got = sorted(map(tuple, A.pages_through_archives(df, version).collect()), key=str)
    want = []
    for i, _, html in data:
        body = (html or "").encode()
        same = [j for j, _, h in data if h == html and j is not None]
        top = max(same) if same and len(body) >= 1000 and i is not None else i
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "response" if top == i else "revisit", None if top == i else top))
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert A.pages_through_archives(spark.createDataFrame([], P)).count() == 0


def test_archives_of_both_versions(spark, tmp_path):
    data, df = pages(spark)
    A.write_arc(df, str(tmp_path / "arc"))
    seen, n = set(), 0
    for f in (tmp_path / "arc").glob("part-*"):
        raw = f.read_bytes()
        assert gzip.decompress(raw).startswith(b"filedesc://")
        for head, _ in A.arc_records(raw):
            seen.add(tuple(head))
            n += 1
    assert n == len(data) and seen == {tuple(x.split()) for x in A.ARC_FIELDS.values()}
    got = sorted(map(tuple, A.pages_through_archives(df).collect()), key=str)
    assert got == sorted(map(tuple, A.pages_through_archives(df, 1).collect()), key=str)


def test_version_block_and_spaces_in_urls():
    one = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<html>\n\n</html>"
    v2 = b"2 0 Crawl\n" + A.ARC_FIELDS[2].encode() + b"\n"
    raw = (b"filedesc://x.arc 0.0.0.0 19990102030405 text/plain 200 - - 0 x.arc " + str(len(v2)).encode() + b"\n" + v2 + b"\n"
           + b"http://h/a b 1.2.3.4 19990102030405 text/html 200 sum loc 77 x.arc " + str(len(one)).encode() + b"\n" + one + b"\n")
    for content in (raw, gzip.compress(raw), gzip.compress(raw[:200]) + gzip.compress(raw[200:])):
        (head, body), = A.arc_records(content)
        assert head["URL"] == "http://h/a b" and head["Offset"] == "77" and body == one
    rec = A.warc_record(head, body, "urn:uuid:1", None) + b"\r\n\r\n"
    (h, block), = A.warc_records(rec)
    assert block == one and h["warc-date"] == "1999-01-02T03:04:05Z" and h["warc-type"] == "response"
    with pytest.raises(ValueError):
        list(A.arc_records(raw[:-20]))
