"""Page differencing: lines, alignment, partners and whole tables."""

import os
import random
import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from quarry.llm import page_difference as P
from quarry.llm.html_lines import lines
from quarry.llm.registry import QUERIES

SCHEMA = "page_id bigint, url string, html string, host string, seq string, pos string, gone string, texts string, level string"


def text(html):
    return "\n\n".join(P.kept_lines(html)[1])


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<article><h1>A</h1><p>one\n two<br>three<p>four &lt;b&gt; <b>fi</b>ve</article><footer>f</footer>", "A\n\none two three\n\nfour <b> five"),
    ("<nav><ul><li>m</ul></nav><div class='side-bar ad'>x</div><article><p>t<div class=ad>buy</div>u</article>", "t\n\nu"),
    ("<script>var t='</p><article>no</article>'</script><style>p{}</style><article>yes<!-- no --></article>", "yes"),
    ("<article><header><p class=by>me</p><h1>T</h1></header><p>b</p><footer>tags</footer></article><section id=comments><p>first!</p></section>", "T\n\nb"),
    ("<div id=cookie-notice>c</div><main><p>m</p><aside>s</aside><form>f<input></form></main><p>out</p>", "m"),
    ("<article><p title='a > b'>x</p><table><tr><td>1<td>2<tr><td>3</table><ul><li>i<li>j</ul>", "x\n\n1 2\n\n3\n\ni\n\nj"),
    ("<body class='nav-open'><nav>menu <article>in an unclosed menu</article>", "in an unclosed menu"),
    ("<article>a &eacute; &#233; &#x1F600; &amp and &unknown; &nbsp; b</article", "a é é \U0001f600 & and &unknown; b"),
    ("<article><p><b>bold<br><p>next</b> more</article><p>after", "bold\n\nnext more"),
    ("<p>a<!-- never closed <p>b", "a"), ("<p>x</p><p hidden>y</p><p style='display: none'>z</p>", "x"),
    ("a < b and c > d <3 <p>é</p>", "a < b and c > d <3\n\né"), ("<title>t</title><p>body</p>", "body"),
    ("<div class='article-body'><p>k</p></div><p>rest</p>", "k"), ("<article><article class=comment>c</article>own</article>", "own"),
])
def test_text_of_a_page(html, want):
    assert text(html) == want


def test_very_long_and_deep_pages():
    assert len(lines("<div><b>" * 50_000 + "x" + "</i>" * 50_000)) == 1
    assert text("<article>" + "<p>w" * 100_000) == "\n\n".join(["w"] * 100_000)


def dp(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(400):
        k = rng.choice([1, 2, 5, 30])
        a, b = ([rng.randrange(k) for _ in range(rng.randrange(40))] for _ in range(2))
        got = P.common(a, b)
        assert got == sorted(set(got)) and len(got) == dp(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in got)
    a = [i % 7 for i in range(4000)]
    assert len(P.common(a, a[::-1])) == dp(a[:4000], a[::-1])


def site():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]

    def para(n=30):
        return " ".join(rng.choice(words) for _ in range(n))

    rows = []
    for h in range(3):
        top, bottom = [para(3) for _ in range(4)], [para(5), "All rights reserved"]
        passage = para(40)
        for k in range([1, 40, 700][h] if h < 2 else 60):
            body = [para() for _ in range(rng.randint(1, 4))] + ([passage] if k % 17 == 0 else [])
            html = "".join(f"<div>{x}</div>" for x in [*top, f"you are here: {k}", *body, *bottom])
            rows.append((len(rows), f"https://h{h}.example.org/{'abc'[k % 3]}/{k}?x={k % 2}", html, *["x"] * 6))
    rows += [(900, None, rows[5][2], *["x"] * 6), (901, "https://h1.example.org/a/5", None, *["x"] * 6),
             (902, "relative/path", "<p>p</p>", *["x"] * 6), (None, rows[7][1], rows[7][2], *["x"] * 6)]
    rows += [(1000 + k, f"https://h1.example.org/z/{k}", rows[9][2], *["x"] * 6) for k in range(30)]  # copies
    rows += [rows[3], rows[3]]
    near = rows[11][2].replace("<div>", "<p>", 1).replace("All rights", "Some rights")
    rows += [(1100, rows[11][1] + "#top", near, *["x"] * 6),
             (1101, "http://h1.example.org/a/1", "<article><p>All rights reserved</p></article>", *["x"] * 6)]
    return rows


def brute(rows):
    """Everything in one list per host."""
    hosts, out = {}, []
    for i, url, html, *_ in rows:
        host, path, query = P.address(url)
        level, texts = P.kept_lines(html)
        page = hosts.setdefault(host, {}).setdefault(tuple(texts), {"level": level, "path": path, "query": query, "chars": [len(t) for t in texts],
                                                                    "hashes": list(texts)})
        if (path, query) < (page["path"], page["query"]):
            page.update(path=path, query=query)
    gone = {}
    for host, pages in hosts.items():
        order = sorted((p for p in pages.values() if p["hashes"]), key=lambda p: (p["path"], p["query"], P._digest(p["hashes"])[0]))
        for k, p in enumerate(order):
            if host is not None and p["level"] < 2:
                gone[host, tuple(p["hashes"])] = P.shared_lines(p, order[k - 1] if k else None, order[k + 1] if k + 1 < len(order) else None)
    for i, url, html, *_ in rows:
        texts = P.kept_lines(html)[1]
        drop = set(gone.get((P.address(url)[0], tuple(texts)), ()))
        out.append((i is None, i or 0, url or "", "\n\n".join(t for k, t in enumerate(texts) if k not in drop)))
    return sorted(out)


def test_sites_against_brute_force(spark, monkeypatch):
    rows = site()
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for stretch, limit in ((256, 1 << 24), (2, 0)):
        monkeypatch.setattr(P, "STRETCH", stretch)
        monkeypatch.setattr(P, "BROADCAST_BYTES", limit)
        got = [(r.page_id is None, r.page_id or 0, r.url or "", "\n\n".join(r.texts)) for r in P.extract(df).collect()]
        assert sorted(got) == want
    for _, i, _, t in want:  # what the site repeats is gone, what the page says is there
        if 1 <= i < 100 and i != 14:  # 14 stands beside the page whose footer was changed
            assert "rights reserved" not in t and "you are here" in t


def test_empty_table(spark):
    assert P.extract(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables not present")
def test_articles_of_the_driver_pages(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in QUERIES["op11_page_difference"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").where(F.col("html").isNotNull()).collect()
    for p in pages:
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = (" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1|li|ul)\b[^>]*>", body))
        assert got[p.page_id].text == "\n\n".join(x for x in parts if x)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)
