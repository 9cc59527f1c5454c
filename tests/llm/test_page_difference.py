"""Every page is compared with its nearest URL, whole, whether it marks its article or not."""

import random

from quarry.llm import page_difference as P

SCHEMA = "page_id bigint, url string, html string"


def texts(spark, pages):
    rows = [(k, f"http://h.example.org{path}", html) for k, (path, html) in enumerate(pages)]
    return {r.url.removeprefix("http://h.example.org"): r.texts for r in P.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_pages_with_a_marked_article_are_compared(spark):
    def page(k):
        return (f"<nav>menu {k}</nav><article><p>latest posts</p><p>read more</p></article>"
                f"<article><h1>title {k}</h1><p>a passage that pages share</p><p>{f'own words {k} ' * 9}</p></article><footer>end {k}</footer>")

    got = texts(spark, [(f"/a/{k}", page(k)) for k in range(5)])
    for k in range(5):  # the teaser is the site's, the passage is the article's
        assert got[f"/a/{k}"] == [f"title {k}", "a passage that pages share", f"own words {k} " .strip() + f" own words {k}" * 8]


def test_single_articles_and_near_copies_stay_whole(spark):
    body = "<article><p>one and two</p><p>All rights reserved</p></article>"
    long = f"<article><p>{'many words ' * 30}</p></article>"
    got = texts(spark, [("/s/1", f"<nav>m1</nav>{body}"), ("/s/2", f"<nav>m2</nav>{body}<p>x</p>"),
                        ("/s/3", "<article><p>three</p><p>All rights reserved</p></article>"),
                        ("/z/1", f"{long}<article><p>note 1</p></article>"), ("/z/2", f"{long}<article><p>note 2</p></article>")])
    assert got["/s/1"] == got["/s/2"] == ["one and two", "All rights reserved"]
    assert got["/s/3"] == ["three", "All rights reserved"]
    assert got["/z/1"] == [("many words " * 30).strip(), "note 1"]


def test_lines_of_menus_and_footers_are_aligned(spark):
    own = {k: f"words of page {k} and of no other page" for k in (1, 2, 3)}
    got = texts(spark, [("/m/1", f"<nav>Home</nav><p>{own[1]}</p><footer>Imprint</footer>"),
                        ("/m/2", f"<div>Home</div><p>{own[2]}</p><div>Imprint</div>"),
                        ("/m/3", f"<nav>Home</nav><p>{own[3]}</p><footer>Imprint</footer>")])
    assert got == {f"/m/{k}": [own[k]] for k in (1, 2, 3)}


def test_nearest_url_is_found_by_path_segments(spark):
    top, near, far = (" ".join(f"{w}{k}" for k in range(20)) for w in ("top", "near", "far"))
    got = texts(spark, [("/a", f"<p>shared in a</p><p>shared by name</p><p>{top}</p>"), ("/a-z", f"<p>shared by name</p><p>{far}</p>"),
                        ("/a/b", f"<p>shared in a</p><p>{near}</p>")])
    assert got["/a"] == ["shared by name", top]


def test_a_neighbour_in_segment_order_is_nearest():
    rng = random.Random(3)
    paths = sorted({"/" + "/".join(rng.choice(["a", "b", "a-b", "a.b", "ab", ""]) for _ in range(rng.randint(1, 4))) for _ in range(300)},
                   key=lambda p: p.split("/"))
    pages = [{"path": p, "query": ""} for p in paths]
    for k, page in enumerate(pages):
        best = max(P.nearness(page, x) for x in pages if x is not page)
        assert best == max(P.nearness(page, x) for x in pages[max(k - 1, 0):k + 2] if x is not page)


def test_copies_with_other_menus_are_treated_alike(spark):
    pages = [(f"/c/{k}", f"<nav>menu {k}</nav><div>site line</div><p>{'copied words ' * 5}</p>") for k in range(4)]
    pages.append(("/d/1", f"<div>site line</div><p>{'other words ' * 5}</p>"))
    got = texts(spark, pages)
    assert got.pop("/d/1") == [("other words " * 5).strip()]
    assert set(map(tuple, got.values())) == {(("copied words " * 5).strip(),)}
