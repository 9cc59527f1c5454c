"""Main text of web pages by differencing each page against its nearest URL.

Pages are cut into text lines (``html_lines``).  Within a host, pages are put
in the order of their URL paths, segment by segment, so the nearest URL is one
of the two neighbours: the one that agrees further.  The whole pages, menus and
footers included, are aligned line by line by their longest common subsequence;
lines that both have are the site's, not the page's: they are deleted.  This is
done for every page, whether it marks its article or not.

A check by the marks in the page follows, where they say more than a comparison
can.  Left lines in menus, headers, footers, sidebars, notices, adverts, forms
and comments go as well: sites put other words there on every page.  Of the
rest, lines of the article are the main text, else those in ``main``, else all.
Deleted lines come back if their article element has lines of the page's own
(passages do repeat); an article element that the nearest URL has entirely, as a
teaser, stays deleted.  Pages that do not mark their article get no line back.

A neighbour that has at least ``NEAR_COPY`` of a page's main text is rather a
copy of it than its sibling: then the other neighbour is asked if it has less,
and no article element is deleted if it has that much too.  If every line is
shared all the same, nothing tells site from page and the lines stay.  Pages of
a host with the same main lines count once and are treated alike, so a page is
never compared with its own copy.

Order and partners come from distributed positions in (host, path); a host is
cut into stretches of ``STRETCH`` pages which also get the page before and
after, so no task holds a whole host.  The alignment is bit-parallel, with one
row of bits kept per square root of the lines.

Edge cases: null html has no text (""), pages without lines are nobody's
partner, null or relative URLs have no host and
no partner; page ids and repeated rows are kept as they are; other columns are
ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.html_lines import ARTICLE, FRAME, lines
from quarry.operators.order import with_position

NEAR_COPY = 0.75
STRETCH = 256
BROADCAST_BYTES = 16 << 20

_URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#\\]*)([^?#]*)(\?[^#]*)?")

PARSED = "page_id bigint, url string, host string, seq binary, texts array<string>"
KEYS = "host string, path string, query string, seq binary, whole binary, level int, hashes array<bigint>, chars array<int>, parts array<int>"
DROPS = "host string, seq binary, gone array<boolean>"


def address(url: str | None) -> tuple[str | None, str, str]:
    """Host, path and query of a URL."""
    m = _URL.match(url) if url else None
    host = m[1].rsplit("@", 1)[-1].lower() if m else ""
    return (host, m[2] or "/", m[3] or "") if host else (None, "", "")


def marked_lines(page: str | None) -> tuple[int, list[tuple[str, int, int]]]:
    """The level of a page's main text and all its lines with level and part."""
    got = lines(page or "")
    return max((x[1] for x in got if x[1] != FRAME), default=ARTICLE), got


def kept_lines(page: str | None) -> tuple[int, list[str]]:
    """The level of a page's main text and the lines it may consist of."""
    level, got = marked_lines(page)
    return level, [x[0] for x in got if x[1] == level]


def common(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    inner = set(a[lo:len(a) - hi]) & set(b[lo:len(b) - hi])
    rows = [i for i in range(lo, len(a) - hi) if a[i] in inner]
    cols = [x for x in b[lo:len(b) - hi] if x in inner]
    n, m = len(rows), len(cols)
    found: list[int] = []
    if n and m:
        places: dict = defaultdict(list)
        for j, x in enumerate(cols):
            places[x].append(j)
        full = (1 << m) - 1

        def step(v: int, i: int) -> int:
            bits = bytearray((m + 7) // 8)
            for j in places[a[rows[i]]]:
                bits[j >> 3] |= 1 << (j & 7)
            u = v & int.from_bytes(bits, "little")
            return ((v + u) | (v - u)) & full

        # a zero bit j after row i: the common length grows at column j
        gap = isqrt(n) + 1
        saved, v = {0: full}, full
        for i in range(n):
            v = step(v, i)
            if (i + 1) % gap == 0:
                saved[i + 1] = v
        i, j, held, base = n, m, [], n + 1
        while i and j:
            if i - 1 < base:  # recompute the rows of one stretch
                base = (i - 1) // gap * gap
                held = [saved[base]]
                for k in range(base, i):
                    held.append(step(held[-1], k))
            if held[i - base] >> (j - 1) & 1:
                j -= 1
            elif not held[i - 1 - base] >> (j - 1) & 1:
                i -= 1
            else:
                found.append(rows[i - 1])
                i, j = i - 1, j - 1
    return [*range(lo), *reversed(found), *range(len(a) - hi, len(a))]


def nearness(a: dict, b: dict) -> tuple[int, int]:
    """Leading path segments, then leading characters, that two pages share."""
    x, y = a["path"].split("/"), b["path"].split("/")
    same = next((k for k, (s, t) in enumerate(zip(x, y)) if s != t), min(len(x), len(y)))
    s, t = a["path"] + a["query"], b["path"] + b["query"]
    return same, next((k for k, (c, d) in enumerate(zip(s, t)) if c != d), min(len(s), len(t)))


def shared_lines(page: dict, before: dict | None, after: dict | None) -> list[int]:
    """The lines of a page that its nearest URL has too; those of 0 ``chars``
    are aligned, but do not count as main text."""
    around = [p for p in (before, after) if p is not None]
    around.sort(key=lambda p: nearness(page, p), reverse=True)  # a tie goes to the page before
    total = sum(page["chars"])
    best: tuple[int, list[int]] | None = None
    for other in around:
        gone = common(page["hashes"], other["hashes"])
        size = sum(page["chars"][i] for i in gone)
        if best is None or size < best[0]:
            best = size, gone
        if best[0] < NEAR_COPY * total:
            break
    return [] if best is None or best[0] == total else best[1]


def deleted(page: dict, gone: list[int]) -> list[bool]:
    """For each line that may be main text whether it stays deleted, after the
    lines ``gone`` by comparison are checked against the marks of the page."""
    may = [i for i, n in enumerate(page["chars"]) if n]
    shared = set(gone)
    if page["level"] < ARTICLE:
        return [i in shared for i in may]
    if sum(page["chars"][i] for i in gone) >= NEAR_COPY * sum(page["chars"]):
        return [False] * len(may)
    own = {page["parts"][i] for i in may if i not in shared}
    return [page["parts"][i] not in own for i in may]


def _digest(texts: list[str]) -> tuple[bytes, list[int]]:
    marks = [hashlib.blake2b(t.encode(), digest_size=8).digest() for t in texts]
    return hashlib.blake2b(b"".join(marks), digest_size=16).digest(), [int.from_bytes(x, "little", signed=True) for x in marks]


def _sequence(level: int, got: list[tuple[str, int, int]]) -> tuple[bytes, list[str]]:
    """A digest of the lines that may be main text and of their marks, and the lines."""
    may = [x for x in got if x[1] == level]
    texts = [x[0] for x in may]
    starts = [k for k in range(1, len(may)) if may[k][2] != may[k - 1][2]] if level == ARTICLE else []
    return _digest(texts)[0] + bytes([level]) + b"".join(k.to_bytes(4) for k in starts), texts


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()),
             "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_())}
    fields = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def _small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def parse(pages: DataFrame) -> DataFrame:
    """Per page its host, the lines its main text may consist of and their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            out = []
            for ident, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                seq, texts = _sequence(*marked_lines(html))
                out.append((ident, url, address(url)[0], seq, texts))
            yield _batch(PARSED, out)

    return pages.mapInArrow(run, PARSED)


def site_lines(pages: DataFrame) -> DataFrame:
    """(host, seq, gone): of the lines that may be main text those that the
    comparison with the nearest URL deletes, for every line sequence of a host
    that loses some."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            out = []
            for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                host, path, query = address(url)
                if host is not None:
                    level, got = marked_lines(html)
                    seq, texts = _sequence(level, got)
                    if texts:  # an empty page says nothing about its host
                        whole, marks = _digest([x[0] for x in got])
                        chars = [len(x[0]) if x[1] == level else 0 for x in got]
                        out.append((host, path, query, seq, whole + _digest(list(map(str, chars)))[0], level, marks, chars, [x[2] for x in got]))
            yield _batch(KEYS, out)

    def stretch(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["pos"])
        out = []
        for k, page in enumerate(rows):
            if page["stretch"] == page["pos"] // STRETCH:
                shared = shared_lines(page, rows[k - 1] if k else None, rows[k + 1] if k + 1 < len(rows) else None)
                gone = deleted(page, shared)
                if any(gone):
                    out.append((page["host"], page["seq"], gone))
        return pa.Table.from_batches([_batch(DROPS, out)])

    rows = pages.mapInArrow(keys, KEYS)
    # copies on a host count once, at their first address
    once = rows.groupBy("host", "seq").agg(
        F.min_by(F.struct("path", "query", "level", "hashes", "chars", "parts"), F.struct("path", "query", "whole")).alias("_at")).select(
        "host", "seq", "_at.*")
    placed = with_position(once, [F.split("path", "/"), "query", "seq"], by=["host"], pos_col="pos", n_col=None)
    own = F.floor(F.col("pos") / STRETCH)
    edge = F.col("pos") % STRETCH
    halo = F.array(own, F.when((edge == 0) & (F.col("pos") > 0), own - 1), F.when(edge == STRETCH - 1, own + 1))
    cells = placed.withColumn("stretch", F.explode(F.filter(halo, lambda x: x.isNotNull())))
    return cells.groupBy("host", "stretch").applyInArrow(stretch, DROPS)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, texts): the lines of every page's main text."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                        F.col(f"`{html_col}`").alias("html"))
    from quarry.session import materialize

    gone = materialize(site_lines(rows), "site-lines")
    n, size = gone.agg(F.count(F.lit(1)), F.sum(F.size("gone"))).first()
    parsed = parse(rows)
    if not n:
        return parsed.select("page_id", "url", "texts")
    if 64 * n + size <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    joined = parsed.join(gone, ["host", "seq"], "left")
    left = F.filter("texts", lambda t, i: ~F.get("gone", i))
    return joined.select("page_id", "url", F.when(F.col("gone").isNull(), F.col("texts")).otherwise(left).alias("texts"))
