"""Text lines of a web page with the part of the page they stand in.

A page is cut into tags and text; text between two block tags is one line, with
character references decoded and white space made one space.  Broken pages are
read as far as they go: unknown end tags are ignored, an inline end tag never
closes a block, a paragraph, list item, row or cell ends where the next begins, and an
element that is never closed lasts to the end of the one around it.
"""

from __future__ import annotations

import re
from html import unescape

FRAME, LOOSE, MAIN, ARTICLE = -1, 0, 1, 2  # menus and the like; unmarked; in main; in the article

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|</?[a-zA-Z][^>]*\Z""", re.S)
_ATTR = re.compile(r"""([a-zA-Z:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*")

# Element names by their role in the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes".split())
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search
section summary table tbody tfoot thead tr ul""".split())
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose text is not part of a page's main text, wherever they stand.
ASIDE = set("""head nav aside footer form button select datalist menu dialog noscript template svg canvas audio video object
search label output""".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id names that mark such parts on any element ...
PARTS = set("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies
consent gdpr notice popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb
breadcrumbs sidebar related recommended recommendations teaser share sharing social toolbar topbar masthead copyright comment
comments disqus replies pagination pager""".split())
#: ... and those that do so on containers only.
CONTAINER_PARTS = set("header footer side rail widget search form skip legal".split())
CONTAINERS = set("div section ul ol dl table td span".split())
#: Names of the article itself.
BODIES = set("""article articlebody article-body article-content article-text post post-body post-content entry entry-content
story story-body main-content page-content content""".split())
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "option": ({"option"}, {"select", "datalist"})}


def _marks(tag: str, attrs: str) -> tuple[bool, int]:
    """Whether an element is apart from the main text, and the level it opens."""
    level = ARTICLE if tag == "article" else MAIN if tag == "main" else LOOSE
    apart = tag in ASIDE
    if attrs and tag not in ("html", "body") and any(a in attrs for a in ("class", "id", "role", "hidden", "style", "itemprop", "CLASS", "ID")):
        given = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(attrs)}
        names = f"{given.get('class', '')} {given.get('id', '')}".split()
        words = {w.lower() for n in names for w in _WORD.findall(n)}
        if level:
            words &= {"comment", "comments", "teaser", "related", "ad", "advert", "sponsored", "promo"}
        apart |= bool(words & PARTS) or (tag in CONTAINERS and bool(words & CONTAINER_PARTS)) or given.get("role", "").lower() in ROLES
        apart |= "hidden" in given or "display:none" in given.get("style", "").replace(" ", "").lower()
        if not level and not apart:
            if given.get("role", "").lower() in ("article", "main"):
                level = ARTICLE if given["role"].lower() == "article" else MAIN
            elif given.get("itemprop", "") == "articleBody" or any(n.lower() in BODIES for n in names):
                level = ARTICLE if tag not in ("span", "a", "p") else LOOSE
    return apart, level


def lines(page: str) -> list[tuple[str, int, int]]:
    """(text, level, part) of the lines of a page in their order; a part is the
    outermost element that opened the level, numbered from 1 (0: no element)."""
    out: list[tuple[str, int, int]] = []
    buf: list[str] = []
    stack: list[tuple[str, bool, int, bool]] = []  # name, apart, level opened, header of an article
    opened: dict[str, int] = {}
    apart = head = 0
    heading = False
    levels, parts = [LOOSE], [0]
    last = 0

    def flush() -> None:
        if buf:
            text = " ".join(unescape("".join(buf)).split())
            buf.clear()
            if text:
                out.append((text, FRAME if apart or (head and not heading) else levels[-1], parts[-1]))

    def pop() -> None:
        nonlocal apart, head
        name, a, lev, h = stack.pop()
        opened[name] -= 1
        apart -= a
        head -= h
        if lev:
            levels.pop()
            parts.pop()

    def close(name: str) -> None:
        if not opened.get(name):
            return
        if name not in BLOCK and name not in ASIDE:
            for other, *_ in reversed(stack):  # an inline end tag stays inside its block
                if other == name:
                    break
                if other in BLOCK:
                    return
        while stack[-1][0] != name:
            pop()
        pop()

    def settle(name: str) -> None:
        """Ends what a start tag ends without an end tag."""
        if name in BLOCK and opened.get("p"):
            for other, *_ in reversed(stack):
                if other == "p":
                    close("p")
                    break
                if other in BLOCK:
                    break
        same, around = _ENDS.get(name, ((), ()))
        for k in range(len(stack) - 1, -1, -1) if same else ():
            if stack[k][0] in around or stack[k][0] in ("article", "main", "body"):
                break
            if stack[k][0] in same:
                while len(stack) > k:
                    pop()
                if name != "tr":
                    break

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            buf.append(page[at:])
            break
        if m.start() > at:
            buf.append(page[at:m.start()])
        at = m.end()
        end, name, attrs = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        block = name in BLOCK
        if block:
            flush()
        elif name in ("br", "td", "th"):
            buf.append(" ")
        if end:
            was = apart
            if not block and opened.get(name) and (name in ASIDE or was):
                flush()
            close(name)
            if name in HEADING:
                heading = False
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = n if stop is None else stop.start()
            continue
        if name in VOID:
            continue
        settle(name)
        a, level = _marks(name, attrs)
        if level == MAIN and name == "main" or level == ARTICLE and name == "article":
            closable = ("nav", "header") if level == ARTICLE else ("nav", "header", "footer")
            for k, (other, *_) in enumerate(stack):
                if other in closable:  # was never closed
                    while len(stack) > k:
                        pop()
                    break
        h = name == "header" and levels[-1] > LOOSE
        a = a or (name == "header" and not h)
        if a and not block:
            flush()
        stack.append((name, a, level, h))
        opened[name] = opened.get(name, 0) + 1
        apart += a
        head += h
        if level:
            last += level > levels[-1]
            parts.append(last if level > levels[-1] else parts[-1])
            levels.append(max(level, levels[-1]))
        if name in HEADING:
            heading = True
    flush()
    return out
