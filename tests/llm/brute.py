"""Plain-Python versions of the operators, for small tables."""

from __future__ import annotations

import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def shingles(text: str | None, k: int = 5) -> set:
    w = SPACE_WORD.findall(lower_ascii(text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def jaccard_components(docs: list[tuple], percent: int = 75) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest reachable doc_id)."""
    sets = [(d, shingles(t)) for d, t in docs]
    post: dict = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            post.setdefault(g, []).append(i)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (_, s) in enumerate(sets):
        count: dict = {}
        for g in s:
            for j in post[g]:
                if j < i:
                    count[j] = count.get(j, 0) + 1
        for j, c in count.items():
            if 100 * c >= percent * (len(s) + len(sets[j][1]) - c):
                root[find(i)] = find(j)
    low: dict = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return [(d, len(s), low.get(find(i), d)) for i, (d, s) in enumerate(sets)]
