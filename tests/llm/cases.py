"""Small tables with every awkward case, used by all operator tests."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators might use inside
    *[T.StructField(c, T.StringType()) for c in ("row", "_id", "_text", "size", "key", "cid", "score", "id", "pos", "part")]])

SYLLABLES = {"en": "the ing tion and er on th re".split(), "fr": "le que eau ment ç é oi ou".split()}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    out = []

    def add(i, text, lang="en", source="a"):
        out.append((i, text, lang, source, len(text) if text is not None else None, *["x"] * 10))

    base = [sentence(rng, rng.choice(["en", "fr"]), rng.randint(3, 120)) for _ in range(40)]
    for i, t in enumerate(base):
        add(i, t, "en" if i % 2 else "fr", f"s{i % 4}")
    for i in range(40, 60):  # near copies: one word changed
        w = base[i - 40].split()
        w[rng.randrange(len(w))] = "changed"
        add(i, " ".join(w), None if i % 5 == 0 else "en", "s0")
    for i in range(60, 66):
        add(i, base[3].upper() if i == 60 else base[3], "en", None)
    add(70, None)
    add(71, "")
    add(72, " \t\r\n\x0b\x0c ")
    add(73, "one two")
    add(74, "one two")
    add(75, "12 34 -- !!")
    add(76, "Straße ÉCOLE naïve 東京 “quoted” … <|endoftext|> don't stop")
    add(77, " ".join(sentence(rng, "en", 50) for _ in range(400)) + "\n" + "x" * 40_000)
    add(78, base[5])
    add(78, base[5])   # repeated row
    add(78, base[6])   # repeated id, other text
    add(None, base[7])
    add(None, "text without an id that is long enough to hold a few shingles of words")
    add(None, None, None, None)
    return out


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS)
