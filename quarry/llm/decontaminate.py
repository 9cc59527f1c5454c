"""Benchmark decontamination with an FM-index per shard of the training text.

A *shard* is a chunk of whole documents of bounded size inside a task.  Its
words that occur in any test phrase become symbols; every other word only
breaks the text, and stretches too short for the shortest phrase are left out,
because no phrase can lie there.  Over the rest each shard gets

* a suffix array by prefix doubling and from it the Burrows-Wheeler transform,
* a wavelet matrix with block-counted ranks,
* suffix positions sampled every ``SAMPLE`` words.

All test phrases are searched backward together; occurrences are located by
walking to the next sampled position, and overlapping spans are merged.

Test phrases (``window`` consecutive item words, or a whole shorter item) are
dealt to blocks of at most ``PHRASES`` rows; one pass over the documents serves
one block, so what is broadcast has a fixed bound for any benchmark.

Edge cases: null or word-less documents have no words and no hits; null or
word-less items have no phrases; a null item id is written as an empty string;
repeated items count once by id; repeated documents are rows of their own;
an empty benchmark leaves every document clean; other columns are carried only
when asked for, inside a struct.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import bytewords as B

WINDOW = 10
SAMPLE = 16
PHRASES = 1_000_000
_WORD = B.table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))  # after A-Z are lower-cased


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = B.LOWER[data]
    starts, ends, per = B.spans(low, offsets, _WORD)
    return B.hashes(low, starts, ends), per


# ---- the index -----------------------------------------------------------

class Wavelet:
    """Wavelet matrix over non-negative symbols with vectorised rank."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels = []
        n = len(seq)
        for bit in range(self.bits - 1, -1, -1):
            one = (seq >> bit) & 1
            packed = np.packbits(np.append(one.astype(np.uint8), np.zeros(64 - n % 64, np.uint8)), bitorder="little")
            word = packed.view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(word), dtype=np.int64)])[:-1]
            zeros = n - int(one.sum())
            self.levels.append((word, before, zeros))
            flag = one.astype(bool)
            seq = np.concatenate([seq[~flag], seq[flag]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        lo, hi = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k, (word, before, zeros) in enumerate(self.levels):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            for p in (lo, hi):
                w = p >> 6
                mask = (np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1)
                ones = before[w] + np.bitwise_count(word[w] & mask)
                p[:] = np.where(one, zeros + ones, p - ones)
        return hi - lo


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Prefix doubling; ``seq`` ends with a unique smallest symbol."""
    n = len(seq)
    rank = seq.astype(np.int64)
    width = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[:n - width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + nxt
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        if int(new.max()) == n - 1 or width >= n:
            return order
        rank, width = new, width * 2


class FMIndex:
    """Symbols 0 (end) and 1 (break) are reserved."""

    def __init__(self, seq: np.ndarray, sigma: int):
        seq = np.append(seq, 0)
        sa = suffix_array(seq)
        self.n = len(seq)
        self.bwt = seq[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))]).astype(np.int64)
        self.wave = Wavelet(self.bwt, sigma)
        self.sampled = sa % SAMPLE == 0
        self.index = np.cumsum(self.sampled) - 1
        self.position = sa[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of ``phrases`` that occur, interval starts, interval ends)."""
        alive = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, j]
            r = self.wave.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
            lo, hi = self.first[c] + r[:len(c)], self.first[c] + r[len(c):]
            keep = lo < hi
            alive, lo, hi = alive[keep], lo[keep], hi[keep]
            if not len(alive):
                break
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix array rows."""
        out = np.zeros(len(rows), np.int64)
        todo, row, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.sampled[row]
            out[todo[hit]] = self.position[self.index[row[hit]]] + steps
            todo, row = todo[~hit], row[~hit]
            c = self.bwt[row]
            row = self.first[c] + self.wave.rank(c, row)
            steps += 1
        return out


class PhraseSet:
    """The phrases of one block: word hashes -> symbols, grouped by length."""

    def __init__(self, raw: list[bytes], items: list[str]):
        names = sorted(set(items))
        index = {x: i for i, x in enumerate(names)}
        self.items = names
        seqs = [np.frombuffer(r, np.uint64) for r in raw]
        self.words = np.unique(np.concatenate(seqs)) if seqs else np.zeros(0, np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.words >> np.uint64(44)).astype(np.int64)] = True
        by: dict[int, list[int]] = {}
        for i, s in enumerate(seqs):
            by.setdefault(len(s), []).append(i)
        self.groups = []
        for size in sorted(by):
            m = np.stack([seqs[i] for i in by[size]])
            who = np.array([index[items[i]] for i in by[size]], np.int64)
            m = np.searchsorted(self.words, m) + 2
            one, back = np.unique(m, axis=0, return_inverse=True)
            back = back.reshape(-1)
            order = np.argsort(back, kind="stable")
            edge = np.searchsorted(back[order], np.arange(len(one) + 1))
            self.groups.append((size, one, edge, who[order]))
        self.least = min(by) if by else 0

    def symbols(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), np.int64)
        if len(self.words):
            i = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.words, h[i]), len(self.words) - 1)
            ok = self.words[at] == h[i]
            out[i[ok]] = at[ok] + 2
        return out


def find(phrases: PhraseSet, h: np.ndarray, per: np.ndarray):
    """(hit flag per word, documents, items): the last two are the distinct
    (document, item) pairs of all occurrences."""
    hit = np.zeros(len(h) + 1, np.int64)
    none = np.zeros(0, np.int64)
    edge = np.concatenate([[0], np.cumsum(per)])
    s = phrases.symbols(h)
    known = s > 1
    begin, end = known.copy(), known.copy()
    begin[1:] &= ~known[:-1]
    end[:-1] &= ~known[1:]
    cuts = edge[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(h))]
    begin[cuts] |= known[cuts]
    end[cuts - 1] |= known[cuts - 1]
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    long = b - a >= max(1, phrases.least)
    a, b = a[long], b[long]
    if not len(a):
        return hit[:-1].astype(bool), none, none
    size = b - a + 1  # with the break behind each stretch
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1])) + np.repeat(a - (ends - size), size)
    seq = s[np.minimum(at, len(s) - 1)]
    seq[ends - 1] = 1
    fm = FMIndex(seq, len(phrases.words) + 2)
    docs, items = [], []
    for length, rows, owner_edge, owner in phrases.groups:
        found, lo, hi = fm.search(rows)
        if not len(found):
            continue
        n = hi - lo
        row = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        start = at[fm.locate(row)]
        np.add.at(hit, start, 1)
        np.add.at(hit, start + length, -1)
        doc = np.searchsorted(edge, start, side="right") - 1
        pair = np.unique(np.stack([doc, np.repeat(found, n)], axis=1), axis=0)
        own = owner_edge[pair[:, 1] + 1] - owner_edge[pair[:, 1]]
        k = np.arange(int(own.sum())) + np.repeat(owner_edge[pair[:, 1]] - (np.cumsum(own) - own), own)
        docs.append(np.repeat(pair[:, 0], own))
        items.append(owner[k])
    if docs:
        pair = np.unique(np.stack([np.concatenate(docs), np.concatenate(items)], axis=1), axis=0)
        return np.cumsum(hit)[:-1] > 0, pair[:, 0], pair[:, 1]
    return hit[:-1].astype(bool), none, none


# ---- Spark ---------------------------------------------------------------

def test_phrases(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, phrase): distinct phrases as packed word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            for i, j, data, offsets in B.chunks(*B.texts(batch.column(1))):
                h, per = word_hashes(data, offsets)
                edge = np.concatenate([[0], np.cumsum(per)])
                item, raw = [], []
                for d in range(j - i):
                    w = h[edge[d]:edge[d + 1]]
                    for k in range(max(1, len(w) - window + 1) if len(w) else 0):
                        item.append(names[i + d].as_py())
                        raw.append(w[k:k + window].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(raw, pa.binary())],
                                                 names=["item", "phrase"])

    return (bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
            .mapInArrow(run, "item string, phrase binary").distinct())


def scan(docs: DataFrame, bench: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",),
         item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: ``row`` (struct of the kept columns), n_words,
    spans (merged hits as first word and word behind the last), n_hit, items
    (sorted ids whose phrases occur)."""
    spark = docs.sparkSession
    phrases = test_phrases(bench, item_col, item_text, window).persist()
    blocks = max(1, -(-phrases.count() // PHRASES))
    phrases = phrases.withColumn("block", F.pmod(F.xxhash64("item", "phrase"), F.lit(blocks)))
    kept = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    span = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("stop", T.IntegerType())])
    shape = T.StructType([T.StructField("rid", T.LongType()), T.StructField("row", kept),
                          T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(span)),
                          T.StructField("items", T.ArrayType(T.StringType()))])
    inside = list(keep).index(text_col) if text_col in keep else None
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    # the same number for the same row in every pass over the same files
    rid = F.monotonically_increasing_id().alias("rid")
    given = docs.select(row, rid, F.col(f"`{text_col}`").alias("_text")) if inside is None else docs.select(row, rid)
    arrow_span = pa.struct([("first", pa.int32()), ("stop", pa.int32())])

    def one_pass(block: int) -> DataFrame:
        t = phrases.where(F.col("block") == block).select("item", "phrase").toArrow()  # at most about PHRASES rows
        shared = spark.sparkContext.broadcast((t["phrase"].to_pylist(), t["item"].to_pylist()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = PhraseSet(*shared.value)
            names = pa.array(p.items, pa.string())
            for batch in batches:
                col = batch.column(2) if inside is None else batch.column(0).field(inside)
                for i, j, data, offsets in B.chunks(*B.texts(col)):
                    h, per = word_hashes(data, offsets)
                    hit, doc, item = find(p, h, per)
                    edge = np.concatenate([[0], np.cumsum(per)])
                    head, tail = hit.copy(), hit.copy()
                    if len(hit):
                        head[1:] &= ~hit[:-1]
                        tail[:-1] &= ~hit[1:]
                        cut = edge[1:-1]
                        cut = cut[(cut > 0) & (cut < len(hit))]
                        head[cut] |= hit[cut]
                        tail[cut - 1] |= hit[cut - 1]
                    a, b = np.flatnonzero(head), np.flatnonzero(tail) + 1
                    per_span = np.diff(np.searchsorted(a, edge))
                    base = np.repeat(edge[:-1], per_span)
                    spans = pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(per_span)]).astype(np.int32)),
                        pa.StructArray.from_arrays([pa.array((a - base).astype(np.int32)),
                                                    pa.array((b - base).astype(np.int32))], fields=list(arrow_span)))
                    n_items = np.bincount(doc, minlength=j - i)
                    found = pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(n_items)]).astype(np.int32)), names.take(pa.array(item)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(1).slice(i, j - i), batch.column(0).slice(i, j - i),
                         pa.array(per.astype(np.int64)), spans, found], names=["rid", "row", "n_words", "spans", "items"])

        return given.mapInArrow(run, shape)

    out = one_pass(0)
    if blocks > 1:
        for k in range(1, blocks):
            out = out.unionByName(one_pass(k).where("size(spans) > 0"))
        out = out.groupBy("rid").agg(F.first("row").alias("row"), F.first("n_words").alias("n_words"),
                                     F.flatten(F.collect_list("spans")).alias("spans"),
                                     F.flatten(F.collect_list("items")).alias("items"))
    covered = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["first"], acc["stop"]))).alias("n"),
                                F.greatest(acc["stop"], s["stop"]).alias("stop")), lambda acc: acc["n"])
    return out.select("row", "n_words", "spans", covered.cast("long").alias("n_hit"),
                      F.array_sort(F.array_distinct("items")).alias("items"))
