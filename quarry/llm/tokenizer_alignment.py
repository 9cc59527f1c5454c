"""Tokens of two tokenizers aligned by the bytes they cover.

A text is encoded by a byte-level vocabulary (A, on a space and the text) and
by a piece vocabulary (B, which puts the space itself).  Offsets where tokens
of both end cut them into *groups*; an A and a B token occurrence whose bytes
overlap are a *link*.  The number of links of every id pair in the corpus is
counted outside memory, in four Spark stages:

1. Encoding tasks work on blocks of whole texts (``BLOCK_BYTES``, or one longer
   text).  A block's (pair, document, links) records are radix-partitioned by
   the low bits of the B id, sorted by (B id, A id, document) and stored as one
   zstd *run* per radix.  The runs' pair counts are merged as the task goes, by
   a heap over the runs, so that a pair that fills the corpus leaves one
   number per task.
2. The tasks' counts are merged again by the same k-way merge, ``FAN`` runs at
   a time: first within (radix, part), then within a radix.  A merged run holds a
   pair once, so its size is bounded by the pairs of the two vocabularies.
3. In that order all pairs of a B id stand together: its maximum is known when
   its last pair has passed, and totals leave with a mark on the maxima.
4. Totals meet the runs of their radix again, and each run streams back what it
   adds to its documents; a radix is split over ``salt`` groups of blocks so
   that no task depends on how often a pair occurs.

Runs are rows of a table in the shared folder, written by Spark's committer; a
lost executor repeats its own tasks only.

Units: no token of either vocabulary spans a space that follows a character
that is not white space, so texts are cut there and every distinct unit is
encoded once per worker (kept by 64-bit hash, at most ``KEEP`` units).

Edge cases: null, empty and not exactly covered texts (a tokenizer whose bytes
differ from the text's) have no tokens: zeros and an empty ``groups_sha256``;
special tokens' strings are plain text; rows count each, repeated ids and
repeated rows too; a null id stays null; other columns are ignored; an empty
table gives no row.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import bytewords as B
from quarry.session import materialize

RADIX = 16                 # runs of a block; a power of two
BLOCK_BYTES = 1_000_000    # text in a block
FRAME = 8192               # pairs in one compressed frame of a counting run
FAN = 32                   # runs merged at once
KEEP = 300_000             # units a worker remembers
GROUP_BYTES = 4 << 20      # runs of one radix that a task reads

RUNS = "block bigint, part int, radix int, records bigint, head binary, body binary, docs binary"
TOTALS = "radix int, seq int, totals binary"
ADDED = "block bigint, best array<bigint>, added array<bigint>"
DOCS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
RESULT = DOCS + ", n_best bigint, count_sum bigint"


# ---- packed arrays and counting runs --------------------------------------

def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as zstd, byte planes apart (small numbers leave empty planes)."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        data = zstandard.ZstdCompressor(level=1).compress(planes)
        out.append(struct.pack("<4sII", a.dtype.str.encode().ljust(4), len(a), len(data)) + data)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n, size = struct.unpack_from("<4sII", data, at)
        at += 12
        dtype = np.dtype(kind.decode().strip())
        raw = zstandard.ZstdDecompressor().decompress(data[at:at + size], max_output_size=max(1, n * dtype.itemsize)) if n else b""
        at += size
        planes = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n))
    return out


def frames(keys: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """A counting run: sorted distinct pairs with their counts."""
    return [pack(np.diff(keys[k:k + FRAME], prepend=0), counts[k:k + FRAME]) for k in range(0, len(keys), FRAME)]


def merge_runs(runs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """K-way merge of counting runs in ascending order, equal pairs added up.

    A heap holds the last pair of the frame that each run stands at.  All that
    is not above the smallest of them is complete and leaves; then that run
    goes on to its next frame, so one frame per run is open at a time."""
    at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []
    left = [iter(r) for r in runs]

    def advance(r: int) -> None:
        data = next(left[r], None)
        if data is None:
            at.pop(r, None)
            return
        delta, counts = unpack(data)
        keys = np.cumsum(delta)
        at[r] = keys, counts
        heapq.heappush(heap, (int(keys[-1]), r))

    for r in range(len(runs)):
        advance(r)
    while heap:
        last = heap[0][0]
        keys, counts = [], []
        for r, (k, c) in list(at.items()):
            n = int(np.searchsorted(k, last, "right"))
            if n:
                keys.append(k[:n])
                counts.append(c[:n])
                at[r] = k[n:], c[n:]
        while heap and heap[0][0] == last:
            advance(heapq.heappop(heap)[1])
        yield add_up(np.concatenate(keys), np.concatenate(counts))


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Merger:
    """Counting runs of one radix; merged whenever ``FAN`` of them are held."""

    def __init__(self):
        self.runs: list[list[bytes]] = []

    def add(self, run: list[bytes]) -> None:
        self.runs.append(run)
        if len(self.runs) >= FAN:
            self.runs = [self.merged()]

    def merged(self) -> list[bytes]:
        return [f for keys, counts in merge_runs(self.runs) for f in frames(keys, counts)]


def stored(run: list[bytes]) -> bytes:
    return struct.pack(f"<I{len(run)}I", len(run), *map(len, run)) + b"".join(run)


def loaded(data: bytes) -> list[bytes]:
    n, = struct.unpack_from("<I", data)
    out, at = [], 4 + 4 * n
    for size in struct.unpack_from(f"<{n}I", data, 4):
        out.append(data[at:at + size])
        at += size
    return out


# ---- units ----------------------------------------------------------------

def _byte_of() -> dict[str, int]:
    """The byte-level alphabet.  Printable Latin-1 characters
    stand for their own byte, the others in order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _wide_space(data: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each position is white space
    beyond ASCII (fixed values: Unicode's White_Space)."""
    x, y, z = (data[np.maximum(p - k, 0)].astype(np.int32) for k in (3, 2, 1))
    two = (y == 0xC2) & ((z == 0x85) | (z == 0xA0))
    code = (x << 16) | (y << 8) | z
    three = ((code >= 0xE28080) & (code <= 0xE2808A)) | np.isin(code, [0xE19A80, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
    return two | three


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units of all texts, without the space in front,
    and the number of units per text.  An empty text has none."""
    p = np.flatnonzero(data == 0x20)
    text = np.searchsorted(offsets, p, "right") - 1
    inner = p > offsets[text]
    before = data[np.maximum(p - 1, 0)]
    solid = ((before > 0x20) & (before < 0x7F)) | ((before >= 0x80) & ~_wide_space(data, p))
    # a run of spaces that ends a text stays with the unit before it
    marks = np.flatnonzero(data != 0x20)
    nxt = np.searchsorted(marks, p)
    follows = np.where(nxt < len(marks), marks[np.minimum(nxt, len(marks) - 1)] if len(marks) else 0, len(data)) < offsets[text + 1]
    p = p[inner & solid & follows]
    full = np.flatnonzero(np.diff(offsets) > 0)
    starts = np.sort(np.concatenate([offsets[full], p + 1]))
    ends = np.sort(np.concatenate([offsets[full + 1], p]))
    per = np.diff(np.searchsorted(starts, offsets[:-1], "left"), append=len(starts))
    return starts, ends, per


class Units:
    """Alignment of every distinct unit, computed once."""

    def __init__(self, spec_a: str, spec_b: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(spec_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=spec_b)
        byte = _byte_of()
        vocab = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.bytes_a[i] = bytes(byte.get(c, 0) for c in t)
        self.bytes_b = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode()
                        for i, t in enumerate(map(self.b.id_to_piece, range(self.b.vocab_size())))]
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        # an id as text: first inside a group, then at the end of its side
        n, m = len(self.bytes_a), len(self.bytes_b)
        self.written = [f"{i}," for i in range(n)] + [f"{i}|" for i in range(n)] + [f"{i}," for i in range(m)] + [f"{i};" for i in range(m)]
        self.reset()

    def reset(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.text: list[str] = []
        self.sums = np.zeros((0, 5), np.int64)  # tokens of A and B, groups, links, uncovered
        self.links, self.edge = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def align(self, a: list[list[int]], b: list[list[int]], want: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Groups, sums and links of units whose ids in A and B are given and
        cover the same bytes.  On the concatenation of all units: every offset
        where a token of A or B ends closes one link, every offset where both
        end closes one group."""
        edge = np.concatenate([[0], np.cumsum(list(map(len, want)))])
        per = [np.array(list(map(len, x)), np.int64) for x in (a, b)]
        ids = [np.fromiter((i for x in y for i in x), np.int64, int(n.sum())) for y, n in zip((a, b), per)]
        ends = [np.cumsum(size[i]) for size, i in zip((self.size_a, self.size_b), ids)]
        either = np.union1d(*ends)
        both = np.intersect1d(*ends, assume_unique=True)
        at = [np.searchsorted(e, either) for e in ends]
        links = (ids[1][at[1]] << 32) | ids[0][at[0]]
        n_links, n_groups = (np.diff(np.searchsorted(x, edge, "right")) for x in (either, both))
        # texts of the tokens in group order, A before B
        group = [np.searchsorted(both, e) for e in ends]
        last = [e == both[g] for e, g in zip(ends, group)]
        n, m = len(self.bytes_a), len(self.bytes_b)
        code = np.concatenate([ids[0] + n * last[0], 2 * n + ids[1] + m * last[1]])
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        words = [self.written[c] for c in code[order].tolist()]
        stop = np.concatenate([[0], np.cumsum(per[0] + per[1])]).tolist()
        text = ["".join(words[i:j])[:-1] for i, j in zip(stop, stop[1:])]
        return text, np.stack([per[0], per[1], n_groups, n_links, np.zeros(len(a), np.int64)], axis=1), links

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        want = [(" " + t).encode() for t in texts]
        a = [x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        fine = np.array([b"".join([self.bytes_a[i] for i in x]) == w == b"".join([self.bytes_b[i] for i in y])
                         for x, y, w in zip(a, b, want)], bool)
        place = np.flatnonzero(fine).tolist()
        text, sums, links = self.align([a[i] for i in place], [b[i] for i in place], [want[i] for i in place])
        all_sums = np.zeros((len(texts), 5), np.int64)
        all_sums[:, 4] = 1  # not covered
        all_sums[fine] = sums
        all_text = [""] * len(texts)
        for i, t in zip(place, text):
            all_text[i] = t
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.slot = np.insert(self.slot, at, len(self.text) + np.arange(len(keys)))
        self.text += all_text
        self.sums = np.concatenate([self.sums, all_sums])
        self.edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum(all_sums[:, 3])])
        self.links = np.concatenate([self.links, links])

    def slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each unit occurrence in this store."""
        keys, sample, back = np.unique(B.hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > KEEP:
            self.reset()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            buf = data.tobytes()
            self.learn(keys[new], [buf[s:e].decode() for s, e in zip(starts[sample[new]], ends[sample[new]])])
        return self.slot[np.searchsorted(self.keys, keys)][back]


_UNITS: dict[int, Units] = {}


def _units(spec_a: str, spec_b: bytes) -> Units:
    key = zlib.crc32(spec_b, zlib.crc32(spec_a.encode()))
    if key not in _UNITS:
        _UNITS.clear()
        _UNITS[key] = Units(spec_a, spec_b)
    return _UNITS[key]


class Block:
    """The texts of one block: sums and groups per text, records per pair."""

    def __init__(self, store: Units, data: np.ndarray, offsets: np.ndarray):
        starts, ends, per = cut(data, offsets)
        slot = store.slots(data, starts, ends)
        n = len(per)
        self.store, self.edge = store, np.concatenate([[0], np.cumsum(per)])
        run = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(store.sums[slot], axis=0)])
        sums = run[self.edge[1:]] - run[self.edge[:-1]]
        self.fine = (sums[:, 4] == 0) & (per > 0)
        self.sums = np.where(self.fine[:, None], sums[:, :4], 0)
        self.slot = slot
        text = np.repeat(np.arange(n), per)
        keep = self.fine[text]
        # records: distinct units of a text, then their links, added up per (pair, text)
        used, unit = np.unique(slot[keep], return_inverse=True)
        both, times = np.unique(unit * max(1, n) + text[keep], return_counts=True)
        unit, text = np.divmod(both, max(1, n))
        size = (store.edge[used + 1] - store.edge[used])
        flat = store.links[_ranges(store.edge[used], size)]
        pairs, rank = np.unique(flat, return_inverse=True)
        place = np.lexsort((pairs, (pairs >> 32) & (RADIX - 1)))
        back = np.empty(len(place), np.int64)
        back[place] = np.arange(len(place))
        rank, pairs = back[rank], pairs[place]
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        index = rank[_ranges(begin[unit], size[unit])] * max(1, n) + np.repeat(text, size[unit])
        index, links = add_up(index, np.repeat(times, size[unit]))
        rank, doc = np.divmod(index, max(1, n))
        self.pairs, self.doc, self.links = pairs, doc.astype(np.uint32), links.astype(np.uint32)
        self.first = np.searchsorted(rank, np.arange(len(pairs) + 1))
        self.radix = np.searchsorted((pairs >> 32) & (RADIX - 1), np.arange(RADIX + 1))

    def groups(self) -> list[str]:
        text, edge, slot = self.store.text, self.edge.tolist(), self.slot.tolist()
        return [";".join([text[s] for s in slot[i:j]]) if ok else "" for i, j, ok in zip(edge, edge[1:], self.fine.tolist())]

    def runs(self) -> Iterator[tuple[int, list[bytes], int, bytes]]:
        """(radix, counting run, number of records, record run)."""
        for r in range(RADIX):
            i, j = self.radix[r], self.radix[r + 1]
            a, b = self.first[i], self.first[j]
            if i < j:
                total = np.add.reduceat(self.links[a:b].astype(np.int64), self.first[i:j] - a)
                yield r, frames(self.pairs[i:j], total), int(b - a), pack(
                    np.diff(self.pairs[i:j], prepend=0), np.diff(self.first[i:j + 1]).astype(np.uint32), self.doc[a:b], self.links[a:b])


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[k], begin[k] + 1, ... size[k] times, one after the other."""
    total = np.concatenate([[0], np.cumsum(size)])
    return np.arange(total[-1]) + np.repeat(begin - total[:-1], size)


# ---- Spark stages ----------------------------------------------------------

def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
    fields = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def _blocks(batches: Iterator[pa.RecordBatch], store: Units) -> Iterator[tuple[pa.Array, Block]]:
    for batch in batches:
        for i, j, data, offsets in B.chunks(*B.texts(batch.column(1)), limit=BLOCK_BYTES):
            yield batch.column(0).slice(i, j - i), Block(store, data, offsets)


def write_runs(docs: DataFrame, spec_a: str, spec_b: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stage 1: the runs of all blocks and the counts of all tasks."""
    shared = docs.sparkSession.sparkContext.broadcast((spec_a, spec_b))  # two vocabulary files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        heads: dict[int, Merger] = defaultdict(Merger)
        for k, (ids, block) in enumerate(_blocks(batches, _units(*shared.value))):
            number = (part << 32) | k
            sha = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in block.groups()]
            sums = [pa.array(block.sums[:, c]) for c in range(4)]
            names = [c.split()[0] for c in DOCS.split(", ")]
            table = pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *sums, pa.array(sha, pa.string())], names=names)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_batch(table)
            out = [(number, part, None, None, None, None, zstandard.ZstdCompressor(level=1).compress(sink.getvalue()))]
            for r, head, records, body in block.runs():
                heads[r].add(head)
                out.append((number, part, r, records, None, body, None))
            yield _rows(RUNS, out)
        for r, merger in heads.items():
            yield _rows(RUNS, [(None, part, r, None, stored(merger.merged()), None, None)])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return materialize(rows.mapInArrow(run, RUNS), "pair-runs")


def count_pairs(runs: DataFrame) -> DataFrame:
    """Stages 2 and 3: totals of all pairs by radix, maxima of a B id marked;
    ``totals`` packs pairs, counts and marks of consecutive pairs."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Merger]]:
        radix, merger = None, Merger()
        for batch in batches:
            for r, head in zip(batch.column("radix").to_pylist(), batch.column("head")):
                if r != radix:
                    if radix is not None:
                        yield radix, merger
                    radix, merger = r, Merger()
                merger.add(loaded(head.as_py()))
        if radix is not None:
            yield radix, merger

    def halfway(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for radix, merger in groups(batches):
            yield _rows("radix int, head binary", [(radix, stored(merger.merged()))])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for radix, merger in groups(batches):
            held, seq = (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0
            for keys, counts in merge_runs(merger.runs):
                keys, counts = np.concatenate([held[0], keys]), np.concatenate([held[1], counts])
                side = keys >> 32
                whole = int(np.searchsorted(side, side[-1]))  # the last B id may go on
                if whole >= FRAME:
                    yield _rows(TOTALS, [(radix, seq, _marked(keys[:whole], counts[:whole]))])
                    seq, keys, counts = seq + 1, keys[whole:], counts[whole:]
                held = keys, counts
            if len(held[0]):
                yield _rows(TOTALS, [(radix, seq, _marked(*held))])

    def by(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions("radix")

    heads = runs.where("head is not null").select("radix", "head", F.expr("part % 64").alias("part"))
    half = by(heads, "radix", "part").select("radix", "head").mapInArrow(halfway, "radix int, head binary")
    return materialize(by(half, "radix").mapInArrow(totals, TOTALS), "pair-totals")


def _marked(keys: np.ndarray, counts: np.ndarray) -> bytes:
    first = np.flatnonzero(np.diff(keys >> 32, prepend=-1))
    top = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(keys))))
    return pack(np.diff(keys, prepend=0), counts, (counts == top).astype(np.uint8))


def pairs(totals: DataFrame) -> DataFrame:
    """The corpus-wide lexicon: (b, a, links, best), ``best`` for the A ids
    that are linked most often with a B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                delta, counts, best = unpack(data.as_py())
                keys = np.cumsum(delta)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(counts),
                     pa.array(best.astype(bool))], names=["b", "a", "links", "best"])

    return totals.select("totals").mapInArrow(run, "b int, a int, links bigint, best boolean")


def stream_back(runs: DataFrame, totals: DataFrame) -> DataFrame:
    """Stage 4: what every run adds to the documents of its block."""
    body = runs.where("body is not null")
    size = body.agg(F.sum("records")).first()[0] or 0
    salts = max(1, math.ceil(3 * size / RADIX / GROUP_BYTES))
    nothing = F.lit(None)
    left = totals.select("radix", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "seq", "totals",
                         nothing.cast("bigint").alias("block"), nothing.cast("binary").alias("body"))
    right = body.select("radix", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"),
                        F.lit(2 ** 31 - 1).alias("seq"), nothing.cast("binary").alias("totals"), "block", "body")
    rows = left.unionByName(right).repartition(RADIX * salts, "radix", "salt").sortWithinPartitions("radix", "salt", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, keys, counts, best = None, [], None, None, None
        for batch in batches:
            out = []
            for k, key in enumerate(zip(batch.column("radix").to_pylist(), batch.column("salt").to_pylist())):
                if key != at:
                    at, parts, keys = key, [], None
                block = batch.column("block")[k].as_py()
                if block is None:
                    parts.append(unpack(batch.column("totals")[k].as_py()))
                    continue
                if keys is None:
                    keys = np.concatenate([np.cumsum(p[0]) for p in parts])
                    counts, best = (np.concatenate([p[c] for p in parts]) for c in (1, 2))
                    parts = []
                delta, per, doc, links = unpack(batch.column("body")[k].as_py())
                place = np.repeat(np.searchsorted(keys, np.cumsum(delta)), per)
                links = links.astype(np.int64)
                n = int(doc.max()) + 1
                tops, added = np.zeros(n, np.int64), np.zeros(n, np.int64)
                np.add.at(tops, doc, links * best[place])
                np.add.at(added, doc, links * counts[place])
                out.append((block, tops, added))
            if out:
                yield _rows(ADDED, out)

    return rows.mapInArrow(run, ADDED)


def align(docs: DataFrame, spec_a: str, spec_b: bytes, id_col: str = "doc_id",
          text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, totals): per document its sums of tokens, groups and links,
    the links whose pair is the commonest of its B id, the sum of its links'
    counts and the SHA-256 of its groups; and the totals that ``pairs`` reads."""
    runs = write_runs(docs, spec_a, spec_b, id_col, text_col)
    totals = count_pairs(runs)
    added = stream_back(runs, totals)
    nothing = F.lit(None)
    left = runs.where("docs is not null").select("block", F.lit(0).alias("kind"), "docs", nothing.cast("array<bigint>").alias("best"),
                                                 nothing.cast("array<bigint>").alias("added"))
    right = added.select("block", F.lit(1).alias("kind"), nothing.cast("binary").alias("docs"), "best", "added")
    rows = left.unionByName(right).repartition("block").sortWithinPartitions("block", "kind").drop("kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = best = added = None

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*held.columns, pa.array(best), pa.array(added)],
                                              names=[*held.schema.names, "n_best", "count_sum"])

        for batch in batches:
            for k in range(batch.num_rows):
                data = batch.column("docs")[k]
                if data.is_valid:
                    if held is not None:
                        yield close()
                    raw = zstandard.ZstdDecompressor().decompress(data.as_py())
                    held = pa.ipc.open_stream(raw).read_next_batch()
                    best, added = np.zeros(held.num_rows, np.int64), np.zeros(held.num_rows, np.int64)
                else:
                    for total, name in ((best, "best"), (added, "added")):
                        part = batch.column(name)[k].values.to_numpy()
                        total[:len(part)] += part
        if held is not None:
            yield close()

    return rows.mapInArrow(run, RESULT), totals


def groups(docs: DataFrame, spec_a: str, spec_b: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, groups): the aligned ids themselves, ``a1,a2|b1;a3|b2,b3``."""
    shared = docs.sparkSession.sparkContext.broadcast((spec_a, spec_b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in _blocks(batches, _units(*shared.value)):
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(block.groups(), pa.string())], names=["doc_id", "groups"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return rows.mapInArrow(run, "doc_id bigint, groups string")
