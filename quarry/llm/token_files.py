"""Token ids in binary files coded with a static range asymmetric numeral system.

Texts are encoded in ascending document order.  Each task gathers ids into
*segments* (at most ``SEGMENT`` ids, then closed after a whole document) and
writes one file image per segment:

* one frequency table, shared by all blocks of the segment;
* independent blocks of ``STEPS * LANES`` ids; in a block the ids go round
  ``LANES`` interleaved 64-bit coder states that share one stream of 32-bit
  words;
* checkpoints (states and stream offset) every ``CHECK`` steps, so that blocks
  and the parts between checkpoints decode in parallel;
* a CRC-32 of every block's stream and one of the header.

The images are rows of a Parquet table written by Spark's committer, so a lost
executor only repeats its own tasks.  Memory is bounded by the segment size and
the longest single document.

Edge cases: a null or empty text gives the end id alone; repeated rows and equal
ids are kept, ordered by text; a null id sorts first; extra columns are ignored;
an empty table gives no file and no row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import bytewords as B
from quarry.session import materialize

LANES, STEPS, CHECK = 64, 1024, 256
SEGMENT = 1 << 20
_LOW = np.uint64(1 << 31)
_W = np.uint64(32)
MAGIC = b"RNS1"
_HEAD = struct.Struct("<4sIIIIIQQIII")


# ---- the coder -----------------------------------------------------------

def quantise(counts: np.ndarray, bits: int) -> np.ndarray:
    """Positive integer frequencies that sum to 2**bits."""
    total = int(counts.sum())
    f = np.maximum(1, np.rint(counts.astype(np.float64) * ((1 << bits) / total))).astype(np.int64)
    extra = int(f.sum()) - (1 << bits)
    order = np.argsort(-f, kind="stable")
    k = 0
    while extra:
        j = order[k % len(order)]
        step = -1 if extra < 0 else (1 if f[j] > 1 else 0)
        if step:
            take = min(abs(extra), max(1, int(f[j]) // 8) if step > 0 else abs(extra))
            take = min(take, int(f[j]) - 1) if step > 0 else take
            f[j] -= step * take
            extra -= step * take
        k += 1
    return f


def encode_segment(ids: np.ndarray, doc_ids: np.ndarray, null_ids: np.ndarray, doc_lens: np.ndarray) -> bytes:
    """One file image from the ids of whole documents."""
    ids = ids.astype(np.uint32, copy=False)
    n = len(ids)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    bits = max(16, int(np.ceil(np.log2(max(2, len(symbols))))) + 2)
    freq = quantise(counts[symbols], bits)
    dense = np.zeros(len(counts), np.uint32)
    dense[symbols] = np.arange(len(symbols), dtype=np.uint32)
    per = LANES * STEPS
    blocks = -(-n // per)
    pad = np.full(blocks * per, int(np.argmax(freq)), np.uint32)
    pad[:n] = dense[ids]
    sym = pad.reshape(blocks, STEPS, LANES)
    f64 = freq.astype(np.uint64)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    top = f64 << np.uint64(63 - bits)
    words = np.zeros((blocks, STEPS, LANES), np.uint32)
    out = np.zeros((blocks, STEPS, LANES), bool)
    x = np.full((blocks, LANES), _LOW, np.uint64)
    states = np.zeros((blocks, STEPS // CHECK, LANES), np.uint64)
    for t in range(STEPS - 1, -1, -1):
        s = sym[:, t]
        emit = x >= top[s]
        words[:, t] = x.astype(np.uint32)
        out[:, t] = emit
        x = np.where(emit, x >> _W, x)
        f = f64[s]
        q = x // f
        x = (q << np.uint64(bits)) + (x - q * f) + cum[s]
        if t % CHECK == 0:
            states[:, t // CHECK] = x
    per_step = out.sum(axis=2)
    before = np.concatenate([np.zeros((blocks, 1), np.int64), np.cumsum(per_step, axis=1)[:, :-1]], axis=1)
    offsets = before[:, ::CHECK].astype("<u4")
    streams = [words[b][out[b]].astype("<u4").tobytes() for b in range(blocks)]
    sizes = np.array([len(s) // 4 for s in streams], "<u4")
    crcs = np.array([zlib.crc32(s) for s in streams], "<u4")
    body = b"".join([symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes(),
                     null_ids.astype("u1").tobytes(), doc_lens.astype("<u8").tobytes(), sizes.tobytes(),
                     crcs.tobytes(), offsets.tobytes(), states.astype("<u8").tobytes()])
    head = _HEAD.pack(MAGIC, bits, LANES, STEPS, CHECK, len(symbols), n, len(doc_ids), blocks, len(body),
                      zlib.crc32(body))
    return b"".join([head, body, *streams])


def decode_segment(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, doc_ids, null_ids, doc_lens) of a file image; raises on damage.
    All blocks, and all parts between checkpoints, are decoded side by side."""
    magic, bits, lanes, steps, check, n_sym, n, n_docs, blocks, size, crc = _HEAD.unpack_from(image)
    at = _HEAD.size
    if magic != MAGIC or zlib.crc32(image[at:at + size]) != crc:
        raise ValueError("damaged token file header")

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        a = np.frombuffer(image, dtype, count, at)
        at += a.nbytes
        return a

    symbols, freq = take("<u4", n_sym), take("<u4", n_sym)
    doc_ids, null_ids, doc_lens = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    parts = steps // check
    sizes, crcs = take("<u4", blocks), take("<u4", blocks)
    offsets = take("<u4", blocks * parts).reshape(blocks, parts)
    states = take("<u8", blocks * parts * lanes)
    ends = np.cumsum(sizes.astype(np.int64))
    begins = ends - sizes
    for b in range(blocks):
        if zlib.crc32(image[at + 4 * begins[b]:at + 4 * ends[b]]) != crcs[b]:
            raise ValueError(f"damaged block {b}")
    stream = np.concatenate([take("<u4", int(ends[-1]) if blocks else 0), np.zeros(1, np.uint32)])
    slot_sym = np.repeat(np.arange(n_sym, dtype=np.uint32), freq)
    f64 = freq.astype(np.uint64)
    bias = np.concatenate([[0], np.cumsum(freq.astype(np.int64))[:-1]]).astype(np.uint64)
    x = states.reshape(blocks * parts, lanes).astype(np.uint64)
    ptr = (begins[:, None] + offsets).reshape(-1).astype(np.int64)
    out = np.empty((blocks * parts, check, lanes), np.uint32)
    low, sh = np.uint64((1 << bits) - 1), np.uint64(bits)
    for t in range(check):
        slot = x & low
        s = slot_sym[slot]
        out[:, t] = s
        x = f64[s] * (x >> sh) + slot - bias[s]
        need = x < _LOW
        rank = np.cumsum(need, axis=1)
        word = stream[np.minimum(ptr[:, None] + rank - 1, len(stream) - 1)].astype(np.uint64)
        x = np.where(need, (x << _W) | word, x)
        ptr += rank[:, -1]
    return symbols[out.reshape(-1)[:n]], doc_ids, null_ids, doc_lens


# ---- text to ids ---------------------------------------------------------

_ALPHA = B.table((0x41, 0x5A), (0x61, 0x7A))
_MARK = B.table((0x21, 0x26), (0x28, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


class WordEncoder:
    """Encodes texts word by word with a public tokenizer.

    The tokenizer never merges across ASCII white space, nor between an ASCII
    letter and an ASCII mark or digit other than the apostrophe, so the ids of
    a text are the ids of these pieces in a row.  Ids of each distinct piece
    come from the library once and are kept by 64-bit hash in flat arrays; when
    over ``keep`` pieces are held the store starts anew.  A text that spells an
    added token (``<|``) goes to the library whole.
    """

    def __init__(self, spec: str, keep: int = 600_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.keep = keep
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        enc = self.tok.encode_batch_fast(words, add_special_tokens=False)
        ids = [e.ids for e in enc]
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(count.sum()))
        first = len(self.flat) + np.concatenate([[0], np.cumsum(count, dtype=np.int64)[:-1]])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.first = np.insert(self.first, at, first)
        self.count = np.insert(self.count, at, count)
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids per text."""
        raw = data
        data = B.LOWER[raw]
        m, a = _MARK[data], _ALPHA[data]
        cut = np.flatnonzero((a[:-1] & m[1:]) | (m[:-1] & a[1:])) + 1
        starts, ends, per = B.spans(data, offsets, B.NOT_SPACE, cut)
        h = B.hashes(data, starts, ends)
        keys, sample, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > self.keep:
            self.reset()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != keys
        if new.any():
            buf = data.tobytes()
            words = [buf[s:e].decode("utf-8", "replace") for s, e in zip(starts[sample[new]], ends[sample[new]])]
            self._learn(keys[new], words)
            at = np.searchsorted(self.keys, keys)
        first, count = self.first[at][back], self.count[at][back].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        index = np.arange(total[-1]) - np.repeat(total[:-1] - first, count)
        flat = self.flat[index]
        edge = np.concatenate([[0], np.cumsum(per)])
        n = total[edge[1:]] - total[edge[:-1]]
        lt = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C)) if len(raw) > 1 else np.zeros(0, int)
        if len(lt):
            docs = set((np.searchsorted(offsets, lt, side="right") - 1).tolist())
            pieces, at_id = [], np.concatenate([[0], np.cumsum(n)])
            for i in range(len(n)):
                if i in docs:
                    text = raw[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace")
                    p = np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
                else:
                    p = flat[at_id[i]:at_id[i + 1]]
                pieces.append(p)
            n = np.array([len(p) for p in pieces], np.int64)
            flat = np.concatenate(pieces) if pieces else flat
        return flat, n


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(spec: str) -> WordEncoder:
    key = f"{len(spec)}:{zlib.crc32(spec.encode())}"
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(spec)
    return _ENCODERS[key]


def with_end(flat: np.ndarray, n: np.ndarray, end_id: int) -> np.ndarray:
    """The ids with ``end_id`` after every document."""
    return np.insert(flat, np.cumsum(n), end_id).astype(np.uint32)


# ---- Spark ---------------------------------------------------------------

FILES = "part int, segment int, n_tokens bigint, image binary"
DIGEST = "part int, segment int, seq int, doc_id bigint, first bigint, n_tokens bigint, ids_crc32 bigint"


def write_files(docs: DataFrame, spec: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all documents in ascending id order and write the file images;
    returns the written table (part, segment, n_tokens, image)."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value)
        part, segment = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, segment
            ids, doc, nul, lens = (np.concatenate([h[k] for h in held]) for k in range(4))
            image = encode_segment(ids, doc, nul, lens)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int32()),
                                              pa.array([len(ids)], pa.int64()), pa.array([image], pa.binary())],
                                             names=["part", "segment", "n_tokens", "image"])
            held, size, segment = [], 0, segment + 1
            return row

        for batch in batches:
            ids_col = batch.column(0)
            nul = np.asarray(ids_col.is_null())
            doc = np.asarray(ids_col.fill_null(0)).astype(np.int64)
            for i, j, data, offsets in B.chunks(*B.texts(batch.column(1))):
                flat, n = enc.encode(data, offsets)
                held.append((with_end(flat, n, end_id), doc[i:j], nul[i:j], n + 1))
                size += len(held[-1][0])
                if size >= SEGMENT:
                    yield close()
        if held:
            yield close()

    keys = [F.col("_id"), F.xxhash64("_text")]
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions("_id", "_text")
    return materialize(ordered.mapInArrow(run, FILES), "token-files")


def read_digests(files: DataFrame) -> DataFrame:
    """Decode the files: per document its id, the number of ids of all
    documents before it, its number of ids and their CRC-32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, image in zip(batch.column(0), batch.column(1), batch.column(2)):
                ids, doc, nul, lens = decode_segment(image.as_py())
                ends = np.cumsum(lens.astype(np.int64))
                begins = ends - lens.astype(np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                k = len(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, part.as_py(), np.int32)), pa.array(np.full(k, segment.as_py(), np.int32)),
                     pa.array(np.arange(k, dtype=np.int32)), pa.array(doc, mask=nul.astype(bool)), pa.array(begins),
                     pa.array(lens.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["part", "segment", "seq", "doc_id", "first", "n_tokens", "ids_crc32"])

    docs = files.select("part", "segment", "image").mapInArrow(run, DIGEST)
    # one row per file: narrow, a few million rows even for 10^13 ids
    before = files.select("part", "segment", F.coalesce(
        F.sum("n_tokens").over(Window.orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_before"))
    return docs.join(before, ["part", "segment"]).select(
        "doc_id", (F.col("_before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(files: DataFrame) -> DataFrame:
    """Decode the files back to (doc_id, ids) with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image in batch.column(0):
                ids, doc, nul, lens = decode_segment(image.as_py())
                off = np.concatenate([[0], np.cumsum(lens.astype(np.int64))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, mask=nul.astype(bool)),
                     pa.ListArray.from_arrays(pa.array(off), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return files.select("image").mapInArrow(run, "doc_id bigint, ids array<int>")
