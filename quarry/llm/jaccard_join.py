"""N-gram Jaccard self join as a blocked sparse matrix product.

A document is a row of a sparse 0/1 matrix whose columns are 64-bit hashes of
its distinct five-word shingles.  Two documents link when
``100 * |x & y| >= percent * |x | y|``.

1. Rows with equal sets are one *class*; the class id is a hash of the set.
2. Columns are put in one global order, rare ones first.  The frequency of a
   column is counted over all texts (counts of at least two inside a task, so
   that only repeated shingles are moved).  Any order gives right results; it
   decides only how much work is left.
3. A linked pair must meet in the first ``n - ceil(percent * n) + 1`` columns
   of both rows.  These entries are split into column blocks of bounded size;
   each block is sorted in one task and keeps the columns with two or more
   classes.  A column repeated inside a map batch is forwarded once, so a
   column shared by a third of all documents does not fill a block.
4. First product: every class with ``LEADS`` classes of each of its columns.
   Pairs are verified on their whole sets and joined into components.
5. Second product, exact: columns whose classes already are in one component
   are done.  In every other column each class outside the lead's component is
   paired with all classes of other components; overlap counts are summed
   over blocks, and pairs are discarded when the sizes, the entries that meet
   no other class, or ``count + what can follow the last common column`` cannot
   reach the needed overlap.  The rest is verified on whole sets.

So no link between different components is lost, while a group of near copies
costs pairs in proportion to its size.

Edge cases: null or word-less text has an empty set and links with nothing; a
null id stays in the result with its class; repeated rows and repeated ids are
rows of their own; a component's id is the smallest non-null document id in it;
extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import bytewords as B
from quarry.llm.graph import components
from quarry.llm.temp import discard
from quarry.session import materialize

SHINGLE = 5
PERCENT = 75
ORDERED = 400_000        # most columns that carry a frequency in the column order
LEADS = 4                # classes per column that start the components
COUNTED = 800_000        # shingles counted at once in a task
BLOCK = 400_000          # matrix entries of a column block
BROADCAST_IDS = 1_000_000
_P = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    low = B.LOWER[data]
    starts, ends, per = B.spans(low, offsets, B.NOT_SPACE)
    w = B.hashes(low, starts, ends)
    edge = np.concatenate([[0], np.cumsum(per)])
    if len(w) >= k:
        h = w[:len(w) - k + 1].copy()
        for i in range(1, k):
            h = h * _P + w[i:len(w) - k + 1 + i]
        h = B.mix(h)
    for d in range(len(per)):
        a, b = edge[d], edge[d + 1]
        if b - a >= k:
            s = np.sort(h[a:b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif b > a:
            v = np.array([b - a], np.uint64)
            for i in range(a, b):
                v = v * _P + w[i:i + 1]
            yield B.mix(v)
        else:
            yield np.zeros(0, np.uint64)


def class_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def frequent_columns(docs: DataFrame, k: int = SHINGLE, most: int = ORDERED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the most frequent shingles, at most
    ``most``: a bounded table that only fixes the column order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def close() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            m = n > 1
            return pa.RecordBatch.from_arrays([pa.array(keys[m].view(np.int64)), pa.array(n[m].astype(np.int64))],
                                              names=["h", "c"])

        for batch in batches:
            for _, _, data, offsets in B.chunks(*B.texts(batch.column(0))):
                for s in shingle_sets(data, offsets, k):
                    c = class_id(s)
                    if len(s) and c not in seen:
                        seen.add(c)
                        held.append(s)
                        size += len(s)
                    if size >= COUNTED:
                        yield close()
                        held, size, seen = [], 0, set()
        if held:
            yield close()

    counts = materialize(docs.mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")), "columns")
    # smallest count from which on at most ``most`` columns remain
    total, floor = 0, None
    for row in counts.groupBy("c").count().orderBy(F.desc("c")).toLocalIterator():
        total += row["count"]
        if total > most:
            break
        floor = row["c"]
    if floor is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    t = counts.where(F.col("c") >= floor).toArrow()  # at most ``most`` rows
    discard(counts)
    h = np.asarray(t["h"].combine_chunks()).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.asarray(t["c"].combine_chunks())[order]


def matrix_rows(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Written table (doc_id, n, cid, last_f, last_h, prefix): set size, class
    id, the place of the last prefix column in the column order, and the first
    columns of the row; the prefix is given once per class and task."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(frequent_columns(docs.select("_text"), k))  # at most ORDERED entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, freq = order.value
        maybe = np.zeros(1 << 22, bool)
        maybe[(keys >> np.uint64(42)).astype(np.int64)] = True
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, offsets in B.chunks(*B.texts(batch.column(1))):
                n, cid, parts, lens, last_f, last_h = [], [], [], [], [], []
                for s in shingle_sets(data, offsets, k):
                    n.append(len(s))
                    c = class_id(s) if len(s) else None
                    cid.append(c)
                    if c is None or c in seen:
                        lens.append(0)
                        last_f.append(None)
                        last_h.append(None)
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(c)
                    p = len(s) - (percent * len(s) + 99) // 100 + 1
                    hot = np.flatnonzero(maybe[(s >> np.uint64(42)).astype(np.int64)])
                    count = np.zeros(len(s), np.int64)
                    if len(hot):
                        at = np.minimum(np.searchsorted(keys, s[hot]), len(keys) - 1)
                        true = keys[at] == s[hot]
                        hot, f = hot[true], freq[at[true]]
                        cold = np.ones(len(s), bool)
                        cold[hot] = False
                        by = np.lexsort((s[hot], f))
                        s = np.concatenate([s[cold], s[hot][by]])
                        count[len(s) - len(hot):] = f[by]
                    parts.append(s[:p])
                    lens.append(p)
                    last_f.append(int(count[p - 1]))
                    last_h.append(int(s[p - 1]) - (1 << 63))  # keeps the order of the hashes
                flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
                off = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(n, pa.int32()), pa.array(cid, pa.int64()), pa.array(last_f, pa.int64()),
                     pa.array(last_h, pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))],
                    names=["doc_id", "n", "cid", "last_f", "last_h", "prefix"])

    return materialize(docs.select("_id", "_text").mapInArrow(
        run, "doc_id bigint, n int, cid bigint, last_f bigint, last_h bigint, prefix array<bigint>"), "matrix")


def _pack(h, d, p, f, cid, n) -> bytes:
    head = np.array([len(h), len(cid)], "<u4").tobytes()
    return b"".join([head, h.tobytes(), cid.tobytes(), n.tobytes(), d.tobytes(), p.tobytes(), f.tobytes()])


def _unpack(raw: bytes):
    e, d = np.frombuffer(raw, "<u4", 2)
    at = 8
    out = []
    for dtype, count in (("<u8", e), ("<i8", d), ("<i4", d), ("<u2", e), ("<u2", e), ("u1", e)):
        a = np.frombuffer(raw, dtype, count, at)
        at += a.nbytes
        out.append(a)
    h, cid, n, doc, p, f = out
    return h, cid[doc], n[doc], p.astype(np.int32), f


ENTRY = "h bigint, cid bigint, n int, pos int"


def _entries(h, cid, n, pos) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(cid.astype(np.int64)),
                                       pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32))],
                                      names=["h", "cid", "n", "pos"])


def shared_columns(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Written table (h, cid, n, pos, miss, last): the prefix entries whose
    column holds two or more classes, with the number of entries of the same
    prefix that meet no other class and the place of its last column."""
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.size("prefix"))).first()[0] or 0
    blocks = int(max(-(-total // BLOCK), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    step = (1 << 64) // blocks + 1
    bounds = np.array([min(i * step, (1 << 64) - 1) for i in range(blocks + 1)], np.uint64)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 60_000):  # row numbers fit 16 bits
                batch = whole.slice(first, 60_000)
                _, one = np.unique(np.asarray(batch.column(0)), return_index=True)
                batch = batch.take(pa.array(one))
                col = batch.column(2)
                h = np.asarray(col.flatten()).view(np.uint64)
                lens = np.asarray(col.value_lengths()).astype(np.int64)
                cid, n = np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(np.int32)
                doc = np.repeat(np.arange(len(lens), dtype=np.uint16), lens)
                ends = np.cumsum(lens)
                pos = np.minimum(np.arange(len(h)) - np.repeat(ends - lens, lens), 65_535).astype(np.uint16)
                order = np.argsort(h, kind="stable")
                h, doc, pos = h[order], doc[order], pos[order]
                head = np.ones(len(h), bool)
                head[1:] = h[1:] != h[:-1]
                again = np.zeros(len(h), bool)
                at = np.flatnonzero(head)
                again[at] = np.diff(np.append(at, len(h))) > 1
                names = ["block", "data"]
                rest = ~head
                if rest.any():  # repeated here: kept at once, its first entry travels for all
                    raw = _pack(h[rest], doc[rest], pos[rest], np.ones(int(rest.sum()), np.uint8), cid, n)
                    mine = blocks + int(cid[0]) % blocks
                    yield pa.RecordBatch.from_arrays([pa.array([mine], pa.int32()), pa.array([raw], pa.binary())], names)
                h, doc, pos, again = h[head], doc[head], pos[head], again[head]
                cutpoints = np.searchsorted(h, bounds)
                cutpoints[-1] = len(h)
                ks, raws = [], []
                for k in range(blocks):
                    i, j = cutpoints[k], cutpoints[k + 1]
                    if i < j:
                        used, local = np.unique(doc[i:j], return_inverse=True)
                        ks.append(k)
                        raws.append(_pack(h[i:j], local.astype(np.uint16), pos[i:j], again[i:j].astype(np.uint8),
                                          cid[used], n[used]))
                if ks:
                    yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(raws, pa.binary())], names)

    def block(t: pa.Table) -> pa.Table:
        if not len(t):
            return pa.Table.from_batches([_entries(*(np.zeros(0, np.uint64),) * 4)])
        parts = [_unpack(raw.as_buffer()) for c in t["data"].chunks for raw in c]  # views, not copies
        h, cid, n, pos, again = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.lexsort((cid, h))
        h, cid, n, pos, again = h[order], cid[order], n[order], pos[order], again[order].astype(bool)
        head = np.ones(len(h), bool)
        head[1:] = h[1:] != h[:-1]
        run = np.cumsum(head) - 1
        at = np.flatnonzero(head)
        last = np.append(at[1:], len(h)) - 1
        # of all copies of an entry, as any of them may stand for others
        keep = (cid[at] != cid[last]) | np.logical_or.reduceat(again, at)
        one = head.copy()
        one[1:] |= cid[1:] != cid[:-1]  # a class may come from several tasks
        keep = keep[run] & one
        B.release()
        return pa.Table.from_batches([_entries(h[keep], cid[keep], n[keep], pos[keep])])

    met = (rows.where(F.size("prefix") > 0).select("cid", "n", "prefix").mapInArrow(split, "block int, data binary")
           .groupBy("block").applyInArrow(block, ENTRY))
    # an entry can still come twice, from two batches; that only loosens bounds
    met = materialize(met, "incidence")
    mine = met.groupBy("cid").agg(F.count(F.lit(1)).alias("m"))
    last = rows.where(F.size("prefix") > 0).groupBy("cid").agg(
        F.max("n").alias("n"), F.struct(F.max("last_f").alias("f"), F.max("last_h").alias("h")).alias("last"))
    p = F.col("n") - F.ceil(percent * F.col("n") / 100.0).cast("int") + 1
    mine = materialize(mine.join(last, "cid").select("cid", F.greatest(p - F.col("m"), F.lit(0)).cast("int").alias("miss"), "last"),
                       "misses")
    out = materialize(met.join(_small(mine), "cid"), "incidence")
    discard(met)
    return out


def _small(t: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """Marked for broadcast when it is counted small; else left to a shuffle."""
    return F.broadcast(t) if t.count() <= most else t


def _sizes_allow(x: str, y: str, percent: int):
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _needed(x: str, y: str, percent: int):
    """The overlap that two sets of these sizes need."""
    return F.expr(f"({percent}L * ({x} + {y}) + {99 + percent}) div {100 + percent}")


def verify(docs: DataFrame, rows: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link, with their overlap (written).

    Sets are made from the texts again.  The top 16 bits of the hashes, a
    quarter of the bytes, bound the overlap from above; only pairs that this
    bound lets through meet with their full sets."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    heads = materialize(rows.join(ends, "cid").groupBy("cid").agg(F.min("doc_id").alias("_head")), "heads")
    ids = heads.select(F.col("_head")).distinct()
    if heads.count() <= BROADCAST_IDS:  # 8 bytes a row; else a shuffled join
        ids = F.broadcast(ids)
    found = docs.join(ids, F.col("_id").eqNullSafe(F.col("_head")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in B.chunks(*B.texts(batch.column(0))):
                sets = [s for s in shingle_sets(data, offsets, k) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([class_id(s) for s in sets], pa.int64()),
                     pa.array([(s >> np.uint64(48)).astype(np.uint16).tobytes() for s in sets], pa.binary()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], names=["c", "top", "full"])

    sets = materialize(found.select("_text").mapInArrow(run, "c bigint, top binary, full binary"), "sets")

    def meet(these: DataFrame, col: str, overlap) -> DataFrame:
        """Pairs whose sets (or bounds of them) reach the needed overlap."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, common = [], [], []
                for i, j, x, y in zip(*(batch.column(c) for c in range(4))):
                    n, m, o = overlap(x.as_py(), y.as_py())
                    if 100 * o >= percent * (n + m - o):
                        a.append(i.as_py())
                        b.append(j.as_py())
                        common.append(o)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                                  pa.array(common, pa.int32())], names=["a", "b", "overlap"])

        left, right = (sets.select(F.col("c").alias(e), F.col(col).alias(f"s{e}")) for e in "ab")
        j = these.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
        return materialize(j.mapInArrow(run, "a bigint, b bigint, overlap int").dropDuplicates(["a", "b"]), "links")

    def bound(x: bytes, y: bytes) -> tuple[int, int, int]:
        x, y = np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)
        seen = np.zeros(1 << 16, bool)
        seen[y] = True
        return len(x), len(y), min(int(seen[x].sum()), len(y))

    def exact(x: bytes, y: bytes) -> tuple[int, int, int]:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        return len(x), len(y), int((y[at] == x).sum())

    likely = meet(pairs, "top", bound)
    left = likely.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    if likely.count() <= BROADCAST_IDS // 2:
        left = F.broadcast(left)
    whole = sets
    sets = whole.join(left, "c", "left_semi")
    out = meet(likely, "full", exact)
    for t in (whole, likely, heads):
        discard(t)
    return out


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
         percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has one row per document (doc_id, n_shingles,
    cid, root) where ``root`` names the component; links has verified pairs of
    classes that connect all components."""
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = matrix_rows(docs, k, percent)
    inc = shared_columns(rows, percent)

    # a start: each class with the classes of its columns that have the fewest
    # entries of their own, such as the origin of a group of near copies
    own = (F.col("miss") / F.col("n")).alias("own")
    pick = Window.partitionBy("h").orderBy(own, "cid")
    lead = inc.withColumn("k", F.row_number().over(pick)).where(F.col("k") <= LEADS).select(
        "h", F.col("cid").alias("a"), F.col("n").alias("na"))
    near = (inc.join(lead, "h").where(F.col("cid") != F.col("a")).where(_sizes_allow("n", "na", percent))
            .groupBy(F.least("a", "cid").alias("a"), F.greatest("a", "cid").alias("b"))
            .agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n")))
    # pairs with little in common wait for the exact product
    near = materialize(near.where(F.col("c") * 16 >= F.col("n")), "pairs")
    links = verify(docs, rows, near, k, percent)
    discard(near)
    label = components(links)

    tagged = inc.join(_small(label), F.col("cid") == F.col("node"), "left").withColumn("lab", F.coalesce("root", "cid"))
    mixed = tagged.groupBy("h").agg(F.min("lab").alias("l0"), F.max("lab").alias("l1"),
                                    F.min_by("lab", F.struct(own, "cid")).alias("top")).where("l0 < l1")
    open_ = materialize(tagged.join(mixed.select("h", "top"), "h").drop("node", "root"), "open")
    names = ("cid", "n", "pos", "miss", "last", "lab")
    x = open_.where("lab <> top").select("h", *(F.col(c).alias(f"x{c}") for c in names))
    y = open_.select("h", "top", *(F.col(c).alias(f"y{c}") for c in names))
    # The prefix whose last column comes first in the order: what it has there
    # and the other row has too is in the other's prefix, so its entries that
    # meet no other class are not in the other row.
    early = F.col("xlast") <= F.col("ylast")
    reach = F.when(early, F.col("xn") - F.col("xmiss")).otherwise(F.col("yn") - F.col("ymiss"))
    cand = (x.join(y, "h").where("xlab <> ylab and (ylab = top or xcid < ycid)").where(_sizes_allow("xn", "yn", percent))
            .where(reach >= _needed("xn", "yn", percent))
            # sets that share enough meet before ``size - needed`` in both rows;
            # a common column that is later in either is later in both
            .where(F.col("xpos") <= F.col("xn") - _needed("xn", "yn", percent))
            .where(F.col("ypos") <= F.col("yn") - _needed("xn", "yn", percent)))
    forth = F.col("xcid") < F.col("ycid")
    cand = cand.select(*(F.when(forth, F.col(f"x{c}")).otherwise(F.col(f"y{c}")).alias(f"a{c}") for c in ("cid", "n", "pos")),
                       *(F.when(forth, F.col(f"y{c}")).otherwise(F.col(f"x{c}")).alias(f"b{c}") for c in ("cid", "n", "pos")))
    cand = cand.groupBy(F.col("acid").alias("a"), F.col("bcid").alias("b")).agg(
        F.count(F.lit(1)).alias("c"), F.max("an").alias("na"), F.max("bn").alias("nb"), F.max("apos").alias("pa"),
        F.max("bpos").alias("pb"))
    behind = F.least(F.col("na") - 1 - F.col("pa"), F.col("nb") - 1 - F.col("pb"))
    cand = materialize(cand.where(F.col("c") + behind >= _needed("na", "nb", percent)), "pairs")
    links2 = verify(docs, rows, cand, k, percent)
    for t in (inc, open_, cand):
        discard(t)
    links = links.unionByName(links2)
    final = components(label.select(F.col("node").alias("a"), F.col("root").alias("b"))
                       .union(links2.select("a", "b")))
    members = rows.select("doc_id", "n", "cid").join(final, F.col("cid") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "cid", F.coalesce("root", "cid").alias("root"))
    return members, links


def component_ids(members: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    small = members.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return (members.join(small, "root", "left")
            .select("doc_id", F.col("n_shingles").cast("long"),
                    F.coalesce("component_id", "doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row
    with the smallest id stays (null ids last); rows with an empty set stay.

    Usually this is an anti join with the ids of the rows that go.  Rows whose
    id is null or repeated are told apart by their class id."""
    members = materialize(join(docs, id_col, text_col, k, percent)[0], "members")
    full = members.where("root is not null")
    best = full.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cid")).alias("b"))
    best = materialize(best.select("root", F.col("b.doc_id").alias("kid"), F.col("b.cid").alias("kcid")), "kept")
    unclear = members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select("doc_id")
    gone = full.join(best, "root").where(~F.col("doc_id").eqNullSafe(F.col("kid"))).select("doc_id")
    unclear, out = materialize(unclear, "unclear"), materialize(gone, "gone")
    out = materialize(out.union(unclear).distinct(), "gone").withColumnRenamed("doc_id", "_gone")
    key = F.col(f"`{id_col}`").cast("long")
    small = F.broadcast(out) if out.count() <= BROADCAST_IDS else out  # 8 bytes a row; else a shuffled join
    kept = docs.join(small, key.eqNullSafe(F.col("_gone")), "left_anti")
    if unclear.isEmpty():
        return kept
    rows = docs.join(unclear.withColumnRenamed("doc_id", "_gone"), key.eqNullSafe(F.col("_gone")), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = rows.select(F.struct(*columns).alias("row"), key.alias("_id"), F.col(f"`{text_col}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in B.chunks(*B.texts(batch.column(2))):
                cid = [class_id(s) if len(s) else None for s in shingle_sets(data, offsets, k)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                                                  pa.array(cid, pa.int64())], names=["row", "_id", "cid"])

    shape = T.StructType([T.StructField("row", docs.schema), T.StructField("_id", T.LongType()),
                          T.StructField("cid", T.LongType())])
    tagged = rows.mapInArrow(run, shape)
    first = (tagged.join(best, (F.col("cid") == F.col("kcid")) & F.col("_id").eqNullSafe(F.col("kid")))
             .groupBy("cid").agg(F.first("row").alias("row")))
    rest = first.select("row.*").union(tagged.where("cid is null").select("row.*"))
    return kept.select(*columns).union(rest)
