"""Language identification with a linear-chain conditional random field.

Every word of a text is labelled: affix, byte n-gram and lexicon (whole word)
features are hashed into one weight table, and learned transition weights tie
neighbouring words, so code-switched text gets its own labels.  Marginals come
from forward-backward; a document's language is the label with the largest
share of its words.

Training.  A bounded sample of labelled documents (``TRAIN_DOCS`` per label, by
hash of the id) is cut into lines, lines of different documents are chained so
that switches occur, and the chains are dealt to ``SHARDS`` groups.  Every
round each group takes ``STEPS`` adaptive gradient steps from the common
weights and the driver averages the results (weights only: ``2**BITS`` x labels).

Sequences are whole lines.  Those of a chunk advance side by side in pieces of
``PIECE`` words; what a piece does to the message that enters it is one matrix, and
the matrices of a line's pieces, multiplied in order, give every piece the messages
from both its sides, so the marginals are those of the uncut line.

Edge cases: null or letterless text gives label ``und`` and score 0, and so
does a table with no labelled training text; ties go to the label that sorts
first; repeated rows are rows of their own; other columns are carried only when
asked for, inside a struct, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import bytewords as B

BITS = 18
TRAIN_DOCS = 500
SHARDS, ROUNDS, STEPS, RATE = 6, 2, 16, 0.4
PIECE = 256  # decides the work, not the result
UNKNOWN = "und"
_WORD = B.table((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_SALT = {k: B.mix(np.array([k + 1], np.uint64))[0] for k in range(12)}


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray   # (2**BITS, labels)
    moves: np.ndarray     # (labels, labels) transition scores
    first: np.ndarray     # (labels,) scores of a chain's first word


# ---- features ------------------------------------------------------------

def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the two-byte Latin-1 capitals."""
    low = B.LOWER[data]
    if len(low) > 1:
        cap = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][cap] += 0x20
    return low


def words(data: np.ndarray, offsets: np.ndarray):
    """(folded bytes, starts, ends, words per text, chain breaks): a break is
    the first word of a line."""
    low = fold(data)
    starts, ends, per = B.spans(low, offsets, _WORD)
    # runs of other bytes above 0x7F (quotes, symbols) hold no letter
    odd = np.flatnonzero(low[starts] >= 0x80) if len(starts) else np.zeros(0, int)
    if len(odd):
        drop = []
        known: dict[bytes, bool] = {}
        for i in odd.tolist():
            w = low[starts[i]:ends[i]].tobytes()
            if w not in known:
                if len(known) > 200_000:
                    known.clear()
                known[w] = any(c.isalpha() for c in w.decode("utf-8", "ignore"))
            if not known[w]:
                drop.append(i)
        if drop:
            keep = np.ones(len(starts), bool)
            keep[drop] = False
            starts, ends = starts[keep], ends[keep]
            per = np.diff(np.searchsorted(starts, offsets, side="left"))
    n = len(starts)
    begin = np.zeros(n, bool)
    if n:
        edge = np.concatenate([[0], np.cumsum(per)])
        begin[edge[:-1][per > 0]] = True
        line = np.searchsorted(np.flatnonzero(low == 0x0A), starts)
        begin[1:] |= line[1:] != line[:-1]
    return low, starts, ends, per, begin


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, word index) of the given words: the word itself, prefixes
    and suffixes of one to four bytes, and all byte n-grams of two to four."""
    n = ends - starts
    idx = np.arange(len(starts))
    s, e, w, salt = [starts], [ends], [idx], [np.full(len(starts), _SALT[0])]
    for k in range(1, 5):
        m = idx[n > k]
        s += [starts[m], ends[m] - k]
        e += [starts[m] + k, ends[m]]
        w += [m, m]
        salt += [np.full(len(m), _SALT[1]), np.full(len(m), _SALT[2])]
    for k in range(2, 5):
        c = np.maximum(n - k + 1, 0)
        m = np.repeat(idx, c)
        first = np.repeat(starts - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
        s.append(first)
        e.append(first + k)
        w.append(m)
        salt.append(np.full(len(m), _SALT[3]))
    s, e, w, salt = (np.concatenate(x) for x in (s, e, w, salt))
    h = B.mix(B.hashes(data, s, e) ^ salt) >> np.uint64(64 - BITS)
    return h.astype(np.int64), w


def distinct(data, starts, ends):
    """(feature ids, distinct-word index, index of each word's distinct word)."""
    _, one, back = np.unique(B.hashes(data, starts, ends), return_index=True, return_inverse=True)
    f, w = features(data, starts[one], ends[one])
    return f, w, back, len(one)


def scores(f, w, count, weights) -> np.ndarray:
    """Emission scores of the distinct words."""
    return np.stack([np.bincount(w, weights[f, k], count) for k in range(weights.shape[1])], axis=1)


# ---- forward-backward ----------------------------------------------------

def enter(p: np.ndarray, move: np.ndarray, at: np.ndarray, size: np.ndarray, nth: np.ndarray, x: np.ndarray):
    """Messages that enter the pieces of cut chains: ``x`` (a row per piece) gets
    those of its first word, the result those behind its last word.  ``nth`` is the
    place of a piece in its chain, 0 where it starts one."""
    k = p.shape[1]
    behind = np.ones((len(at), k))
    cut = np.flatnonzero((nth > 0) | (np.append(nth[1:], 0) > 0))
    if not len(cut):
        return behind
    # what a piece does to the message of its first word, up to its last word
    cut = cut[np.argsort(-size[cut], kind="stable")]
    through = np.tile(np.eye(k), (len(cut), 1, 1))
    for t in range(1, int(size[cut[0]])):
        c = int(np.searchsorted(-size[cut], -t, side="left"))
        y = (through[:c] @ move) * p[at[cut[:c]] + t][:, None, :]
        through[:c] = y / y.sum(axis=(1, 2), keepdims=True)
    step = np.empty((len(at), k, k))
    step[cut] = through
    place = np.argsort(nth, kind="stable")
    edge = np.searchsorted(nth[place], np.arange(int(nth.max()) + 2))
    for d in range(1, len(edge) - 1):
        i = place[edge[d]:edge[d + 1]]
        y = ((x[i - 1][:, None, :] @ step[i - 1])[:, 0] @ move) * p[at[i]]
        x[i] = y / y.sum(axis=1, keepdims=True)
    for d in range(len(edge) - 2, 0, -1):
        i = place[edge[d]:edge[d + 1]]
        y = (p[at[i]] * (step[i] @ behind[i][:, :, None])[:, :, 0]) @ move.T
        behind[i - 1] = y / y.sum(axis=1, keepdims=True)
    return behind


def marginals(emit: np.ndarray, begin: np.ndarray, m: Model, pairs: bool = False, piece: int = PIECE):
    """Label probabilities of every word; with ``pairs`` also the expected
    transitions.  ``emit`` are scores per word, ``begin`` marks chain starts."""
    n, k = emit.shape
    at = np.flatnonzero(begin)
    since = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    at = np.flatnonzero(since % piece == 0)
    nth = since[at] // piece
    size = np.diff(np.append(at, n))
    p = np.exp(emit - emit.max(axis=1, keepdims=True))
    move = np.exp(m.moves - m.moves.max())
    x = np.exp(m.first - m.first.max()) * p[at]
    x /= x.sum(axis=1, keepdims=True)
    behind = enter(p, move, at, size, nth, x)
    order = np.argsort(-size, kind="stable")
    at, size, x = at[order], size[order], x[order]
    a = np.empty((n, k))
    b = np.ones((n, k))
    b[at + size - 1] = behind[order]
    longest = int(size[0]) if len(size) else 0
    active = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest)]  # pieces longer than t
    a[at] = x
    for t in range(1, longest):
        i = at[:active[t]] + t
        x = (x[:active[t]] @ move) * p[i]
        x /= x.sum(axis=1, keepdims=True)
        a[i] = x
    for t in range(longest - 2, -1, -1):
        c = active[t + 1]
        i = at[:c] + t
        nxt = b[i + 1] * p[i + 1]
        y = nxt @ move.T
        y /= y.sum(axis=1, keepdims=True)
        b[i] = y
    g = a * b
    g /= g.sum(axis=1, keepdims=True)
    if not pairs:
        return g, None
    i = np.flatnonzero(~begin)
    left, right = a[i - 1], b[i] * p[i]
    norm = ((left @ move) * right).sum(axis=1)
    return g, move * ((left / norm[:, None]).T @ right)


def train_shard(m: Model, lines: list[str], marks: list[int]) -> Model:
    """Adaptive gradient steps on one shard of labelled lines."""
    data, offsets = B.texts(pa.array(lines, pa.string()))
    low, starts, ends, per, begin = words(data, offsets)
    if not len(starts):
        return m
    label = np.repeat(np.asarray(marks), per)
    # chains of four lines: neighbours come from different documents
    line = np.repeat(np.arange(len(per)), per)
    chain = np.zeros(len(line), bool)
    chain[0] = True
    chain[1:] = (line[1:] // 4) != (line[:-1] // 4)
    f, w, back, count = distinct(low, starts, ends)
    k = len(m.labels)
    gold = np.zeros((len(label), k))
    gold[np.arange(len(label)), label] = 1
    i = np.flatnonzero(~chain)
    seen = np.zeros((k, k))
    np.add.at(seen, (label[i - 1], label[i]), 1)
    weights, moves, first = m.weights.astype(np.float64), m.moves.copy(), m.first.copy()
    gw, gm, gf = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6), np.full_like(first, 1e-6)
    n = len(label)
    for _ in range(STEPS):
        now = Model(m.labels, weights, moves, first)
        g, xi = marginals(scores(f, w, count, weights)[back], chain, now, pairs=True)
        left = gold - g
        word = np.stack([np.bincount(back, left[:, j], count) for j in range(k)], axis=1)
        grad = np.stack([np.bincount(f, word[w, j], len(weights)) for j in range(k)], axis=1) / n
        grad -= 1e-7 * weights
        gw += grad * grad
        weights += RATE * grad / np.sqrt(gw) * 0.25
        d = (seen - xi) / n
        gm += d * d
        moves += RATE * d / np.sqrt(gm)
        d = left[chain].sum(axis=0) / n
        gf += d * d
        first += RATE * d / np.sqrt(gf)
    return Model(m.labels, weights.astype(np.float32), moves, first)


# ---- Spark ---------------------------------------------------------------

def held_out(id_col: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_label: int = TRAIN_DOCS) -> Model:
    """Learn from at most about ``per_label`` documents of each label."""
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    d = d.where("_lang is not null and _text is not null").where(~held_out(F.col("_id")))
    u = (F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    sizes = {r["_lang"]: r["count"] for r in d.groupBy("_lang").count().collect()}  # one row per language
    labels = sorted(sizes)
    k = len(labels)
    model = Model(labels, np.zeros((1 << BITS, k), np.float32), np.zeros((k, k)), np.zeros(k))
    if not labels:
        return model
    share = F.create_map(*[F.lit(x) for lab in labels for x in (lab, min(1.0, per_label / sizes[lab]))])
    lines = d.where(u < share[F.col("_lang")]).select(
        "_lang", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"), F.col("_id").cast("string").alias("_id"))
    mix = F.xxhash64("_id", "_pos", "_line")
    lines = lines.select("_lang", "_line", mix.alias("_mix"), F.pmod(mix, F.lit(SHARDS)).cast("int").alias("shard")).persist()
    shape = T.StructType([T.StructField("weights", T.BinaryType()), T.StructField("moves", T.ArrayType(T.DoubleType())),
                          T.StructField("first", T.ArrayType(T.DoubleType()))])
    index = {x: i for i, x in enumerate(labels)}
    for _ in range(ROUNDS):
        now = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS x labels weights

        def fit(t: pa.Table) -> pa.Table:
            t = t.sort_by("_mix")
            out = train_shard(now.value, t["_line"].to_pylist(), [index[x] for x in t["_lang"].to_pylist()])
            return pa.table({"weights": [out.weights.astype(np.float32).tobytes()],
                             "moves": [out.moves.reshape(-1).tolist()], "first": [out.first.tolist()]},
                            schema=pa.schema([("weights", pa.binary()), ("moves", pa.list_(pa.float64())),
                                              ("first", pa.list_(pa.float64()))]))

        got = lines.groupBy("shard").applyInArrow(fit, shape).collect()  # at most SHARDS rows of weights
        if not got:
            break
        model = Model(labels, np.mean([np.frombuffer(r["weights"], np.float32).reshape(-1, k) for r in got], axis=0),
                      np.mean([np.array(r["moves"]).reshape(k, k) for r in got], axis=0),
                      np.mean([np.array(r["first"]) for r in got], axis=0))
        now.unpersist()
    lines.unpersist()
    return model


def label_chunk(m: Model, data: np.ndarray, offsets: np.ndarray):
    """(marginals of all words, words per text)."""
    low, starts, ends, per, begin = words(data, offsets)
    if not len(starts) or not m.labels:
        return np.zeros((0, max(1, len(m.labels)))), np.zeros_like(per)
    f, w, back, count = distinct(low, starts, ends)
    g, _ = marginals(scores(f, w, count, m.weights)[back], begin, m)
    return g, per


def predict(docs: DataFrame, m: Model, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document: ``row`` (a struct of the kept columns), lang_pred,
    score, n_words, ``runs``: the stretches of equal word labels as (first word,
    words, label), and ``sure``: the mean of each word's largest marginal."""
    kept = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    shared = docs.sparkSession.sparkContext.broadcast(m)
    run_t = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType()),
                                      T.StructField("lang", T.StringType())]))
    shape = T.StructType([T.StructField("row", kept), T.StructField("lang_pred", T.StringType()),
                          T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()),
                          T.StructField("runs", run_t), T.StructField("sure", T.DoubleType())])
    inside = list(keep).index(text_col) if text_col in keep else None
    arrow_run = pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array([*model.labels, UNKNOWN], pa.string())
        for batch in batches:
            col = batch.column(1) if inside is None else batch.column(0).field(inside)
            for i, j, data, offsets in B.chunks(*B.texts(col)):
                g, per = label_chunk(model, data, offsets)
                edge = np.concatenate([[0], np.cumsum(per)])
                total = np.concatenate([np.zeros((1, g.shape[1])), np.cumsum(g, axis=0)])
                share = (total[edge[1:]] - total[edge[:-1]]) / np.maximum(per, 1)[:, None]
                best = np.where(per > 0, share.argmax(axis=1), len(model.labels))
                score = np.where(per > 0, np.clip(share.max(axis=1), 0, 1), 0.0)
                top = np.concatenate([[0.0], np.cumsum(g.max(axis=1))])
                sure = np.clip((top[edge[1:]] - top[edge[:-1]]) / np.maximum(per, 1), 0, 1)
                lab = g.argmax(axis=1) if len(g) else np.zeros(0, int)
                turn = np.ones(len(lab), bool)
                turn[1:] = lab[1:] != lab[:-1]
                turn[edge[:-1][per > 0]] = True
                at = np.flatnonzero(turn)
                runs_per = np.diff(np.searchsorted(at, edge))
                doc = np.repeat(np.arange(len(per)), runs_per)
                runs = pa.StructArray.from_arrays(
                    [pa.array((at - edge[doc]).astype(np.int32)),
                     pa.array(np.diff(np.append(at, len(lab))).astype(np.int32)),
                     names.take(pa.array(lab[at]))], fields=list(arrow_run))
                runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(runs_per)]).astype(np.int32)), runs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), names.take(pa.array(best)), pa.array(score),
                     pa.array(per.astype(np.int64)), runs, pa.array(sure)],
                    names=["row", "lang_pred", "score", "n_words", "runs", "sure"])

    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    given = docs.select(row, F.col(f"`{text_col}`").alias("_text")) if inside is None else docs.select(row)
    return given.mapInArrow(run, shape)
