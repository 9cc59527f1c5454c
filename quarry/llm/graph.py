"""Connected components of an edge table by alternating star steps.

Every round joins each node with its smallest neighbour; nothing is gathered
per node, so a hub with any number of neighbours stays spread over tasks.
Edges are first contracted inside each Arrow batch, which shortens long chains.
Rounds are written to the shared checkpoint folder, so lost executors cost one
round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.temp import discard
from quarry.session import materialize


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one batch -> one edge from each node to the smallest node of
    its part of the batch."""
    for batch in batches:
        u, v = (np.asarray(batch.column(k)).astype(np.int64) for k in range(2))
        if not len(u):
            continue
        nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = flat[:len(u)], flat[len(u):]
        root = np.arange(len(nodes))
        while True:  # min-label hooking with pointer jumping, on arrays
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = new[new]
            while not np.array_equal(new, new[new]):
                new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        keep = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[root[keep]])], names=["u", "v"])


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` that is not its own root;
    root is the smallest node id reachable.  Null ends and loops are ignored."""
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = materialize(e.mapInArrow(_contract, "u bigint, v bigint").distinct(), "edges")
    last = _state(e)
    for _ in range(rounds):
        if not last[0]:
            break
        before = e
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = materialize(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _state(e)
        discard(before)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
