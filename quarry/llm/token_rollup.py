"""Token totals by source, language and tokenizer version, kept by deltas.

A batch of changes (inserts, deletes, revised counts) is summed to one signed
delta per key and added to the totals; no document is read again.  Each commit
writes a new version of the totals together with the ids of all batches in it,
in one Parquet folder.  A version counts once its ``_SUCCESS`` file exists, so a
commit is all or nothing, and a batch id that is already in the newest version
is ignored: a batch may be delivered any number of times.

Sums are partial before they are shuffled, so a key with a third of all rows is
one row per task.  A change's ``op`` is ``insert`` (+n_tokens, one document),
``delete`` (-n_tokens, one document) or ``revise`` (n_tokens - old_tokens).

Edge cases: null keys are keys of their own; a null count is 0; an unknown or
null op is an error when the batch is committed; an empty batch is recorded and
changes nothing; repeated rows count as often as they come; keys whose totals
fall to zero documents and tokens leave the table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
# The rules of the counters that need no vocabulary file.
COUNTERS = {"words-1": r"[^\x20\x09-\x0D]+",
            "pieces-2": r"[A-Za-z]+|[0-9]|[^\x00-\x7F]+|[^A-Za-z0-9\x80-\x{10FFFF}\x20\x09-\x0D]"}


def count_by_rule(text: str, version: str):
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(COUNTERS[version])), F.lit(0)).cast("long")


def count_tokens(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) by a public tokenizer file given as text."""
    from quarry.llm import bytewords as B
    from quarry.llm.token_files import _encoder

    shared = docs.sparkSession.sparkContext.broadcast(spec)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in B.chunks(*B.texts(batch.column(1))):
                _, n = _encoder(shared.value).encode(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64())],
                                                 names=["doc_id", "n_tokens"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("t")).mapInArrow(
        run, "doc_id bigint, n_tokens bigint")


def deltas(changes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One signed row per key: n_docs and n_tokens to add."""
    n = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))
    old = F.coalesce(F.col("old_tokens").cast("long"), F.lit(0)) if "old_tokens" in changes.columns else F.lit(0)
    op = F.col("op")
    bad = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(op, F.lit("null"))))
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(bad.cast("int"))
    tokens = F.when(op == "insert", n).when(op == "delete", -n).when(op == "revise", n - old)
    return changes.select(*keys, docs.alias("d"), tokens.alias("t")).groupBy(*keys).agg(
        F.sum("d").alias("n_docs"), F.sum("t").alias("n_tokens"))


class Rollup:
    """Versioned totals in a shared folder."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = KEYS):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        self._jvm = spark.sparkContext._jvm
        path = self._path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _versions(self) -> list[int]:
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(x[1:]) for x in found if x.startswith("v") and x[1:].isdigit()
                      and self._fs.exists(self._path(f"{self.root}/{x}/_SUCCESS")))

    def _read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{version}")

    def committed(self) -> set[str]:
        """Ids of the batches in the newest version (one row per batch)."""
        v = self._versions()
        return {r["batch"] for r in self._read(v[-1]).where("batch is not null").select("batch").collect()} if v else set()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add one batch; False when it is already in."""
        versions = self._versions()
        if batch in self.committed():
            return False
        none = F.lit(None).cast("string").alias("batch")
        rows = deltas(changes, self.keys).select(none, *self.keys, "n_docs", "n_tokens")
        mark = self.spark.range(1).select(F.lit(batch).alias("batch"), *(F.lit(None).cast("string").alias(k) for k in self.keys),
                                          F.lit(0).cast("long").alias("n_docs"), F.lit(0).cast("long").alias("n_tokens"))
        rows = rows.union(mark)
        if versions:
            rows = rows.union(self._read(versions[-1]).select("batch", *self.keys, "n_docs", "n_tokens"))
        total = rows.groupBy("batch", *self.keys).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        total = total.where("batch is not null or n_docs <> 0 or n_tokens <> 0")
        version = versions[-1] + 1 if versions else 1
        total.coalesce(8).write.mode("overwrite").parquet(f"{self.root}/v{version}")
        for old in versions[:-1]:  # the last two stay, for readers under way
            self._fs.delete(self._path(f"{self.root}/v{old}"), True)
        return True

    def totals(self) -> DataFrame:
        v = self._versions()
        if not v:
            raise ValueError(f"no batch committed under {self.root}")
        return self._read(v[-1]).where("batch is null").drop("batch")

    def levels(self) -> DataFrame:
        """Totals of every key and, with null and ``level`` telling which keys
        are summed over, of every tokenizer by source and overall."""
        s, lang, t = self.keys
        sets = [[s, lang, t], [s, t], [t]]
        return self.totals().groupingSets([[F.col(c) for c in x] for x in sets], *[F.col(k) for k in self.keys]).agg(
            F.grouping_id().cast("int").alias("level"), F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
