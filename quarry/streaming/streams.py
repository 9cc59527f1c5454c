"""Structured Streaming twins of the stream buffer operators (ST1-ST9, U1-U2).

The reference keeps a bounded in-memory ring of records per stream and
recomputes everything from a copy of it.  Here a stream is a streaming
DataFrame with a ``stream_id`` column (several streams in one query):

* ST2/ST3 ring buffer: ``transformWithStateInPandas`` keyed by stream with a
  ``ListState`` trimmed to the last N records (N is the buffer capacity, so
  state per key is bounded by the parameter).  Inside a micro-batch records
  are ordered by an order key; between micro-batches by arrival.  Each batch
  emits a versioned snapshot; ``latest_snapshot`` reads the newest.
* ST4/ST5/ST6 and U1/U2 are stateless or incremental aggregates that run the
  same code on a batch or a streaming DataFrame.
* Every query runs with a checkpoint folder under the cluster's checkpoint
  directory, so a restarted or lost executor resumes exactly once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.functions.stats import col_of, finite_double
from quarry.operators.order import join_small, with_position
from quarry.session import ensure_checkpoint_dir

DEFAULT_CAPACITY = 10000  # reference default buffer size
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _epoch_ntz():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


# ---------------------------------------------------------------- sources / sinks
def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of a table's folder (or a single file) with a declared
    schema (ST1); new files landing in the folder are new records."""
    r = spark.readStream.schema(schema).format(fmt)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at) and fs.getFileStatus(at).isFile():  # a stream reads folders: this one's file of that name
        r, path = r.option("pathGlobFilter", at.getName()), at.getParent().toString()
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint directory (shared storage on a
    cluster) for one query's checkpoint and output."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/streams/{name}-{uuid.uuid4().hex[:12]}"


def run_append(stream: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """Run an append-mode query to completion over what is available
    (``availableNow``), into a file sink with a checkpoint; return the
    written table as a batch DataFrame."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    q = (stream.writeStream.format(fmt).outputMode("append").option("checkpointLocation", f"{base}/_checkpoint")
         .option("path", f"{base}/out").trigger(availableNow=True).start())
    q.awaitTermination()
    if fmt == "csv":
        return spark.read.option("header", False).schema(stream.schema).csv(f"{base}/out")
    return spark.read.format(fmt).schema(stream.schema).load(f"{base}/out")


def run_complete(stream: DataFrame, name: str) -> DataFrame:
    """Run an aggregating query in complete mode to completion; every
    micro-batch rewrites the full (small, one row per group) result table."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    out = f"{base}/out"

    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = (stream.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    # the declared schema: an empty source runs no batch and gives an empty table
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(out)


def export_stream(stream: DataFrame, path: str, fmt: str = "csv", checkpoint: str | None = None):
    """Stream export as CSV or JSON files (ST9): a file sink with a
    checkpoint, so output is exactly once across restarts."""
    spark = stream.sparkSession
    w = stream.writeStream.format(fmt).outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint or scratch_path(spark, "export") + "/_checkpoint")
    if fmt == "csv":
        w = w.option("header", True)
    return w.trigger(availableNow=True).start()


# ---------------------------------------------------------------- ST2 ring buffer
class LastN(StatefulProcessor):
    """Keeps the last ``capacity`` records of each stream in a ListState."""

    def __init__(self, capacity: int, fields: Sequence[str], order: Sequence[str], state_schema: str):
        self.capacity = int(capacity)
        self.fields = list(fields)
        self.order = list(order)
        self.state_schema = state_schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buf = handle.getListState("buf", self.state_schema)
        self.meta = handle.getValueState("meta", "version long, received long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.capacity
        newest = None
        added = 0
        for pdf in rows:  # fold each Arrow batch into a running top-N: bounded memory
            added += len(pdf)
            part = pdf[self.fields]
            newest = part if newest is None else pd.concat([newest, part], ignore_index=True)
            newest = newest.sort_values(self.order, kind="stable").tail(n)
        old = pd.DataFrame(list(self.buf.get()) if self.buf.exists() else [], columns=self.fields)
        if newest is None:
            buf = old
        elif old.empty:
            buf = newest.tail(n)
        else:
            buf = pd.concat([old, newest], ignore_index=True).tail(n)
        self.buf.put([tuple(r) for r in buf.itertuples(index=False, name=None)])
        version, received = self.meta.get() if self.meta.exists() else (0, 0)
        version, received = version + 1, received + added
        self.meta.update((version, received))
        out = buf.reset_index(drop=True).copy()
        out.insert(0, "slot", range(len(out)))
        out.insert(0, "records_added", added)
        out.insert(0, "records_received", received)
        out.insert(0, "version", version)
        out.insert(0, "stream_id", key[0])
        yield out

    def close(self) -> None:
        pass


def ring_buffer(stream: DataFrame, key: str, order: Sequence[str], capacity: int = DEFAULT_CAPACITY) -> DataFrame:
    """Last ``capacity`` records per stream as versioned snapshots (ST2).

    Timestamp fields are carried in state as epoch microseconds and restored
    on output."""
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    fields, enc = [], {}
    proj = [col_of(key).cast("string").alias("stream_id")]
    for f in stream.schema.fields:
        if f.name == key:
            continue
        if isinstance(f.dataType, T.TimestampNTZType):  # wall clock: no time zone involved
            proj.append(F.timestamp_diff("MICROSECOND", _epoch_ntz(), col_of(f.name)).alias(f.name))
            enc[f.name] = f.dataType
        elif isinstance(f.dataType, T.TimestampType):
            proj.append(F.unix_micros(col_of(f.name)).alias(f.name))
            enc[f.name] = f.dataType
        else:
            proj.append(col_of(f.name))
        fields.append(f.name)
    src = stream.select(*proj)
    state_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields
                             if f.name != "stream_id")
    out_schema = ("stream_id string, version long, records_received long, records_added long, slot long, "
                  + state_schema)
    proc = LastN(capacity, fields, list(order), state_schema)
    snap = src.groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=proc, outputStructType=out_schema, outputMode="Append", timeMode="None")
    for name, dt in enc.items():
        back = (F.timestamp_add("MICROSECOND", col_of(name), _epoch_ntz()) if isinstance(dt, T.TimestampNTZType)
                else F.timestamp_micros(col_of(name)))
        snap = snap.withColumn(name, back)
    return snap.withColumn("capacity", F.lit(int(capacity)).cast("bigint"))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Newest buffer contents per stream from the versioned snapshots."""
    newest = snapshots.groupBy("stream_id").agg(F.max("version").alias("version"))
    return join_small(snapshots, newest, ["stream_id", "version"])


def last_n_batch(df: DataFrame, key: str, order: Sequence[str], capacity: int = DEFAULT_CAPACITY) -> DataFrame:
    """Batch twin of the ring buffer: last N rows per stream by order.
    Positions from the end come from the distributed position helper, so
    a stream holding most rows is still spread over many tasks."""
    pos = with_position(df, [F.desc(o) for o in order], by=[key], pos_col="_rn", n_col=None)
    return pos.where(F.col("_rn") < capacity).drop("_rn")


def most_recent(buffer: DataFrame, n: int, order: str = "slot") -> DataFrame:
    """Most recent n records of each stream's buffer (ST3)."""
    from pyspark.sql import Window
    w = Window.partitionBy("stream_id").orderBy(F.desc(order))
    return buffer.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def ingest_stats(snapshots: DataFrame) -> DataFrame:
    """Per stream and micro-batch: records added, buffered, capacity, % used
    (ST1)."""
    g = snapshots.groupBy("stream_id", "version").agg(
        F.first("records_added").alias("records_added"), F.count(F.lit(1)).alias("total_buffered"),
        F.first("capacity").alias("buffer_capacity"))
    return g.withColumn("usage_percent", F.col("total_buffered") * 100.0 / F.col("buffer_capacity"))


def buffer_stats(buffer: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Buffer statistics per stream (ST8)."""
    g = buffer.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("buffer_size"), F.first("capacity").alias("max_size"),
        F.max("records_received").alias("records_received"), F.max(col_of(ts_col)).alias("last_record_ts"))
    return g.withColumn("usage_percent", F.col("buffer_size") * 100.0 / F.col("max_size"))


# ---------------------------------------------------------------- ST4-ST7
def filter_counts(df: DataFrame, predicate, key: str = "stream_id") -> DataFrame:
    """Records before / after a filter per stream (ST4); works on a batch or
    a streaming DataFrame (complete-mode aggregate)."""
    return df.groupBy(col_of(key).alias("stream_id")).agg(
        F.count(F.lit(1)).alias("records_before"),
        F.sum(F.when(predicate, 1).otherwise(0)).cast("bigint").alias("records_after"))


def equals(key: str, value) -> object:
    return col_of(key) == F.lit(value)


def aggregate(df: DataFrame, group_key: str, value_key: str | None, agg_func: str = "sum",
              stream_key: str = "stream_id") -> DataFrame:
    """Group aggregate where a missing value counts as 0 (also in count) and
    a missing group key is its own group (ST5)."""
    if value_key is None:
        raise ValueError("value_key is required (the reference would aggregate zeros)")
    v = F.coalesce(col_of(value_key).cast("double"), F.lit(0.0))
    fn = {"sum": F.sum(v), "mean": F.avg(v), "max": F.max(v), "min": F.min(v), "count": F.count(v)}[agg_func]
    return df.groupBy(col_of(stream_key).alias("stream_id"), col_of(group_key).alias("group_key")).agg(
        fn.alias(agg_func))


TRANSFORMS = ("uppercase", "lowercase", "trim", "multiply")


def apply_transformations(df: DataFrame, transforms: Sequence[Mapping]) -> DataFrame:
    """Field transforms in order (ST6).  A missing field is skipped; an
    operation that does not fit the field's type leaves it unchanged."""
    types = dict(df.dtypes)
    for tr in transforms:
        field, op = tr.get("field"), tr.get("operation")
        if field not in types or op not in TRANSFORMS:
            continue
        c, dt = col_of(field), types[field]
        if op in ("uppercase", "lowercase") and dt == "string":
            df = df.withColumn(field, F.upper(c) if op == "uppercase" else F.lower(c))
        elif op == "trim":
            df = df.withColumn(field, F.trim(c.cast("string")))
        elif op == "multiply" and dt in ("int", "bigint", "double", "float", "smallint", "tinyint"):
            df = df.withColumn(field, c * F.lit(tr.get("factor", 1)))
        types = dict(df.dtypes)
    return df


def zscore_anomalies(buffer: DataFrame, key: str, threshold: float = 3.0) -> DataFrame:
    """Records whose |z| (population std over the stream's buffer) exceeds
    the threshold (ST7); no anomalies for fewer than 2 values or std 0.  NaN and
    infinite values take no part."""
    v = finite_double(col_of(key))
    st = buffer.where(v.isNotNull()).groupBy("stream_id").agg(
        F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"), F.count(v).alias("_n"))
    j = join_small(buffer.where(v.isNotNull()), st, ["stream_id"])
    z = F.abs((v - F.col("_m")) / F.col("_s"))
    return j.where((F.col("_n") >= 2) & (F.col("_s") > 0) & (z > threshold)).withColumn(
        "anomaly_score", z).drop("_m", "_s", "_n")


# ---------------------------------------------------------------- U1, U2
class ProcessorRegistry:
    """Named ``DataFrame -> DataFrame`` processors, applied with
    ``DataFrame.transform`` to batch and streaming frames alike (U1)."""

    def __init__(self) -> None:
        self._p: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> bool:
        self._p[name] = fn
        return True

    def apply(self, name: str, df: DataFrame) -> DataFrame:
        return df.transform(self._p[name])

    def names(self) -> list[str]:
        return sorted(self._p)


def pandas_predicate(fn: Callable[[pd.Series], pd.Series]):
    """Wrap a vectorised pandas predicate as a boolean pandas UDF usable in
    ``where`` on batch or streaming frames (U2)."""
    return F.pandas_udf(fn, T.BooleanType())
