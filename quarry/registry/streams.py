"""Registry entries: streaming (ST1-ST9, U1-U2).

Each query runs a real Structured Streaming query over the ``events`` table
as a file source (one stream per event type), to completion with
``availableNow``, into a checkpointed sink; the result table is returned.
The oracle SQL states the same result as batch SQL.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quarry.registry.common import round_all
from quarry.streaming import streams as ST

Q: dict = {}
SQL: dict = {}

CAPACITY = 1000  # buffer capacity used here (parameter; the reference default is 10 000)
EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def q(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _events(spark, sf):
    return ST.file_stream(spark, f"{sf.rstrip('/')}/events.parquet", EVENTS_SCHEMA)


def _snapshots(spark, sf):
    snap = ST.ring_buffer(_events(spark, sf), "event_type", ["ts", "event_id"], CAPACITY)
    return ST.run_append(snap, "ring")


_LAST_SQL = f"""(SELECT *, least(count(*) OVER (PARTITION BY event_type), {CAPACITY})
    - row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS slot,
    count(*) OVER (PARTITION BY event_type) AS received FROM events)"""


@q("stream_last_n", f"""
SELECT event_type AS stream_id, CAST(slot AS BIGINT) AS slot, event_id, ts, user_id, value, props
FROM {_LAST_SQL} WHERE slot >= 0""")
def stream_last_n(spark, sf):
    buf = ST.latest_snapshot(_snapshots(spark, sf))
    return buf.select("stream_id", "slot", "event_id", "ts", "user_id", "value", "props")


@q("stream_recent", f"""
SELECT event_type AS stream_id, CAST(slot AS BIGINT) AS slot, event_id FROM {_LAST_SQL}
WHERE slot >= least(received, {CAPACITY}) - 5""")
def stream_recent(spark, sf):
    buf = ST.latest_snapshot(_snapshots(spark, sf))
    return ST.most_recent(buf, 5).select("stream_id", "slot", "event_id")


@q("stream_ingest_stats", f"""
SELECT event_type AS stream_id, CAST(1 AS BIGINT) AS version, CAST(count(*) AS BIGINT) AS records_added,
       CAST(least(count(*), {CAPACITY}) AS BIGINT) AS total_buffered, CAST({CAPACITY} AS BIGINT) AS buffer_capacity,
       round(least(count(*), {CAPACITY}) * 100.0 / {CAPACITY}, 6) AS usage_percent
FROM events GROUP BY event_type""")
def stream_ingest_stats(spark, sf):
    return round_all(ST.ingest_stats(_snapshots(spark, sf)))


@q("stream_stats", f"""
SELECT stream_id, CAST(count(*) AS BIGINT) AS buffer_size, CAST({CAPACITY} AS BIGINT) AS max_size,
       CAST(max(received) AS BIGINT) AS records_received, max(ts) AS last_record_ts,
       round(count(*) * 100.0 / {CAPACITY}, 6) AS usage_percent
FROM (SELECT event_type AS stream_id, * FROM {_LAST_SQL}) WHERE slot >= 0 GROUP BY stream_id""")
def stream_stats(spark, sf):
    buf = ST.latest_snapshot(_snapshots(spark, sf))
    return round_all(ST.buffer_stats(buf))


@q("stream_zscore", f"""
WITH b AS (SELECT event_type AS stream_id, event_id, value FROM {_LAST_SQL} WHERE slot >= 0 AND value IS NOT NULL),
s AS (SELECT stream_id, avg(value) AS m, stddev_pop(value) AS sd, count(*) AS n FROM b GROUP BY 1)
SELECT b.stream_id, event_id, value, round(abs((value - m) / sd), 6) AS anomaly_score
FROM b JOIN s USING (stream_id) WHERE n >= 2 AND sd > 0 AND abs((value - m) / sd) > 3""")
def stream_zscore(spark, sf):
    buf = ST.latest_snapshot(_snapshots(spark, sf))
    z = ST.zscore_anomalies(buf, "value", 3.0).select("stream_id", "event_id", "value", "anomaly_score")
    return round_all(z)


@q("stream_filter", """
SELECT event_type AS stream_id, CAST(count(*) AS BIGINT) AS records_before,
       CAST(sum(CASE WHEN user_id = 8 THEN 1 ELSE 0 END) AS BIGINT) AS records_after
FROM events GROUP BY event_type""")
def stream_filter(spark, sf):
    ev = _events(spark, sf).withColumnRenamed("event_type", "stream_id")
    return ST.run_complete(ST.filter_counts(ev, ST.equals("user_id", 8)), "filter")


@q("stream_aggregate", """
SELECT event_type AS stream_id, user_id AS group_key, round(sum(coalesce(value, 0)), 4) AS sum
FROM events GROUP BY event_type, user_id""")
def stream_aggregate(spark, sf):
    ev = _events(spark, sf).withColumnRenamed("event_type", "stream_id")
    out = ST.run_complete(ST.aggregate(ev, "user_id", "value", "sum"), "agg")
    return out.withColumn("sum", F.round("sum", 4))


_TRANSFORMS = [{"field": "event_type", "operation": "uppercase"}, {"field": "props", "operation": "trim"},
               {"field": "value", "operation": "multiply", "factor": 1.5},
               {"field": "event_type", "operation": "multiply", "factor": 2},  # wrong type: left unchanged
               {"field": "missing", "operation": "lowercase"}]


@q("stream_transform", """
SELECT event_id, upper(event_type) AS event_type, trim(props) AS props, round(value * 1.5, 6) AS value FROM events""")
def stream_transform(spark, sf):
    out = ST.run_append(ST.apply_transformations(_events(spark, sf), _TRANSFORMS), "transform")
    return out.select("event_id", "event_type", "props", F.round("value", 6).alias("value"))


def _registry():
    reg = ST.ProcessorRegistry()
    reg.register("high_value", lambda df: df.where(F.col("value") > 30).withColumn("value_x2", F.col("value") * 2))
    return reg


@q("udf_processor", """
SELECT event_id, event_type, value, value * 2 AS value_x2 FROM events WHERE value > 30""")
def udf_processor(spark, sf):
    out = ST.run_append(_registry().apply("high_value", _events(spark, sf)), "processor")
    return out.select("event_id", "event_type", "value", "value_x2")


def _k_over_50(props: pd.Series) -> pd.Series:
    k = props.str.extract(r'"k"\s*:\s*(-?\d+)', expand=False).astype("float64")
    return (k > 50).fillna(False)


@q("udf_filter", """
SELECT event_id, event_type, props FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) > 50""")
def udf_filter(spark, sf):
    pred = ST.pandas_predicate(_k_over_50)
    out = ST.run_append(_events(spark, sf).where(pred(F.col("props"))), "udf_filter")
    return out.select("event_id", "event_type", "props")
