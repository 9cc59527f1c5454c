"""Shared pieces of the query registry: table loading, rounding, schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import read_table

# Column lists of the driver tables, in file order (used to
# write the DuckDB oracle SQL by rule).
SCHEMAS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}
NUMERIC = {
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax"],
    "events": ["event_id", "user_id", "value"],
}
TEXT = {
    "customer": ["c_name", "c_mktsegment"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"],
}
LINEITEM_ORDER = SCHEMAS["lineitem"]  # whole rows are distinct: a unique order


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


def r(c: Column | str, d: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), d)


def sr(expr: str, d: int = 6) -> str:
    """The same rounding in the oracle SQL."""
    return f"round(CAST({expr} AS DOUBLE), {d})"


def round_all(df: DataFrame, d: int = 6, skip: tuple = ()) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if f.dataType.simpleString() in ("double", "float") and f.name not in skip:
            out.append(r(F.col(f"`{f.name}`"), d).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)
