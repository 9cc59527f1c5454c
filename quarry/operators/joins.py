"""Places where two relations meet.

The reference has no general join; these are its lookups, re-expressed as
equi-joins whose small side is broadcast only behind a size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.stats import col_of
from quarry.operators.order import join_small
from quarry.operators.profile import GEO_LAT, GEO_LON


def attach_coordinates(df: DataFrame, place_col: str, lookup: DataFrame, lat_name: str = GEO_LAT,
                       lon_name: str = GEO_LON) -> DataFrame:
    """Add latitude / longitude from a lookup table ``(place, lat, lon)``
    keyed by the trimmed text of ``place_col`` (J1).  Unmatched or null
    places get nulls.  The lookup must be unique on ``place``; it is
    de-duplicated (smallest coordinates of a place) to keep the row count."""
    lk = (lookup.select(F.trim(F.col("place").cast("string")).alias("_place"),
                        F.struct(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).alias("p"))
                .groupBy("_place").agg(F.min("p").alias("p"))
                .select("_place", F.col("p.lat").alias(lat_name), F.col("p.lon").alias(lon_name)))
    keyed = df.withColumn("_place", F.trim(col_of(place_col).cast("string")))
    return join_small(keyed, lk, ["_place"], "left").drop("_place")
