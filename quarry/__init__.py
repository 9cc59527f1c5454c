"""quarry: exploratory table and stream analytics expressed as Spark plans.

Sub-packages
------------
sources    reading, validating, re-typing, registering and exporting tables
operators  filters, aggregates, profiles, experiments, time series, ordering
functions  column-level helpers: formula compiler, statistics, distributions
plans      spec-driven chart queries and dashboards built from operators
streaming  Structured Streaming twins of the buffer / filter / aggregate ops
"""

from quarry.session import ensure_checkpoint_dir, get_spark, read_table

__all__ = ["get_spark", "ensure_checkpoint_dir", "read_table"]
