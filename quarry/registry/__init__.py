"""All registered queries: ``QUERIES[name](spark, sf_dir) -> DataFrame`` and the
independent DuckDB SQL for each S-checked key in ``ORACLE``."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE: dict = {}

for _mod in ("relational", "analytics", "experiments", "timeseries", "streams"):
    m = importlib.import_module(f"quarry.registry.{_mod}")
    QUERIES.update(m.Q)
    ORACLE.update(m.SQL)
