"""Intermediate tables that are dropped as soon as they have been used."""

from __future__ import annotations

from pyspark.sql import DataFrame


def discard(table: DataFrame) -> None:
    """Delete the files of a table written by ``materialize``; nothing may read
    it afterwards."""
    files = table.inputFiles()
    if not files:
        return
    sc = table.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
