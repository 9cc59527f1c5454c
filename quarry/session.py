"""Session, checkpoint-folder and table-loading helpers."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_spark(master: str | None = None, app: str = "quarry",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Session tuned for analytics: AQE on, UI off, UTC, Arrow on.

    On a cluster, pass no master and let spark-submit decide; the shuffle
    partition count then stays whatever the cluster configured.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only if none is set.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that is used
    as is.  Only in local mode, with nothing configured, a scratch folder is
    created; anywhere else a missing setting is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - e.g. a Connect session has no SparkContext
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir and sc is not None:
        conf_dir = sc.getConf().get("spark.checkpoint.dir")
    if not conf_dir:
        master = sc.master if sc is not None else ""
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # one machine and nothing configured, as in tests: a scratch folder
        conf_dir = tempfile.mkdtemp(prefix="quarry-ckpt-", dir=os.environ.get("QUARRY_SCRATCH", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", conf_dir)
        except Exception:  # noqa: BLE001 - core configs may be read-only at runtime
            pass
    if sc is not None:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    return conf_dir


_CLEANUP_REGISTERED: set[str] = set()


def _app_folder(spark: SparkSession, root: str) -> str:
    """Per-application folder for pinned tables, removed when the Python
    process exits (through the Hadoop file system, so HDFS / object stores
    work too)."""
    try:
        app = spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - no SparkContext (e.g. Connect)
        return f"{root}/tables/shared"
    folder = f"{root}/tables/{app}"
    if folder not in _CLEANUP_REGISTERED:
        _CLEANUP_REGISTERED.add(folder)

        def _drop(path=folder, sc=spark.sparkContext):
            try:
                jvm = sc._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
            except Exception:  # noqa: BLE001 - JVM already gone: nothing to do
                pass

        atexit.register(_drop)
    return folder


def materialize(df: DataFrame, name: str = "pinned") -> DataFrame:
    """Write a derived table as Parquet under the checkpoint folder and read
    it back: cuts lineage and pins the exact rows (shared storage, so it
    survives lost executors), at columnar write speed."""
    import uuid

    root = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{_app_folder(df.sparkSession, root)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once per application, wherever they run."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext (e.g. Connect)
        return
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-package-"), "quarry.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    z.write(file, os.path.join("quarry", os.path.relpath(file, here)))
    sc.addPyFile(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> list[str]:
    """Register every table of a folder as a temp view (S6); folders are looked
    up through the Hadoop file system, so any store works."""
    sc = spark.sparkContext
    out = []
    for n in names:
        p = f"{sf_dir.rstrip('/')}/{n}.parquet"
        at = sc._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at):
            spark.read.parquet(p).createOrReplaceTempView(n)
            out.append(n)
    return out
