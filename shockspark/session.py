"""Spark session and shared-storage helpers."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session of this library relies on.  Dates are compared as calendar
# days, so the session time zone is pinned to UTC.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "shockspark", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    ``master`` and ``shuffle_partitions`` are only set when given, so a cluster
    submission keeps whatever the cluster configured.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  Only when nothing is configured and the master is
    local (tests) a fresh folder under the system temp directory is created and
    registered; any other master must name a shared folder.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None)
    if not path:
        try:
            path = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - key absent
            path = None
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="shockspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    path = checkpoint_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


_SCRATCH: dict[str, list[str]] = {}
_CACHES: list[dict] = []


def session_cache() -> dict[tuple, object]:
    """A cache of what was written to scratch folders, by keys that begin with the id of the
    application; ``remove_scratch`` empties it together with the folders."""
    _CACHES.append({})
    return _CACHES[-1]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder inside the shared checkpoint folder."""
    path = posixpath.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_scratch(spark: SparkSession) -> None:
    """Delete every scratch folder that this application has named, by the file system that
    holds it, and forget what was cached of them: the next query builds its tables anew.
    Frames that read them are of no use afterwards."""
    for cache in _CACHES:
        for key in [k for k in cache if k[0] == spark.sparkContext.applicationId]:
            del cache[key]
    for path in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df, name: str = "cut"):
    """``df`` written as Parquet into the shared checkpoint folder and read back (never a
    ``localCheckpoint``): later passes read the columns and rows they need, with size
    statistics, instead of recomputing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
