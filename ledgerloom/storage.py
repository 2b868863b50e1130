"""Where intermediate results live: the shared folder named by ``spark.checkpoint.dir``.

Executors may be lost at any time, so lineage is cut only by reliable checkpoints or by tables
written under this folder.  A machine-local folder is used only where the setting is absent
and the master is this machine (tests, a laptop); on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; also made the context's checkpoint folder when none is set yet."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not current:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path of this name in the shared folder; removed when the driver ends, if the session still runs then."""
    path = f"{shared_dir(spark)}/ledgerloom/{what}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def kept(spark: SparkSession, what: str) -> str:
    """The path of this name that all calls of this application share; removed like ``scratch``."""
    path = f"{shared_dir(spark)}/ledgerloom/{what}-{spark.sparkContext.applicationId}"
    if path not in _kept:
        _kept.add(path)
        atexit.register(_forget, spark, path)
    return path


_kept: set[str] = set()


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and cuts its lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a path on whichever file system holds it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, in order; none if it is absent."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(jpath)) if fs.exists(jpath) else []


def put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text file on whichever file system holds the path."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(jpath, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get(spark: SparkSession, path: str) -> str:
    """A small text file, as ``put`` has written it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).open(jpath)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()
