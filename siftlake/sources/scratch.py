"""Folders for intermediate tables that driver and executors share, deleted when the process ends."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession

_ROOTS: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir or, where that is unset, below the warehouse.

    On a cluster a warehouse on the driver's own disk is refused: other machines could not read it.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _ROOTS:
        base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
        scheme = spark._jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsc.hadoopConfiguration()).getScheme()
        if scheme == "file" and not sc.getConf().get("spark.checkpoint.dir") and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _ROOTS[sc.applicationId] = f"{base.rstrip('/')}/steps-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, root)
    return f"{_ROOTS[sc.applicationId]}/{name}-{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already
        pass
