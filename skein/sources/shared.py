"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that a cluster names in ``spark.checkpoint.dir``. Where that is
    unset, a session on one machine gets a temporary folder; on a cluster, where
    such a folder would be another one on each machine, it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        name = spark.sparkContext.applicationId
        if name not in _local:
            _local[name] = "file://" + tempfile.mkdtemp(prefix="skein-")
        base = _local[name]
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared one, not made yet."""
    return f"{shared_dir(spark)}/skein/{name}-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later plan reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
