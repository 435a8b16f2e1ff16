"""A folder that the driver and all executors share, for tables written and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_KEY = "spark.checkpoint.dir"
_local: dict[str, str] = {}


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path under the session's checkpoint folder, deleted when the driver ends.

    Only a local session without that setting gets a temporary folder.
    """
    base = spark.conf.get(_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_KEY} must name a folder that all executors share")
        base = _local.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.gettempdir()}/tessera-{uuid.uuid4().hex}")
    folder = f"{base.rstrip('/')}/tessera-tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder
