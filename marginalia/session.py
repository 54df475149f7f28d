"""Session settings and the shared scratch folder."""

from __future__ import annotations

import posixpath
import re
import uuid

from pyspark.sql import SparkSession

from .constants import GROUP_LIMIT_THRESHOLD

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Quotas go up to 2,100 per group; the default of 1,000 would plan them without a map-side row limit.
    "spark.sql.optimizer.windowGroupLimitThreshold": str(GROUP_LIMIT_THRESHOLD),
    # Batches of 10,000 rows of long texts are tens of megabytes outside the heap, several times over for each task.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the plans rely on. They are runtime settings, so an existing session will do."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def group_limit_threshold(spark: SparkSession) -> int:
    """Largest k that this session plans as a map-side group limit."""
    return int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))


_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or the checkpoint folder set by the program.

    On one machine, where neither is set, it lies below the warehouse folder; on a cluster that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return posixpath.join(spark.conf.get("spark.sql.warehouse.dir"), "scratch")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name for a table that has to be written and read back.

    All of them lie in one folder of the application below the shared one, which goes when the application ends
    (``clear_scratch`` removes it before). An application that was killed leaves its ``marginalia-*`` folder behind.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        folder = posixpath.join(shared_folder(spark), f"marginalia-{app}-{uuid.uuid4().hex[:8]}")
        files, path = _files(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS[app] = folder
    return posixpath.join(_FOLDERS[app], uuid.uuid4().hex)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this application. Frames that were made from them cannot be read any more."""
    folder = _FOLDERS.pop(spark.sparkContext.applicationId, None)
    if folder:
        files, path = _files(spark, folder)
        files.delete(path, True)


def _files(spark: SparkSession, folder: str) -> tuple:
    """The file system of a folder, and the folder's path in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path
