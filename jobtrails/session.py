"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every jobtrails session wants.  Shuffle partition count is left to
# the caller (cluster jobs size it to the data; local runs use the core count)
# and AQE coalesces small partitions / splits skewed ones at run time.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "jobtrails",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``jobtrails`` importable by the Python workers.

    Functions run by ``mapInPandas`` are pickled by reference to their module,
    so every executor must be able to import the package.  It is zipped once
    per SparkContext and distributed with ``addPyFile`` (Spark's own file
    distribution), which works whatever the driver's working directory.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="jobtrails-pkg-"), "jobtrails.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("jobtrails", os.path.relpath(full, pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stage outputs.

    This is whatever ``spark.checkpoint.dir`` names (a shared file system).
    Only a ``local`` master may go without it -- there the executors are this
    process, so a private temporary folder serves; on a cluster executors
    would each write to their own disk, so an unset folder is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster "
                             f"(master {master})")
        path = tempfile.mkdtemp(prefix="jobtrails-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    ship_package(spark)
    return path


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint dir for a written stage table.
    The random part keeps applications that share the folder apart."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go with its end.  Else they lie on
    the executors' disks until the driver happens to collect its garbage, and
    those of all steps of a job add up.  For actions whose result is in files."""
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, before)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` as a stage table, written once and read from its files; what it
    was shuffled for goes.  A ``path`` given takes the place of what is there."""
    path = path or stage_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
