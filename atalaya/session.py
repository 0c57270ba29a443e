"""Session settings and lineage cutting that work the same on a laptop and on a cluster."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join key is split even where that costs one more exchange further up.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings every operator relies on."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    # Functions of this package travel inside the tasks, so executors need no installed copy.
    package = sys.modules[__package__]
    if package.__name__ not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(package)
    return spark


def build_session(app: str = "atalaya", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Create a session. On a cluster leave `master` and `shuffle_partitions` to the submit command."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    start = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    for key, value in {**RUNTIME_SETTINGS, **start, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


_SCRATCH: list[str] = []


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster; only a single-machine master may fall back."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="atalaya-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared checkpoint folder, deleted by `release`."""
    path = f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    found, files = file_system(spark, path)
    return files.exists(found)


def release(spark: SparkSession) -> int:
    """Delete what `scratch_path` gave out; call it when all results have been consumed."""
    count = len(_SCRATCH)
    while _SCRATCH:
        found, files = file_system(spark, _SCRATCH.pop())
        files.delete(found, True)
    return count


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder so later steps do not replay earlier ones.

    Spark deletes a checkpoint when its frame is no longer used (see `build_session`).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
