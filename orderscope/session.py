"""Spark session defaults and the shared materialisation folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins from real shuffle sizes (sort-merge
# to broadcast when a side turns out small), coalesces small shuffle partitions and
# splits skewed join partitions. Timestamps are zone-less (TIMESTAMP_NTZ) throughout;
# the session zone is pinned to UTC; the NTZ arithmetic itself does not depend on it.
DEFAULT_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Starting point for a large cluster (hundreds of TB of input, ~1000 executors).
# Scans: 512 MB splits of the columnar files (only the needed columns are read).
# Shuffles: many initial partitions, coalesced by AQE towards 256 MB each where a shuffle
# holds more than that for every core (parallelismFirst stays on, so smaller ones stay
# finer); a partition 5x the median and over 1 GB is split (skew join). Broadcast only what measures under
# 64 MB, statically or at runtime. Decommissioning migrates shuffle blocks off leaving
# executors so a lost node does not force recomputation of finished stages.
CLUSTER_CONF: dict[str, str] = {
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.decommission.enabled": "true",
    "spark.storage.decommission.enabled": "true",
    "spark.storage.decommission.shuffleBlocks.enabled": "true",
}


def get_session(
    master: str | None = None,
    app_name: str = "orderscope",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
    profile: str = "default",
) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    On a cluster pass ``master=None`` (spark-submit decides) and ``profile="cluster"``
    for the sizing above; size ``shuffle_partitions`` to the data (about 128-256 MB per
    shuffle partition after AQE coalescing), not to a fixed 200.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if profile == "cluster":
        conf.update(CLUSTER_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for materialised intermediates.

    Read from ``spark.checkpoint.dir`` (set by the cluster to shared storage that
    survives executor loss). Only when it is unset -- local runs and tests -- a
    fresh scratch folder is created and registered on the session.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    try:
        d = spark.sparkContext.getCheckpointDir()
    except Exception:  # a Spark Connect session has no SparkContext
        d = None
    if not d:
        master = spark.conf.get("spark.master", "") or ""
        if not master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: point it at shared storage (HDFS/S3/...) "
                "so materialised tables survive the loss of an executor"
            )
        # local mode only (tests): one machine, so a scratch folder is shared by all tasks.
        # spark.checkpoint.dir is a static setting; only the context-level dir can be set now
        d = tempfile.mkdtemp(prefix="orderscope-ckpt-")
        try:
            spark.sparkContext.setCheckpointDir(d)
        except Exception:
            pass
    return d


def app_id(spark: SparkSession) -> str:
    """The application id (classic or Spark Connect session)."""
    return spark.conf.get("spark.app.id", None) or spark.sparkContext.applicationId


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, wherever Spark keeps it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder, wherever Spark keeps it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_concurrently(jobs: list[Callable[[], None]], max_parallel: int = 4) -> None:
    """Run independent Spark actions (e.g. writes of different tables) as concurrent jobs.

    Each callable submits its own job from a driver thread; Spark schedules the jobs side
    by side, so small tables do not leave the cluster idle while they run one by one.
    Any failure is raised after all jobs have finished or failed.
    """
    if len(jobs) <= 1:
        for job in jobs:
            job()
        return
    with ThreadPoolExecutor(max_workers=min(max_parallel, len(jobs))) as pool:
        futures = [pool.submit(job) for job in jobs]
    for f in futures:
        f.result()
