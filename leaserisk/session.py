"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Small dims (nation, region, date, market, steps, vocabularies) are
    # broadcast by size; anything above this goes through a shuffle join.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "leaserisk", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in {**_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_CKPT: dict = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, stream state and intermediate tables.

    On a cluster this is ``spark.checkpoint.dir`` (a shared file system path
    named by the cluster).  Only when it is unset and the master is local
    (tests) a fresh scratch folder is created once per application and
    registered with ``setCheckpointDir`` (``spark.checkpoint.dir`` itself is a
    static conf); it goes when the process ends.  Any other master raises: executors
    don't share the driver's folders.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect: the server owns the checkpoint dir)
        sc = None
    if not d and sc is not None and sc.getCheckpointDir():
        d = sc.getCheckpointDir()
    if not d:
        if sc is None or not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = sc.applicationId
        if app not in _LOCAL_CKPT:
            _LOCAL_CKPT[app] = tempfile.mkdtemp(prefix="leaserisk-ckpt-")
            atexit.register(shutil.rmtree, _LOCAL_CKPT[app], ignore_errors=True)
        d = _LOCAL_CKPT[app]
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark)
    return f"{base}/tables/{name}-{uuid.uuid4().hex}"


def ensure_utc(spark: SparkSession) -> None:
    """Event times are stored without a zone (TIMESTAMP_NTZ); watermarks and
    windows need zoned timestamps.  With the session zone at UTC the cast
    keeps wall-clock values, so window alignment and hour differences are
    exact."""
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def cluster_conf(shuffle_bytes: int, executors: int, cores_per_executor: int,
                 target_partition_bytes: int = 256 * 1024 * 1024) -> dict:
    """Settings for a cluster run sized from the largest expected shuffle.

    The initial shuffle partition count gives about ``target_partition_bytes``
    per task (never fewer than two waves of cores); AQE then coalesces small
    partitions and splits skewed ones at run time.
    """
    cores = executors * cores_per_executor
    parts = max(2 * cores, -(-shuffle_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    }
